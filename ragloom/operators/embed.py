"""Embedding as a pluggable Arrow-batched step.

``embed_batches`` streams each partition through ``mapInPandas`` in
batches of ``batch_size`` texts and calls ``embedder(list[str]) ->
list[vector]`` once per batch; when a batch call fails every text of the
batch is retried alone, and a text that still fails gets a NULL vector and
``embed_status = 'failed'`` (never a zero vector that would poison cosine).

The bundled embedder is a deterministic signed feature-hashing model over
word tokens (no external service); any callable with the same signature
can replace it.
"""

from __future__ import annotations

import re
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+")
#: Tokens whose place a worker remembers.
TOKENS_KEPT = 500_000


def hash_embedder(dim: int = 64) -> Callable[[Sequence[str]], list]:
    """Signed feature hashing of lower-cased word tokens, L2-normalised.

    token -> md5 hex h; bucket = int(h[0:8], 16) % dim; sign = +1 when the
    9th hex digit is odd, else -1. md5 keeps the model reproducible in any
    engine (the SQL oracle rebuilds the same vectors)."""
    import hashlib

    known: dict[str, tuple[int, float]] = {}     # of each worker; forgotten when it has grown

    def place(token: str) -> tuple[int, float]:
        h = hashlib.md5(token.encode("utf-8")).hexdigest()
        if len(known) >= TOKENS_KEPT:
            known.clear()
        known[token] = found = int(h[:8], 16) % dim, 1.0 if int(h[8], 16) & 1 else -1.0
        return found

    def embed(texts: Sequence[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float64)
            for tok in _WORD.findall(t.lower()):
                at, sign = known.get(tok) or place(tok)
                v[at] += sign
            n = np.sqrt(v @ v)
            out.append((v / n).tolist() if n > 0 else v.tolist())
        return out

    return embed


def embed_batches(df: DataFrame, text_col: str = "chunk_text", out_col: str = "embedding",
                  embedder: Callable[[Sequence[str]], list] | None = None, dim: int = 64,
                  batch_size: int = 100, model_name: str = "hash-embedder") -> DataFrame:
    """V5: add ``out_col`` (ARRAY<DOUBLE>), ``embedding_model`` and
    ``embed_status`` ('ok' / 'failed' / 'empty') to every row."""
    embedder = embedder or hash_embedder(dim)
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.DoubleType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embed_status", T.StringType())])
    cols = df.columns

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].tolist()
            vecs: list = [None] * len(texts)
            status = ["empty" if not t else "ok" for t in texts]
            idx = [i for i, t in enumerate(texts) if t]
            for b in range(0, len(idx), batch_size):
                part = idx[b:b + batch_size]
                try:
                    got = embedder([texts[i] for i in part])
                    for i, v in zip(part, got):
                        vecs[i] = v
                except Exception:  # noqa: BLE001 -- retry one by one
                    for i in part:
                        try:
                            vecs[i] = embedder([texts[i]])[0]
                        except Exception:  # noqa: BLE001
                            vecs[i], status[i] = None, "failed"
            out = pdf[cols].copy()
            out[out_col] = pd.Series(vecs, index=pdf.index, dtype=object)
            out["embedding_model"] = model_name
            out["embed_status"] = status
            yield out

    from ..session import spread
    return spread(df).mapInPandas(run, schema)


STORED = "text_hash string, vector array<double>"


def stored_runs(spark, store: str, model_name: str) -> list[str]:
    """Names of the runs that have written vectors of ``model_name``; one row a run is fetched."""
    try:
        found = spark.read.schema(f"{STORED}, run string").parquet(f"{store}/model={model_name}").select("run").distinct()
        return sorted(r["run"] for r in found.collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def stored_vectors(spark, store: str, model_name: str, runs: Sequence[str] | None = None) -> DataFrame:
    """(text_hash, vector) of the texts that ``runs`` (default: all) have embedded.

    Parts are named one by one: Spark takes two scans of one folder for the same even if
    parts came in between, and might use the older one's rows for both."""
    parts = [f"{store}/model={model_name}/run={r}" for r in (stored_runs(spark, store, model_name) if runs is None else runs)]
    return spark.read.schema(STORED).parquet(*parts) if parts else spark.createDataFrame([], STORED)


def embed_stored(df: DataFrame, store: str, run: str, text_col: str = "chunk_text", out_col: str = "embedding",
                 embedder: Callable[[Sequence[str]], list] | None = None, dim: int = 64, batch_size: int = 100,
                 model_name: str = "hash-embedder", hot: int = 100_000, salts: int = 64) -> DataFrame:
    """V5 + X4 + J8 across runs: as ``embed_batches``, but each distinct text is embedded once.

    Vectors are kept under ``store`` (shared storage) by the SHA-256 of the text and the
    model. A run embeds what the store lacks and writes it as its own part, which a
    repetition under the same ``run`` replaces; texts that fail are not stored and are
    tried again by the next run. Every row then takes its vector from the store. A text
    with over ``hot`` rows (and over a thousandth of all, so there are less than a
    thousand) is joined in ``salts`` parts.
    """
    spark = df.sparkSession
    rows = df.withColumn("_h", F.when(F.length(text_col) > 0, F.sha2(F.encode(text_col, "UTF-8"), 256)))
    texts = rows.where("_h is not null").groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min(text_col).alias("_t"))
    # Parts of this run are not looked at, so a repetition writes the same.
    earlier = [r for r in stored_runs(spark, store, model_name) if r != run]
    known = stored_vectors(spark, store, model_name, earlier).select("text_hash")
    new = texts.join(known, texts["_h"] == known["text_hash"], "left_anti").select(F.col("_h").alias("text_hash"), "_t")
    made = embed_batches(new, "_t", "vector", embedder, dim, batch_size, model_name)
    made.where("embed_status = 'ok'").select("text_hash", "vector").write.mode("overwrite").parquet(
        f"{store}/model={model_name}/run={run}")
    total = texts.agg(F.sum("_n")).first()[0] or 0
    often = texts.where(F.col("_n") > max(hot, total // 1000)).select("_h", F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(often), "_h", "left").withColumn("_salt", F.when(
        F.col("_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts).cast("long"))).otherwise(F.lit(0).cast("long")))
    found = stored_vectors(spark, store, model_name, [*earlier, run]).withColumnRenamed("text_hash", "_h").join(
        F.broadcast(often), "_h", "left")
    zero = F.lit(0).cast("long")
    spread_out = found.select("_h", F.col("vector").alias(out_col), F.explode(F.when(
        F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))).alias("_salt"))
    status = F.when(F.col("_h").isNull(), "empty").when(F.col(out_col).isNull(), "failed").otherwise("ok")
    return salted.join(spread_out, ["_h", "_salt"], "left").select(
        *[F.col(c) for c in df.columns], out_col, F.lit(model_name).alias("embedding_model"), status.alias("embed_status"))
