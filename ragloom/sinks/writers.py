"""Sinks (K1-K8). Every writer commits through Spark's output committer
(task retries and lost executors never leave partial files visible) and
writes to caller-given shared paths."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_chunks(chunks: DataFrame, path: str, day_col: str = "created_date",
                  cluster: Sequence[str] = ("doc_id", "chunk_index")) -> None:
    """K1 + K6: append, partitioned by day, rows sorted by the clustering
    keys inside each file so Parquet min/max statistics skip row groups."""
    partition_layout(chunks, day_col, cluster).write.mode("append").partitionBy(day_col).parquet(path)


def partition_layout(df: DataFrame, day_col: str, cluster: Sequence[str]) -> DataFrame:
    """K6: gather each day's rows and sort them by the clustering keys (no
    global sort). The rebalance hint lets AQE split a day that outgrows the
    advisory partition size, so a hot day is several tasks and files, and
    merge small days."""
    return df.hint("rebalance", day_col).sortWithinPartitions(day_col, *cluster)


def batch_insert(rows: DataFrame, path: str, reject_path: str, valid: Column) -> None:
    """K2: append the rows satisfying ``valid``; route the others, with a
    reason column, to a reject table instead of failing the batch."""
    tagged = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    tagged.where("_ok").drop("_ok").write.mode("append").parquet(path)
    tagged.where(~F.col("_ok")).drop("_ok").withColumn("reject_reason", F.lit("validation failed")) \
          .write.mode("append").parquet(reject_path)


def write_json_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: documents as JSON lines."""
    docs.write.mode(mode).json(path)


def write_text_documents(docs: DataFrame, path: str, title: str = "title", content: str = "content",
                         key: str = "document_id", per_document: bool = False, buckets: int = 64) -> None:
    """K4: ``Title: t`` + blank line + content, plus the metadata as a
    sibling Parquet table. ``per_document`` writes one folder per document
    (as a corpus upload expects); by default documents are grouped into
    ``buckets`` hash buckets to avoid millions of tiny files."""
    body = docs.select(F.col(key), F.concat(F.lit("Title: "), F.coalesce(F.col(title), F.lit("")),
                                            F.lit("\n\n"), F.coalesce(F.col(content), F.lit(""))).alias("value"))
    if per_document:
        body.write.mode("overwrite").partitionBy(key).text(path + "/text")
    else:
        body.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).select("bucket", "value") \
            .write.mode("overwrite").partitionBy("bucket").text(path + "/text")
    docs.drop(content).write.mode("overwrite").parquet(path + "/metadata")


def evolve_schema(df: DataFrame, required: Mapping[str, T.DataType]) -> DataFrame:
    """K5: add missing required columns as typed NULLs; never drops data
    or the table."""
    out = df
    for name, dtype in required.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(dtype))
    return out


def save_report(report: DataFrame, path: str) -> None:
    """K7: a small report table as one JSON file. Only the finished rows go to
    the one writing task; what computes them keeps its own parallelism."""
    report.repartition(1).write.mode("overwrite").json(path)


def export_chunks(chunks: DataFrame, path: str, rename: Mapping[str, str] | None = None,
                  fmt: str = "json") -> None:
    """K8: move a chunk table (text, vector, metadata) to another system
    without re-embedding: rename projection + write."""
    cols = [F.col(c).alias((rename or {}).get(c, c)) for c in chunks.columns]
    chunks.select(*cols).write.mode("overwrite").format(fmt).save(path)
