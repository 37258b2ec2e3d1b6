"""Search, ranking, filters and result post-processing (R2-R11, V4, F1-F9,
J2-J8, U1-U4).

Retrieval cores go through ``vector_search.scan_topk`` (query blocks of measured
size, per-task top-k, exact final window); everything after retrieval works on the small per-query result table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce
from itertools import chain, repeat
from typing import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions import vectors as V
from ..functions.text import WORD_RE, col_
from ..session import scratch_path
from .vector_search import (DEFAULT_BLOCK_BYTES, DEFAULT_GROUP_BYTES, Screen, expand_matches, run_hits, scan_topk,
                            vector_matrix, vocab_index)


#: Terms whose weights go to the queries by a matrix product, at most.
OFTEN_TERMS = 128
#: Queries a term needs for its weight to be added to them by itself.
ASKED_OFTEN = 50
#: Keyword pairs compared for an entry that can still rank, at most; longer lists are scored by the matrix.
KEYWORD_PAIRS = 1024


# ------------------------------------------------------------------ filters
def search_filters(document_types: Sequence[str] | None = None,
                   facilities: Sequence[str] | None = None,
                   equipment_types: Sequence[str] | None = None,
                   safety_levels: Sequence[str] | None = None,
                   min_complexity: int | None = None, max_complexity: int | None = None,
                   min_quality_score: float | None = None,
                   date_from=None, date_to=None,
                   columns: Mapping[str, str] | None = None) -> Column:
    """typed predicates ANDed (no SQL text splicing); absent -> TRUE.

    ``columns`` renames the logical fields to the table's columns. IN lists
    and range tests are pushed to the Parquet scan by Catalyst.
    """
    c = {"document_type": "document_type", "facility": "facility_code",
         "equipment_type": "equipment_type", "safety_level": "safety_level",
         "complexity": "technical_complexity", "quality": "quality_score",
         "created_at": "created_at", **(columns or {})}
    preds = []
    if document_types is not None:
        preds.append(F.col(c["document_type"]).isin(list(document_types)))
    if facilities is not None:
        preds.append(F.col(c["facility"]).isin(list(facilities)))
    if equipment_types is not None:
        preds.append(F.col(c["equipment_type"]).isin(list(equipment_types)))
    if safety_levels is not None:
        preds.append(F.col(c["safety_level"]).isin(list(safety_levels)))
    if min_complexity is not None:
        preds.append(F.col(c["complexity"]) >= min_complexity)
    if max_complexity is not None:
        preds.append(F.col(c["complexity"]) <= max_complexity)
    if min_quality_score is not None:
        preds.append(F.col(c["quality"]) >= min_quality_score)
    if date_from is not None:
        preds.append(F.col(c["created_at"]) >= F.lit(date_from))
    if date_to is not None:
        preds.append(F.col(c["created_at"]) <= F.lit(date_to))
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def similarity_threshold(score, threshold: float, strict: bool = True) -> Column:
    """``>`` (basic/enhanced/PoC) or ``>=`` (optimized) threshold."""
    return col_(score) > threshold if strict else col_(score) >= threshold


def keyword_overlap_exists(keywords, query_keywords) -> Column:
    """the row has any keyword among the query keywords."""
    return F.arrays_overlap(col_(keywords), col_(query_keywords))


def complete_document(text, min_chars: int = 100) -> Column:
    """non-empty and longer than ``min_chars``."""
    t = col_(text)
    return t.isNotNull() & (F.length(t) > min_chars)


def ttl_filter(expires_at, as_of) -> Column:
    """F8: live cache entries (``expires_at > as_of``; ``as_of`` is a parameter)."""
    return col_(expires_at) > F.lit(as_of).cast("timestamp_ntz")


def recent_window(ts, as_of, hours: int = 24) -> Column:
    """rows within the last ``hours`` before ``as_of``."""
    return col_(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")


def row_access_filter(rows: DataFrame, entitlements: DataFrame, role: str,
                      on: Sequence[str]) -> DataFrame:
    """keep rows whose ``on`` values are entitled to ``role``.

    A left-semi join against the role's entitlement rows (small, typically
    broadcast by AQE); never duplicates a row.
    """
    ent = entitlements.where(F.col("role") == role).select(*on).distinct()
    return rows.join(ent, list(on), "left_semi")


# ------------------------------------------------------------ query scoring
def keyword_score(keywords, query_keywords) -> Column:
    """Matched keywords / keywords (0 when the row has none)."""
    kw = col_(keywords)
    n = F.size(kw)
    return F.when(n > 0, F.size(F.array_intersect(kw, col_(query_keywords))) / n).otherwise(F.lit(0.0))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 10, alpha: float = L.HYBRID_ALPHA,
                  threshold: float = L.SEMANTIC_THRESHOLD, where: Column | None = None,
                  key_cols: Sequence[str] = ("doc_id", "chunk_id"), tie_cols: Sequence[str] = ("chunk_id",),
                  chunk_vec: str = "embedding", chunk_kw: str = "keywords",
                  importance: str = "importance_score", query_vec: str = "embedding",
                  query_kw: str = "keywords", digits: int = 9,
                  block_bytes: int = DEFAULT_BLOCK_BYTES, group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """R4 (+J2 collapsed): alpha*semantic + (1-alpha)*keyword*0.5 + importance*0.2,
    keep semantic > threshold OR keyword > 0, top-k per query.

    The semantic and keyword parts come from one scan of the chunk table
    (the reference's self-join of the same table becomes one projection);
    ``where`` filters apply to hybrid search as well.
    """
    if where is not None:
        chunks = chunks.where(where)
    w_kw = (1 - alpha) * L.HYBRID_KEYWORD_WEIGHT
    w_imp = L.HYBRID_IMPORTANCE_WEIGHT

    def payload(rows, width):
        qm = vector_matrix(rows["qv"].values, width)
        vocab, indptr, qidx = vocab_index(rows["qk"].values)
        o = np.argsort(qidx, kind="stable")
        asked = padded(qidx[o], np.repeat(np.arange(len(vocab)), np.diff(indptr))[o], len(qm), -1)
        return qm, vocab, indptr, qidx, asked, Screen(qm)

    def padded(rows, terms, n, fill):
        """Terms of ascending rows as the rows of a matrix."""
        size = np.bincount(rows, minlength=n)
        out = np.full((n, size.max(initial=0)), fill, dtype=np.int32)
        out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = terms
        return out

    def keyword_entries(pdf, vocab):
        rows, terms, nkw = [], [], np.zeros(len(pdf))
        for i, kws in enumerate(pdf["_kw"].values):
            if kws is None:
                continue
            nkw[i] = len(kws)
            for w in set(kws):
                j = vocab.get(w)
                if j is not None:
                    rows.append(i)
                    terms.append(j)
        return rows, terms, nkw

    def scorer(pdf, pay):
        qm, vocab, indptr, qidx, _, _ = pay
        n, nq = len(pdf), qm.shape[0]
        sem = np.round(vector_matrix(pdf["_v"].values, qm.shape[1]) @ qm.T, digits)
        rows, terms, nkw = keyword_entries(pdf, vocab)
        matches = expand_matches(np.asarray(rows, dtype=np.int64), np.asarray(terms, dtype=np.int64),
                                 np.ones(len(rows)), indptr, qidx, n, nq)
        with np.errstate(divide="ignore", invalid="ignore"):
            kw = np.where(nkw[:, None] > 0, matches / np.where(nkw > 0, nkw, 1)[:, None], 0.0)
        imp = np.nan_to_num(pdf["_imp"].values.astype(np.float64))
        hyb = np.round(alpha * sem + w_kw * kw + (imp * w_imp)[:, None], digits)
        keep = (sem > threshold) | (kw > 0)
        return hyb, keep, {"semantic_score": sem, "keyword_score": kw, "hybrid_score": hyb}

    def finder(pdf, pay, floor):
        qm, vocab, _, _, asked, screen = pay
        rows, terms, nkw = keyword_entries(pdf, vocab)
        own = padded(np.asarray(rows, dtype=np.int64), np.asarray(terms, dtype=np.int32), len(pdf), -2)
        worth = np.nan_to_num(pdf["_imp"].values.astype(np.float64)) * w_imp
        if own.shape[1] * asked.shape[1] > KEYWORD_PAIRS or not np.abs(worth).max(initial=0) < 1000:
            return None
        some = np.where(nkw > 0, nkw, 1)
        upper = worth + max(w_kw, 0) * np.minimum((own >= 0).sum(axis=1), asked.shape[1]) / some
        spare = 2 * (1 + abs(alpha)) * 10.0 ** -digits
        vectors = vector_matrix(pdf["_v"].values, qm.shape[1])
        hit = run_hits(screen, vectors, upper, alpha, floor - spare, qm)
        if hit is None:
            return None
        r, c, s = hit
        near = alpha * s + upper[r] >= floor[c] - spare
        r, c, s = r[near], c[near], np.round(s[near], digits)
        matches = np.zeros(len(r))
        for x in range(0, len(r), 50_000):
            y = slice(x, x + 50_000)
            matches[y] = (own[r[y]][:, :, None] == asked[c[y]][:, None, :]).sum(axis=(1, 2))
        kw = np.where(nkw[r] > 0, matches / some[r], 0.0)
        hyb = np.round(alpha * s + w_kw * kw + worth[r], digits)
        keep = ((s > threshold) | (kw > 0)) & (hyb >= floor[c])
        return r[keep], c[keep], hyb[keep], {"semantic_score": s[keep], "keyword_score": kw[keep],
                                             "hybrid_score": hyb[keep]}

    src = chunks.withColumn("_v", F.col(chunk_vec)).withColumn("_kw", F.col(chunk_kw)) \
                .withColumn("_imp", F.col(importance).cast("double"))
    outs = [("semantic_score", T.DoubleType()), ("keyword_score", T.DoubleType()),
            ("hybrid_score", T.DoubleType())]
    q = queries.select(F.col("query_id"), F.col(query_vec).alias("qv"), F.col(query_kw).alias("qk"))
    order = [F.col("hybrid_score").desc()] + [F.col(c).asc() for c in tie_cols]
    return scan_topk(src, q, list(key_cols), ["_v", "_kw", "_imp"], payload, scorer, outs, k, order,
                     block_bytes=block_bytes, group_bytes=group_bytes, finder=finder)


def hybrid_candidates(chunks: DataFrame, queries: DataFrame, keyword: DataFrame, k: int = 10,
                      alpha: float = L.HYBRID_ALPHA, threshold: float = L.SEMANTIC_THRESHOLD,
                      importance: str = "importance_score", chunk_vec: str = "embedding",
                      query_vec: str = "embedding", digits: int = 9, block_bytes: int = DEFAULT_BLOCK_BYTES,
                      group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """J2 input: the pairs ``hybrid_left_join`` can choose its top-k from.

    These are each query's k best by semantic score and importance alone among the
    pairs past the threshold, and the pairs of the ``keyword`` table: a keyword score
    only adds, so a pair without one behind k others stays behind them. At most k rows
    a query leave the scan. Returns (query_id, chunk_id, semantic_score, importance).
    """
    def payload(rows, width):
        qm = vector_matrix(rows["qv"].values, width)
        return qm, Screen(qm)

    def scorer(pdf, pay):
        qm, _ = pay
        s = np.round(vector_matrix(pdf["_v"].values, qm.shape[1]) @ qm.T, digits)
        worth = np.nan_to_num(pdf[importance].values.astype(np.float64)) * L.HYBRID_IMPORTANCE_WEIGHT
        return np.round(alpha * s + worth[:, None], digits), s > threshold, {
            "semantic_score": s, "base": np.round(alpha * s + worth[:, None], digits)}

    def finder(pdf, pay, floor):
        qm, screen = pay
        worth = np.nan_to_num(pdf[importance].values.astype(np.float64)) * L.HYBRID_IMPORTANCE_WEIGHT
        if not np.abs(worth).max(initial=0) < 1000:
            return None
        least = alpha * threshold + worth.min(initial=1000) if alpha > 0 else -np.inf    # of what passes the threshold
        hit = run_hits(screen, vector_matrix(pdf["_v"].values, qm.shape[1]), worth, alpha,
                       np.maximum(floor, least) - 2 * (1 + abs(alpha)) * 10.0 ** -digits, qm)
        if hit is None:
            return None
        r, c, s = hit
        s = np.round(s, digits)
        base = np.round(alpha * s + worth[r], digits)
        keep = (s > threshold) & (base >= floor[c])
        return r[keep], c[keep], base[keep], {"semantic_score": s[keep], "base": base[keep]}

    src = chunks.select("chunk_id", importance, F.col(chunk_vec).alias("_v"))
    q = queries.select("query_id", F.col(query_vec).alias("qv"))
    best = scan_topk(src, q, ["chunk_id", importance], ["_v", importance], payload, scorer,
                     [("semantic_score", T.DoubleType()), ("base", T.DoubleType())], k,
                     [F.col("base").desc(), F.col("chunk_id")], block_bytes=block_bytes, group_bytes=group_bytes,
                     finder=finder)
    scored = (keyword.select("query_id", "chunk_id").distinct().join(src, "chunk_id").join(q, "query_id")
              .select("query_id", "chunk_id", importance,
                      F.round(V.cosine_similarity("_v", "qv"), digits).alias("semantic_score")))
    return best.select(scored.columns).unionByName(scored).dropDuplicates(["query_id", "chunk_id"])


def hybrid_left_join(semantic: DataFrame, keyword: DataFrame, k: int = 10, alpha: float = L.HYBRID_ALPHA,
                     threshold: float = L.SEMANTIC_THRESHOLD, on: Sequence[str] = ("query_id", "chunk_id"),
                     importance: str = "importance_score") -> DataFrame:
    """J2 + F5: semantic scores LEFT JOIN externally supplied keyword scores.

    For keyword scores computed elsewhere (one row per (query, chunk) at
    most, so the join cannot fan out); the WHERE keeps
    ``semantic > threshold OR keyword > 0`` with SQL NULL semantics before
    the keyword score is defaulted to 0, then ranks the hybrid score.
    """
    kw = keyword.select(*on, F.col("keyword_score").alias("_kw")).dropDuplicates(list(on))
    j = semantic.join(kw, list(on), "left").where((F.col("semantic_score") > threshold) | (F.col("_kw") > 0))
    hyb = (alpha * F.col("semantic_score") + (1 - alpha) * L.HYBRID_KEYWORD_WEIGHT * F.coalesce("_kw", F.lit(0.0))
           + F.col(importance) * L.HYBRID_IMPORTANCE_WEIGHT)
    out = j.withColumn("keyword_score", F.coalesce("_kw", F.lit(0.0))).withColumn("hybrid_score", F.round(hyb, 9)) \
           .drop("_kw")
    w = Window.partitionBy("query_id").orderBy(F.col("hybrid_score").desc(), F.col("chunk_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_tokens(text) -> Column:
    """BM25 terms as a Column: lower-cased Unicode word tokens."""
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(WORD_RE), 0)


_TERM_RE = __import__("re").compile(r"\w+")


def py_terms(text):
    """BM25 terms inside Arrow tasks (same word-character rule)."""
    return _TERM_RE.findall(text.lower()) if text else []


def term_counts(chunks: DataFrame, key_cols: Sequence[str], text_col: str = "chunk_text") -> DataFrame:
    """V4 index: every chunk's distinct terms with their frequencies and its length in terms.

    The one tokenising pass over a corpus (in Arrow tasks, ~4x cheaper than the JVM regex)."""
    src = chunks.select(*key_cols, F.col(text_col).alias("_txt"))
    fields = [f for f in src.schema.fields if f.name != "_txt"]
    schema = T.StructType(fields + [T.StructField("terms", T.ArrayType(T.StringType())),
                                    T.StructField("tfs", T.ArrayType(T.IntegerType())),
                                    T.StructField("dl", T.LongType())])

    def count(batches):
        for batch in batches:
            counts, lengths = [], []
            for text in batch.column("_txt").to_pylist():
                tokens = py_terms(text)
                counts.append(Counter(tokens))
                lengths.append(len(tokens))
            ends = np.cumsum([0] + [len(c) for c in counts]).astype(np.int32)
            terms = pa.array([w for c in counts for w in c], pa.string())
            tfs = pa.array([n for c in counts for n in c.values()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.ListArray.from_arrays(ends, terms),
                                                          pa.ListArray.from_arrays(ends, tfs), pa.array(lengths, pa.int64())],
                [f.name for f in fields] + ["terms", "tfs", "dl"])
    return src.mapInArrow(count, schema)


def query_weights(counted: DataFrame, queries: DataFrame, n_chunks: int, query_text: str = "query_text") -> DataFrame:
    """(query_id, terms, idfs): the distinct terms of each query with their inverse document
    frequencies over ``counted``. Only the queries' terms are counted, by a join that AQE
    broadcasts when they are few; the vocabulary never reaches the driver."""
    q = queries.select("query_id", F.col(query_text).alias("qt"))
    schema = T.StructType([q.schema["query_id"], T.StructField("term", T.StringType())])

    def split(batches):
        for pdf in batches:
            found = [(i, w) for i, text in zip(pdf["query_id"], pdf["qt"]) for w in sorted(set(py_terms(text)))]
            yield pd.DataFrame(found, columns=["query_id", "term"])
    pairs = q.mapInPandas(split, schema)
    df = (counted.select(F.explode("terms").alias("term")).join(pairs.select("term").distinct(), "term", "left_semi")
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    d = F.coalesce(F.col("df"), F.lit(0))
    idf = F.log((F.lit(n_chunks) - d + 0.5) / (d + 0.5) + 1)
    weighted = pairs.join(df, "term", "left").select("query_id", F.struct("term", idf.alias("idf")).alias("w"))
    return weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("w")).alias("w")).select(
        "query_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"))


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 10,
                k1: float = L.BM25_K1, b: float = L.BM25_B,
                key_cols: Sequence[str] = ("doc_id", "chunk_id"), tie_cols: Sequence[str] = ("chunk_id",),
                text_col: str = "chunk_text", query_text: str = "query_text",
                digits: int = 9, where: Column | None = None, index: DataFrame | None = None,
                block_bytes: int = DEFAULT_BLOCK_BYTES, group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """V4: Okapi BM25 ranking of chunks for a batch of text queries.

    The corpus is tokenised once, into ``index`` (``term_counts``, written as a table
    unless given); document frequencies and scores come from there. Every task sums
    the term weights of its chunks for each query of a block (inverted index of the
    block's terms) and keeps its top-k per query.
    """
    spark = chunks.sparkSession
    if index is None:
        path = scratch_path(spark, f"terms-{uuid.uuid4().hex}")
        term_counts(chunks if where is None else chunks.where(where), key_cols, text_col).write.parquet(path)
        index = spark.read.parquet(path)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    avgdl = float(size["avgdl"] or 1.0)

    def payload(rows, width):
        vocab, indptr, qidx = vocab_index(rows["terms"].values)
        idf = np.zeros(len(vocab))
        for terms, idfs in zip(rows["terms"].values, rows["idfs"].values):
            for term, x in zip(terms, idfs):
                idf[vocab[term]] = x
        asked = np.diff(indptr) if len(vocab) else np.zeros(0, np.int64)
        often = np.argsort(-asked, kind="stable")[:OFTEN_TERMS]
        often = often[asked[often] > max(len(rows) / 32, 30)]
        column = np.full(len(vocab), -1)
        column[often] = np.arange(len(often))
        asks = np.zeros((len(often), len(rows)))
        for i, term in enumerate(often):
            asks[i, qidx[indptr[term]:indptr[term + 1]]] = 1
        o = np.argsort(qidx, kind="stable")    # each query's terms
        own = np.repeat(np.arange(len(vocab)), asked)[o]
        several = {int(j): qidx[indptr[j]:indptr[j + 1]] for j in np.flatnonzero((asked > ASKED_OFTEN) & (column < 0))}
        return (vocab, indptr, qidx, idf, len(rows), column, asks, own, np.bincount(qidx, minlength=len(rows)), several,
                Screen(asks.T))

    def entries(pdf, pay):
        """Row, term and weight of what the queries ask for."""
        vocab, idf = pay[0], pay[3]
        sizes = [len(x) for x in pdf["terms"].values]
        row = np.repeat(np.arange(len(pdf)), sizes)
        found = np.fromiter(map(vocab.get, chain.from_iterable(pdf["terms"].values), repeat(-1)), np.int64, len(row))
        tf = np.concatenate([*pdf["tfs"].values, np.empty(0)]).astype(np.float64)
        here = found >= 0
        row, found, tf = row[here], found[here], tf[here]
        dl = pdf["dl"].to_numpy(dtype=np.float64)[row]
        return row, found, (tf * (k1 + 1)) / (tf + k1 * ((1 - b) + b * dl / avgdl)) * idf[found]

    def scorer(pdf, pay):
        vocab, indptr, qidx, idf, nq, column, asks = pay[:7]
        row, found, w = entries(pdf, pay)
        dense = column[found] >= 0             # terms of many queries as a matrix product
        weights = np.zeros((len(pdf), len(asks)))
        weights[row[dense], column[found[dense]]] = w[dense]
        s = expand_matches(row[~dense], found[~dense], w[~dense], indptr, qidx, len(pdf), nq)
        s = np.round(s + weights @ asks if len(asks) else s, digits)
        return s, s > 0, {"score": s}

    def finder(pdf, pay, floor):
        vocab, indptr, qidx, _, nq, column, asks, own, asked, several, screen = pay
        row, found, w = entries(pdf, pay)
        if not w.min(initial=1) > 0:
            return None
        dense = column[found] >= 0
        weights = np.zeros((len(pdf), len(asks)))
        weights[row[dense], column[found[dense]]] = w[dense]
        rare = np.flatnonzero(~dense)
        count = indptr[found[rare] + 1] - indptr[found[rare]]
        many, few = rare[count > ASKED_OFTEN], rare[count <= ASKED_OFTEN]
        starts = np.searchsorted(row[many], np.arange(len(pdf) + 1)), np.searchsorted(row[few], np.arange(len(pdf) + 1))

        def add_rare(near, a, z):
            e = many[starts[0][a]:starts[0][z]]
            for i, j, x in zip((row[e] - a).tolist(), found[e].tolist(), w[e].tolist()):
                near[i][several[j]] += x
            e = few[starts[1][a]:starts[1][z]]
            times = indptr[found[e] + 1] - indptr[found[e]]
            at = np.repeat(indptr[found[e]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            np.add.at(near.reshape(-1), np.repeat((row[e] - a) * nq, times) + qidx[at],
                      np.repeat(w[e], times).astype(np.float32))

        # weights are positive: sums are right but for a share of themselves
        low = np.maximum(floor - 10.0 ** -digits, w.min(initial=1) / 2)
        hit = screen.hits(weights, 0, low, 1 / 32, low * (2 + asked / 64), add_rare)
        if hit is None:
            return None
        r, c = hit
        held = row * len(vocab) + found        # (row, term) as one number, to look the queries' terms up
        o = np.argsort(held)
        held, w = held[o], w[o]
        first = np.cumsum(asked) - asked
        s = np.zeros(len(r))
        for x in range(0, len(r), 50_000):
            rr, cc = r[x:x + 50_000], c[x:x + 50_000]
            times = asked[cc]
            at = np.repeat(first[cc] - np.cumsum(times) + times, times) + np.arange(times.sum())
            want = np.repeat(rr * len(vocab), times) + own[at]
            place = np.minimum(np.searchsorted(held, want), len(held) - 1)
            s[x:x + 50_000] = np.bincount(np.repeat(np.arange(len(rr)), times), np.where(held[place] == want, w[place], 0),
                                          minlength=len(rr))
        s = np.round(s, digits)
        keep = (s > 0) & (s >= floor[c])
        return r[keep], c[keep], s[keep], {"score": s[keep]}

    order = [F.col("score").desc()] + [F.col(c).asc() for c in tie_cols]
    return scan_topk(index, query_weights(index, queries, int(size["n"]), query_text), list(key_cols),
                     ["terms", "tfs", "dl"], payload, scorer, [("score", T.DoubleType())], k, order,
                     block_bytes=block_bytes, group_bytes=group_bytes, finder=finder)


# ------------------------------------------------------- result processing
def rerank(results: DataFrame, scores: DataFrame, top_k: int = 5, scored: int | None = None,
           on: Sequence[str] = ("query_id", "chunk_id")) -> DataFrame:
    """Attach external relevance scores (0 if missing; with ``scored`` only to
    so many first results), order by score desc keeping the prior order for ties, cut.

    ``results`` carries ``rank``; ``scores`` has ``on`` + ``rerank_score``.
    """
    j = results.join(scores.select(*on, "rerank_score"), list(on), "left")
    score = F.coalesce(F.col("rerank_score"), F.lit(0.0))
    if scored is not None:
        score = F.when(F.col("rank") <= scored, score).otherwise(F.lit(0.0))
    j = j.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank").asc())
    return j.withColumn("prior_rank", F.col("rank")).withColumn("rank", F.row_number().over(w)) \
            .where(F.col("rank") <= top_k)


def context_assembly(results: DataFrame, texts: DataFrame, n: int = 3, sep: str = "\n\n",
                     on: str = "chunk_id", text_col: str = "chunk_text") -> DataFrame:
    """The first ``n`` result texts of each query joined by ``sep``.

    The per-query results (queries x n rows) are joined without a hint: AQE broadcasts
    them while they are small, so that the chunk table is only scanned.
    """
    top = results.where(F.col("rank") <= n).select("query_id", "rank", on)
    j = texts.select(on, text_col).join(top, on)
    g = j.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", text_col))).alias("_r"))
    return g.select("query_id", F.array_join(F.transform("_r", lambda x: x[text_col]), sep).alias("context"),
                    F.size("_r").cast("long").alias("n_context"))


def top_importance(chunks: DataFrame, where: Column, n: int = 10,
                   order: str = "importance_score", tie: str = "chunk_id") -> DataFrame:
    """Filter, order by importance, limit (TakeOrderedAndProject)."""
    return chunks.where(where).orderBy(F.col(order).desc(), F.col(tie).asc()).limit(n)


def random_sample(df: DataFrame, n: int, seed: int = 42, key: str = "chunk_id") -> DataFrame:
    """Reproducible sample of ``n`` rows: order by md5(key:seed), take
    ``n`` (TakeOrderedAndProject -- a per-task top-n, then one merge).
    md5 makes the sample identical in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)


def response_record(results: DataFrame, search_type: str,
                    fields: Sequence[str] = ("rank", "chunk_id", "score")) -> DataFrame:
    """One typed record per query: num_results, search_type, results."""
    g = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("results"))
    return g.select("query_id", F.size("results").cast("long").alias("num_results"),
                    F.lit(search_type).alias("search_type"), "results")


def result_jaccard(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Per query, |A n B| / |A u B| of two systems' result id sets
    (0 when either side is empty)."""
    sa = a.groupBy("query_id").agg(F.collect_set(key).alias("_a"))
    sb = b.groupBy("query_id").agg(F.collect_set(key).alias("_b"))
    j = sa.join(sb, "query_id", "full_outer")
    ea = F.coalesce(F.col("_a"), F.array().cast("array<string>"))
    eb = F.coalesce(F.col("_b"), F.array().cast("array<string>"))
    inter = F.size(F.array_intersect(ea, eb))
    union = F.size(F.array_union(ea, eb))
    return j.select("query_id", F.when((F.size(ea) == 0) | (F.size(eb) == 0), F.lit(0.0))
                    .otherwise(inter / union).alias("jaccard"))


def dedup_chunks(chunks: DataFrame, hash_col: str = "chunk_hash",
                 order: Sequence[str] = ("doc_id", "chunk_index")) -> DataFrame:
    """Keep the first chunk of every content hash.

    A shuffle on the hash; a hash held by a third of all rows is still one
    group, but only one row per group survives a partial (map-side) first
    pick: min over a struct of (order keys, row) is an ordinary aggregate
    with map-side combine, so no group is materialised in one task.
    """
    cols = [c for c in chunks.columns if c != hash_col]
    best = chunks.groupBy(hash_col).agg(F.min(F.struct(*[F.col(c) for c in order],
                                                       *[F.col(c).alias(f"_v_{c}") for c in cols])).alias("_m"))
    return best.select(F.col(hash_col), *[F.col(f"_m._v_{c}").alias(c) for c in cols])


def distinct_values(df: DataFrame, by: str, col: str) -> DataFrame:
    """Sorted set of values per group."""
    return df.groupBy(by).agg(F.sort_array(F.collect_set(col)).alias(f"{col}_set"))


def not_yet_migrated(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is already in the checkpoint table."""
    return source.join(done.select(key), key, "left_anti")


def store_completeness(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source vs target distinct counts and the number of missing ids."""
    s = source.select(key).distinct()
    t = target.select(key).distinct()
    missing = s.join(t, key, "left_anti")
    a = s.agg(F.count(F.lit(1)).alias("source_count"))
    b = t.agg(F.count(F.lit(1)).alias("target_count"))
    c = missing.agg(F.count(F.lit(1)).alias("missing_count"))
    return a.crossJoin(b).crossJoin(c).withColumn(
        "complete", F.col("missing_count") == 0)
