"""Approximate vector search with an inverted-file index (V7).

Build: k-means (``pyspark.ml.clustering.KMeans``, fixed seed) on
all L2-normalised vectors, then every chunk gets its nearest centroid (``model.transform``, JVM side). Or with centroids that are
given, such as the mean vector of each class (``mean_centroids``, ``assign_lists``).
Written partitioned by that ``ivf_list`` column, a search reads only the
probed lists (partition pruning).

Search: the first round scores every row of the lists nearest to a query, which
gives each query a k-th score. On unit vectors no row of a list can be closer
to a query than the list's centroid by more than the list's radius (the largest angle
between the centroid and a row), so a second round reads just the lists whose
bound reaches the k-th score, and the result is the exact top-k. Rows are only scored
against the queries that read their list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..session import cut_lineage
from .vector_search import (DEFAULT_BLOCK_BYTES, DEFAULT_GROUP_BYTES, Screen, finish_topk, pair_products, scan_topk,
                            vector_matrix)


def ivf_build(chunks: DataFrame, n_lists: int = 16, vec_col: str = "embedding", seed: int = 42,
              max_iter: int = 20):
    """Returns (centroids as a numpy matrix, chunks with ``ivf_list``).

    k-means runs on all vectors, as a distributed job at every size."""
    norm = chunks.withColumn("_nv", array_to_vector(l2_normalize(vec_col)))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="_nv",
                   predictionCol="ivf_list").fit(norm.where(F.col("_nv").isNotNull()))
    cents = np.array([c for c in model.clusterCenters()], dtype=np.float64)
    nrm = np.linalg.norm(cents, axis=1, keepdims=True)
    cents = cents / np.where(nrm > 0, nrm, 1)
    assigned = model.transform(norm.where(F.col("_nv").isNotNull())).drop("_nv")
    return cents, assigned


def mean_centroids(vectors: DataFrame, by: str, vec_col: str = "embedding") -> np.ndarray:
    """Unit mean vector of every class of ``by``, in class order.

    Averaged as a distributed aggregate; classes x dimensions numbers are fetched,
    so ``by`` has to be a column of few classes. NULL vectors take no part."""
    parts = vectors.where(F.col(by).isNotNull()).select(by, F.posexplode(l2_normalize(vec_col)).alias("at", "x"))
    means = parts.groupBy(by, "at").agg(F.avg("x").alias("x")).toPandas()
    cents = means.pivot(index=by, columns="at", values="x").sort_index().to_numpy(dtype=np.float64)
    nrm = np.linalg.norm(cents, axis=1, keepdims=True)
    return cents / np.where(nrm > 0, nrm, 1)


def assign_lists(chunks: DataFrame, centroids: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """Chunks with ``ivf_list``, the first of their nearest given centroids; those without a
    vector are in no list."""
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(vector_matrix(v.values, centroids.shape[1]) @ centroids.T, axis=1))

    return chunks.where(F.col(vec_col).isNotNull()).withColumn("ivf_list", nearest(vec_col))


def ivf_write_index(assigned: DataFrame, path: str) -> DataFrame:
    """Persist the index partitioned by list under a shared path and read
    it back: later searches prune to the probed lists (partition filter on
    ``ivf_list``), and the k-means lineage is cut."""
    assigned.write.mode("overwrite").partitionBy("ivf_list").parquet(path)
    return assigned.sparkSession.read.parquet(path)


def list_radii(indexed: DataFrame, centroids: np.ndarray, vec_col: str = "embedding") -> np.ndarray:
    """Largest angle between each centroid and a row of its list (one number a list)."""
    @F.pandas_udf("double")
    def closeness(v: pd.Series, own: pd.Series) -> pd.Series:
        rows = vector_matrix(v.values, centroids.shape[1])
        return pd.Series(np.einsum("ij,ij->i", rows, centroids[own.to_numpy(dtype=np.int64)]))

    found = indexed.select("ivf_list", closeness(vec_col, "ivf_list").alias("c")).groupBy("ivf_list").agg(
        F.min("c").alias("c")).collect()
    radii = np.zeros(len(centroids))
    for r in found:
        radii[int(r["ivf_list"])] = np.arccos(np.clip(r["c"], -1, 1)) + _SLACK
    return radii


#: Angles and scores are rounded; bounds are widened by more than that.
_SLACK = 1e-6


def ivf_search(indexed: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 5,
               nprobe: int = 4, threshold: float = 0.3, key_cols=("chunk_id",), vec_col: str = "embedding",
               query_vec: str = "embedding", digits: int = 9, exact: bool = True,
               block_bytes: int = DEFAULT_BLOCK_BYTES, group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """Top-k per query above ``threshold``: the exact ones, or with ``exact=False`` those
    among its ``nprobe`` nearest lists."""
    src = indexed.withColumn("_v", F.col(vec_col))
    order = [F.col("score").desc()] + [F.col(c).asc() for c in key_cols]
    q = queries.select("query_id", F.col(query_vec).alias("qv"))

    def nearest(qm):
        near = np.argsort(-(qm @ centroids.T), axis=1, kind="stable")[:, :nprobe]
        read = np.zeros((len(centroids), len(qm)), dtype=bool)
        read[near.T, np.arange(len(qm))] = True
        return read

    def scorer(pdf, pay):
        qm, read, least, _ = pay
        s = np.round(vector_matrix(pdf["_v"].values, centroids.shape[1]) @ qm.T, digits)
        return s, (s > threshold) & (s >= least) & read[pdf["ivf_list"].to_numpy(dtype=np.int64)], {"score": s}

    def finder(pdf, pay, floor):
        """The rows of each list against the queries that read it."""
        qm, read, least, screens = pay
        vectors, own = vector_matrix(pdf["_v"].values, centroids.shape[1]), pdf["ivf_list"].to_numpy(dtype=np.int64)
        floor = np.maximum(floor, least)
        rows, asking = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.unique(own):
            if x not in screens:
                reading = np.flatnonzero(read[x])
                screens[x] = reading, Screen(qm[reading])
            reading, screen = screens[x]
            at = np.flatnonzero(own == x)
            hit = screen.hits(vectors[at], 0, np.maximum(floor[reading], threshold) - 10.0 ** -digits)
            if hit is None:
                return None
            rows.append(at[hit[0]])
            asking.append(reading[hit[1]])
        r, c = np.concatenate(rows), np.concatenate(asking)
        s = np.round(pair_products(vectors, r, qm, c), digits)
        keep = (s > threshold) & (s >= floor[c])
        return r[keep], c[keep], s[keep], {"score": s[keep]}

    def round_(rows: DataFrame, payload) -> DataFrame:
        return scan_topk(src, rows, list(key_cols), ["_v", "ivf_list"], payload, scorer,
                         [("score", T.DoubleType())], k, order,
                         pruned=lambda pay: F.col("ivf_list").isin(np.flatnonzero(pay[1].any(axis=1)).tolist()),
                         block_bytes=block_bytes, group_bytes=group_bytes, fold=True, finder=finder, near=["ivf_list"])

    def first(rows, width):
        qm = vector_matrix(rows["qv"].values, centroids.shape[1])
        return qm, nearest(qm), np.full(len(qm), -np.inf), {}

    found = round_(q, first)
    if not exact:
        return found
    found = cut_lineage(found)
    radii = list_radii(indexed, centroids, vec_col)

    def second(rows, width):
        qm = vector_matrix(rows["qv"].values, centroids.shape[1])
        angle = np.arccos(np.clip(centroids @ qm.T, -1, 1))
        most = np.cos(np.clip(angle - radii[:, None], 0, np.pi))
        least = rows["least"].to_numpy(dtype=np.float64)
        return qm, (most >= least[None, :] - _SLACK) & ~nearest(qm), least, {}

    kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    open_ = q.join(kth, "query_id", "left").select("query_id", "qv", F.coalesce("_kth", F.lit(float(threshold))).alias("least"))
    both = found.drop("rank").unionByName(round_(open_, second).drop("rank"))
    return finish_topk(both, k, order)


def recall_at_k(approx: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Per query |approx n exact| / |exact| (queries with exact results)."""
    e = exact.groupBy("query_id").agg(F.collect_set(key).alias("_e"))
    a = approx.groupBy("query_id").agg(F.collect_set(key).alias("_a"))
    j = e.join(a, "query_id", "left")
    return j.select("query_id", (F.size(F.array_intersect("_e", F.coalesce("_a", F.array().cast("array<string>"))))
                                 / F.size("_e")).alias("recall"))
