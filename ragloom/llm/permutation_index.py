"""Nearest neighbours by a permutation index.

A vector is represented by the order of its angle to a fixed set of pivots. It is
posted in the inverted files of its nearest pivots; a query opens the files of its
own nearest pivots, ranks what it finds by footrule distance (summed differences of
ranks over the query's nearest pivots), and reranks the best share of each file by
the exact measure.

Files have about one length, so there are more of them for more vectors and a query
opens a falling share of all postings. The largest inner product may be that of a
longer vector at a wider angle: vectors are filed by bands of their norm, and a query
searches every band by angle. Queries that come back with too few rows open further
files in rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import frozen


@dataclass(frozen=True)
class Settings:
    """Pivots are fitted on a bounded sample: the ``pivots`` vectors of smallest id hash,
    repeats left out. Every vector is posted in ``posted`` files of about ``file`` vectors; of n
    files a query opens ``probed`` times the root of n, ranks by its ``ranked`` nearest of the
    first ``rank_pivots`` pivots and reranks the best ``share`` of a file, ``least`` vectors
    at the least. Norms of a band differ by the factor ``band``. Files are dealt in blocks of
    ``block`` vectors and ``query_block`` queries, so a crowded pivot is many tasks."""
    pivots: int = 4096
    posted: int = 8
    file: int = 1024
    probed: float = 2.0
    rank_pivots: int = 256
    ranked: int = 64
    share: float = 0.15
    least: int = 128
    band: float = 1.1
    block: int = 8192
    query_block: int = 1024

    def files(self, vectors: int, pivots: int) -> int:
        """Files of a band of so many vectors."""
        return max(1, min(pivots, math.ceil(vectors * self.posted / self.file)))

    def opened(self, files: int, round_: int) -> int:
        return min(files, math.ceil(self.probed * math.sqrt(files)) * 4 ** round_)


def usable(vector: Column) -> Column:
    """Vectors that take part: finite in all components and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def pick_pivots(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """Unit pivots from the bounded sample (id, vector); fewer if there are fewer distinct ones."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.pivots).select("vector").toPandas()["vector"]
    if not len(sample):
        return np.empty((0, 0))
    distinct = np.array(list(dict.fromkeys(tuple(v) for v in sample)), dtype=np.float64)
    return _units(distinct)[0]


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaled first, so that no square overflows or vanishes."""
    most = np.abs(vectors).max(axis=1)
    scaled = vectors / most[:, None]
    norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return scaled / norms[:, None], np.log(norms) + np.log(most)


def _orders(units: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` pivots of smallest angle, nearest first, ties to the smaller pivot."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :count]


def _bands(lengths: np.ndarray, settings: Settings) -> np.ndarray:
    """Bands of log norms; the middle of a band is a power of ``band``."""
    return np.floor(lengths / math.log(settings.band) + 0.5).astype(np.int64)


_ROW = "file long, id long, vector array<double>"
#: A band's files are numbered from band * SPACING.
SPACING = 1 << 20


def _posted(vectors: DataFrame, shared, name: str, round_: int = 0) -> DataFrame:
    """One row per vector and file: its own band's files, or the files that a query opens in all bands."""
    pivots, files, settings = shared

    def post(batches):
        for batch in batches:
            if not len(batch):
                continue
            units, lengths = _units(np.stack(batch["vector"]).astype(np.float64))
            band = _bands(lengths, settings)
            near = _orders(units, pivots.value, len(pivots.value))
            for one, count in files.value.items():
                here = np.flatnonzero(band == one) if name == "file" else np.arange(len(batch))
                width = min(settings.posted, count) if name == "file" else settings.opened(count, round_)
                if not len(here):
                    continue
                # The nearest of the band's pivots, which are the first ones.
                own = near[here]
                own = own[own < count].reshape(len(here), count)[:, :width]
                row = np.repeat(here, width)
                yield pd.DataFrame({"file": one * SPACING + own.ravel(), "id": batch["id"].to_numpy()[row],
                                    "vector": batch["vector"].to_numpy()[row]})

    return vectors.select("id", "vector").mapInPandas(post, _ROW).withColumn("side", F.lit(name))


def _search(shared, k: int):
    pivots, _, settings = shared

    def search(group: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        asks = group[group["side"] == "query"]
        file = group[group["side"] == "file"].sort_values("id", kind="stable")
        if not len(asks) or not len(file):
            return empty
        q, v = (np.stack(x["vector"]).astype(np.float64) for x in (asks, file))
        ids = file["id"].to_numpy()
        ranking = pivots.value[:settings.rank_pivots]
        # A row per pivot, and sums as narrow as they can be: both are read fastest so.
        places = np.argsort(_orders(_units(v)[0], ranking, len(ranking)), axis=1).T.astype(np.int16, order="C")
        near = _orders(_units(q)[0], ranking, settings.ranked)
        own_ranks = np.arange(near.shape[1], dtype=np.int16)[:, None]
        narrow = np.int16 if len(ranking) * near.shape[1] < 1 << 15 else np.int32
        depth = max(settings.least, k, int(np.ceil(settings.share * len(v))))
        found = []
        for one, query in enumerate(asks["id"].to_numpy()):
            footrule = np.abs(places[near[one]] - own_ranks).sum(axis=0, dtype=narrow)
            others = np.flatnonzero(ids != query)
            if not len(others):
                continue
            footrule = footrule[others]
            within = np.partition(footrule, depth - 1)[depth - 1] if depth < len(others) else footrule.max()
            chosen = others[footrule <= within]
            # Equal vectors must score equally, so every score is summed by itself.
            score = (v[chosen] * q[one]).sum(axis=1)
            if len(chosen) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                chosen, score = chosen[score >= cut], score[score >= cut]
            best = np.lexsort((ids[chosen], -score))[:k]
            found.append(pd.DataFrame({"query_id": query, "vec_id": ids[chosen][best], "score": score[best]}))
        return pd.concat(found) if found else empty

    return search


def _round(files: DataFrame, asks: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, vec_id, score) found in the files that the queries open."""
    settings = shared[2]

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("file").agg(F.ceil(F.count("*") / size).alias(name))

    # Block counts per file: a table with a row per file.
    deal = F.broadcast(parts(files, settings.block, "file_parts").join(
        parts(asks, settings.query_block, "query_parts"), "file"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own))
        return rows.join(deal, "file").select(
            "file", "side", "id", "vector", mine.alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))

    groups = dealt(files, "file_parts", "query_parts").unionByName(dealt(asks, "query_parts", "file_parts"))
    return groups.groupBy("file", "file_parts", "query_parts").applyInPandas(
        _search(shared, k), "query_id long, vec_id long, score double").distinct()


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank, vec_id, score.

    Nearness is the largest inner product in double precision, ties go to the
    smaller id, and a query's own id is no candidate. Rows that ``usable`` refuses,
    that have no id, or whose vector has another length than most (of equally common
    lengths the smaller) take no part; rows repeating an id count once per distinct
    vector, and an empty table gives no rows. Every query gets ``k`` rows if there are so
    many candidates: while some have fewer, they open four times as many files.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"),
                            F.col(vector_col).cast("array<double>").alias("vector"),
                            is_query.alias("asks"))
    source = source.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    common = source.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    source = frozen(source.filter(F.col("size") == common["size"]).drop("size"))
    pivots = pick_pivots(source, settings)

    @F.pandas_udf("long")
    def band(vector: pd.Series) -> pd.Series:
        return pd.Series(_bands(_units(np.stack(vector).astype(np.float64))[1], settings))

    # Doubles have some 6,000 bands at most.
    sizes = {r["band"]: r["count"] for r in source.groupBy(band("vector").alias("band")).count().collect()}
    context = spark.sparkContext
    shared = (context.broadcast(pivots), context.broadcast(
        {b: settings.files(n, len(pivots)) for b, n in sizes.items()}), settings)
    files = _posted(source, shared, "file")
    asking = source.filter("asks")
    most = max(shared[1].value.values())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits, round_ = None, 0
    while True:
        found = _round(files, _posted(asking, shared, "query", round_), shared, k)
        ranked = (found if hits is None else hits.unionByName(found).distinct()).withColumn(
            "rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = frozen(ranked.select("query_id", "rank", "vec_id", "score"))
        if settings.opened(most, round_) == most:
            return ranked
        full = ranked.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
        asking = asking.join(full, "id", "left_anti")
        if asking.isEmpty():
            return ranked
        hits, round_ = ranked.drop("rank"), round_ + 1
