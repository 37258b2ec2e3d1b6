"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import frozen


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    ``edges`` has two columns of one orderable type. Every round contracts stars
    with map-side combined minima, so no neighbourhood is gathered, and cuts the
    lineage with a reliable checkpoint. The rounds needed grow with the logarithm
    of the longest chain; an error is raised rather than a partial result given.
    """
    a, b = edges.columns
    now = frozen(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        now = frozen(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
