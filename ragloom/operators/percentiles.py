"""Exact percentiles of groups of any size, by refining histograms.

Ranks are looked for in a histogram of at most some 700,000 buckets a group (steps of
0.2 % of the value), then in one of at most 2^20 equal steps inside the bucket that
holds the rank, then among the values of that step, of which doubles have at most
2^23. No state holds the distinct values of a group, and every pass is a partial
aggregation: a group with most of the rows costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_

STEPS_A_LOG = 512
STEPS_A_BUCKET = 1 << 20


def _coarse(v: Column) -> Column:
    """Bucket in the order of values: steps of the logarithm; infinite and NaN ones apart."""
    steps = F.floor(F.signum(v) * F.log1p(F.abs(v)) * STEPS_A_LOG)
    return (F.when(F.isnan(v), F.lit(1 << 41)).when(v == float("inf"), F.lit(1 << 40))
            .when(v == float("-inf"), F.lit(-(1 << 40))).otherwise(steps)).cast("long")


def _fine(v: Column, low: Column, high: Column) -> Column:
    """Step within a bucket whose values reach from ``low`` to ``high``."""
    share = (v - low) / (high - low)
    return F.when(high > low, F.floor(share * STEPS_A_BUCKET)).otherwise(F.lit(0)).cast("long")


def _matched(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on null-safe names; columns of ``left`` win."""
    renamed = right.select(*[F.col(n).alias(f"_{n}") if n in names else F.col(n) for n in right.columns])
    on = reduce(lambda x, y: x & y, (left[n].eqNullSafe(renamed[f"_{n}"]) for n in names))
    return left.join(renamed, on).drop(*[f"_{n}" for n in names])


def _before(counts: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Histogram rows with the number of values before their bucket in the group."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _within(rows: DataFrame) -> DataFrame:
    """Rows whose bucket holds their rank, the rank counted from the bucket's start."""
    return (rows.where("rank >= before and rank < before + n")
            .withColumn("rank", F.col("rank") - F.col("before")).drop("before", "n"))


def _percentiles(rows: DataFrame, group: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """One row a group that has values; ``rows`` has the group's columns and ``v``."""
    real = rows.where("v is not null").withColumn("c", _coarse(F.col("v")))
    coarse = real.groupBy(*group, "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    total = F.sum("n").over(Window.partitionBy(*group))
    # Each percentile lies between two ranks, which may be one.
    exact = [(name, F.lit(float(p)) * (F.col("total") - 1)) for name, p in wanted.items()]
    ends = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (at - F.floor(at)).alias("share"),
                 F.least(F.floor(at) + side, F.col("total") - 1).alias("rank"))
        for name, at in exact for side in (0, 1)]))
    in_bucket = _within(_before(coarse.withColumn("total", total), group, "c")
                        .select(*group, "c", "low", "high", "n", "before", ends.alias("e"))
                        .select(*group, "c", "low", "high", "n", "before", "e.*"))
    stepped = _matched(real, in_bucket.select(*group, "c", "low", "high").distinct(), [*group, "c"]).withColumn(
        "f", _fine(F.col("v"), F.col("low"), F.col("high"))).drop("low", "high")
    fine = _before(stepped.groupBy(*group, "c", "f").agg(F.count("*").alias("n")), [*group, "c"], "f")
    in_step = _within(_matched(fine, in_bucket.drop("low", "high"), [*group, "c"]))
    values = _matched(stepped, in_step.select(*group, "c", "f").distinct(), [*group, "c", "f"]).groupBy(
        *group, "c", "f", "v").agg(F.count("*").alias("n"))
    found = _within(_matched(_before(values, [*group, "c", "f"], "v"), in_step, [*group, "c", "f"]))

    def between(name: str) -> Column:
        own = F.col("name") == name
        low, high = F.min(F.when(own, F.col("v"))), F.max(F.when(own, F.col("v")))
        share = F.max(F.when(own, F.col("share")))
        # Ranks that meet give one value; no difference of infinite ones is taken.
        return F.when((low == high) | (share == 0), low).otherwise(low + share * (high - low)).alias(name)

    return found.groupBy(*group).agg(*[between(n) for n in wanted])


def _grouped(df: DataFrame, by: Sequence[str], value) -> tuple[list[str], DataFrame]:
    group = [f"g{i}" for i in range(len(by))] or ["g0"]
    keys = [F.col(b).alias(g) for b, g in zip(by, group)] or [F.lit(0).alias("g0")]
    return group, df.select(*keys, col_(value).cast("double").alias("v"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value, wanted: Mapping[str, float]) -> DataFrame:
    """One row a group of ``by`` (null groups too) with a column for each of ``wanted``
    (name -> share): percentiles with linear interpolation, null where no value is.

    Null values do not count. ``by`` may be empty (one row) and names columns of ``df``.
    """
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select(F.lit(0).alias("_one"))
    return with_percentiles(groups, df, by, value, wanted).select(*by, *wanted)


def with_percentiles(stats: DataFrame, df: DataFrame, by: Sequence[str], value, wanted: Mapping[str, float]) -> DataFrame:
    """``stats``, one row a group, with the percentiles of ``df`` beside."""
    group, rows = _grouped(df, by, value)
    found = _percentiles(rows, group, wanted)
    if not by:
        return stats.join(found.drop("g0"), F.lit(True), "left")  # one row each
    found = found.select(*[F.col(g).alias(f"_{g}") for g in group], *wanted)
    on = reduce(lambda x, y: x & y, (stats[b].eqNullSafe(found[f"_{g}"]) for b, g in zip(by, group)))
    return stats.join(found, on, "left").select(*stats.columns, *wanted)
