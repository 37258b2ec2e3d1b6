"""Exact percentiles by histograms, and tables of which a change rewrites few buckets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import migrate as M
from ragloom.operators.percentiles import exact_percentiles
from ragloom.sinks import buckets

WANTED = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_percentiles_equal_interpolation(spark):
    rng = random.Random(2)
    groups = {"ties": [5.0] * 40 + [6.0] * 3, "one": [7.25], "wide": [rng.lognormvariate(0, 40) for _ in range(300)],
              "signs": [rng.uniform(-1e-3, 1e-3) for _ in range(251)] + [0.0, -0.0], "close": [1e6 + i * 1e-9 for i in range(99)],
              None: [float(i) for i in range(11)], "hot": [rng.gauss(100, 5) for _ in range(6000)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, v double").withColumn("g0", F.lit(1)).repartition(6)
    got = {r["kind"]: r for r in exact_percentiles(df, ["kind"], "v", WANTED).collect()}
    assert set(got) == set(groups) | {"empty"}
    assert all(got["empty"][n] is None for n in WANTED)
    for g, values in groups.items():
        for name, p in WANTED.items():
            assert got[g][name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-300), (g, name)


def test_percentiles_without_groups_and_odd_values(spark):
    inf = math.inf
    df = spark.createDataFrame([(x,) for x in (-inf, 1.0, 2.0, inf, math.nan)], "v double")
    r = exact_percentiles(df, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}).collect()
    assert len(r) == 1 and (r[0]["a"], r[0]["b"], r[0]["c"], r[0]["d"]) == (-inf, 1.0, 2.0, inf)
    assert math.isnan(r[0]["e"])
    none = exact_percentiles(df.limit(0), [], "v", {"p": 0.5}).collect()
    assert [x["p"] for x in none] == [None]
    assert exact_percentiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"p": 0.5}).collect() == []


def test_no_map_of_values_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = exact_percentiles(df, ["k"], "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan and "ObjectHashAggregate" not in plan


def files(folder):
    return {str(p) for p in folder.glob("data/**/*.parquet")}


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(2000).select((F.col("id") % 400).alias("doc_id"), F.col("id").cast("string").alias("text"))
    buckets.create_table(rows, folder, buckets=32)
    before = files(tmp_path / "t")
    gone = spark.createDataFrame([(3,), (77,), (9999,)], "doc_id long")
    touched = buckets.delete_keys(spark, folder, gone, "d1")
    assert len(touched) == 2 and buckets.delete_keys(spark, folder, gone, "d1") == set()
    written = files(tmp_path / "t") - before
    assert before <= files(tmp_path / "t") and {p.split("bucket=")[1].split("/")[0] for p in written} == {str(b) for b in touched}
    left = buckets.read_table(spark, folder)
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(tuple, left.collect())) == sorted((i % 400, str(i)) for i in range(2000) if i % 400 not in (3, 77))
    new = spark.createDataFrame([("fresh", 5), ("more", 5), ("born", 4000)], "text string, doc_id long")
    buckets.upsert_rows(spark, folder, new, new, "u1")
    got = {(r.doc_id, r.text) for r in buckets.read_table(spark, folder).collect()}
    assert {t for d, t in got if d == 5} == {"fresh", "more"} and (4000, "born") in got and len(got) == 2000 - 10 - 5 + 3


def test_readers_see_all_of_a_change_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    buckets.create_table(rows, folder, buckets=8)
    broken = spark.range(50).select(F.when(F.col("id") < 45, F.col("id")).otherwise(
        F.raise_error(F.lit("lost"))).cast("long").alias("doc_id"))
    with pytest.raises(Exception, match="lost"):
        buckets.upsert_rows(spark, folder, broken, spark.range(50).withColumnRenamed("id", "doc_id"), "u")
    old = buckets.read_table(spark, folder)
    assert old.count() == 100
    # The attempt left files behind; its repetition counts them for nothing.
    buckets.upsert_rows(spark, folder, spark.range(3).withColumnRenamed("id", "doc_id"),
                        spark.range(50).withColumnRenamed("id", "doc_id"), "u")
    assert buckets.read_table(spark, folder).count() == 53 and old.count() == 100
    buckets.delete_keys(spark, folder, rows, "all")
    assert buckets.read_table(spark, folder).collect() == []
    buckets.upsert_rows(spark, folder, rows, rows, "again")
    assert buckets.read_table(spark, folder).count() == 100


def test_a_late_batch_takes_no_ids_of_an_open_one(spark, tmp_path):
    target, marks = str(tmp_path / "target"), str(tmp_path / "marks")

    def fails(docs):
        raise InterruptedError
    with pytest.raises(InterruptedError):
        M.incremental_migration(spark, spark.range(5).withColumnRenamed("id", "doc_id"), fails, target, marks, "b1")
    grown = spark.range(8).withColumnRenamed("id", "doc_id")
    assert M.incremental_migration(spark, grown, lambda d: d, target, marks, "b2") == 3
    assert M.incremental_migration(spark, grown, lambda d: d, target, marks, "b1") == 5
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == list(range(8))


def test_a_second_change_at_a_location_in_use_is_an_error(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "v0"))
    spark.sql(f"CREATE TABLE swap_again USING parquet LOCATION '{tmp_path}/v0'")
    try:
        M.replace_table(spark.range(4), "swap_again", str(tmp_path / "v1"), "first")
        M.replace_table(spark.range(4), "swap_again", str(tmp_path / "v1"), "first")
        with pytest.raises(ValueError, match="in use"):
            M.replace_table(spark.range(2), "swap_again", str(tmp_path / "v1"), "second")
        assert spark.table("swap_again").count() == 4
    finally:
        spark.sql("DROP TABLE swap_again")
