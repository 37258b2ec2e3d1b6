"""A table in hash buckets, of which a change rewrites only those it touches.

``folder/data/change=<id>/bucket=<b>`` holds the rows that one change gave one bucket,
``folder/manifest/generation=<n>`` one small file that says which change every
bucket's rows are from. A change writes its buckets first and its generation last;
readers take the last whole generation, so they see all of a change or nothing.
Ordinary Parquet written by Spark; the layout has to be on storage all executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_MANIFEST = "bucket int, change string, by string, buckets int, key string, columns string"
_BUCKET = StructField("bucket", IntegerType())


@dataclass(frozen=True)
class Layout:
    """One generation: ``held`` maps a bucket to the change that wrote its rows."""
    generation: int
    key: str
    buckets: int
    columns: str
    changes: frozenset[str]
    held: dict[int, str]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def layout(spark: SparkSession, folder: str) -> Layout | None:
    """The last generation; None for a folder without any.

    A manifest has one row a bucket, a number fixed when the table was made."""
    try:
        rows = spark.read.schema(f"{_MANIFEST}, generation int").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.agg(F.max("generation")).first()[0]
    if last is None:
        return None
    changes = frozenset(r["by"] for r in rows.select("by").distinct().toLocalIterator())
    now = rows.where(F.col("generation") == last).collect()
    return Layout(last, now[0]["key"], now[0]["buckets"], now[0]["columns"], changes,
                  {r["bucket"]: r["change"] for r in now if r["change"] is not None})


def _read(spark: SparkSession, folder: str, at: Layout, only: set[int] | None = None) -> DataFrame:
    """Rows of all buckets, or of ``only`` some, with their bucket."""
    paths = [f"{folder}/data/change={change}/bucket={b}" for b, change in sorted(at.held.items())
             if only is None or b in only]
    schema = StructType.fromJson(json.loads(at.columns))
    if not paths:
        return spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
    whole = StructType([*schema.fields, StructField("change", StringType()), _BUCKET])
    return spark.read.schema(whole).option("basePath", f"{folder}/data").parquet(*paths).drop("change")


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the last generation. What was read stays readable: changes only add files."""
    at = layout(spark, folder)
    if at is None:
        raise FileNotFoundError(f"no table at {folder}")
    return _read(spark, folder, at).drop("bucket")


def _publish(spark: SparkSession, folder: str, change: str, at: Layout, rows: DataFrame | None, touched: set[int]) -> None:
    """Write ``rows`` of the touched buckets, then the next generation."""
    filled: set[int] = set()
    if rows is not None and touched:
        path = f"{folder}/data/change={change}"
        placed = rows.withColumn("bucket", _bucket(at.key, at.buckets))
        # A bucket that is far larger than others is written by several tasks.
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = StructType([*StructType.fromJson(json.loads(at.columns)).fields, _BUCKET])
        filled = {r["bucket"] for r in spark.read.schema(written).parquet(path).select("bucket").distinct().collect()}
    held = {b: c for b, c in at.held.items() if b not in touched} | dict.fromkeys(filled, change)
    manifest = [(b, held.get(b), change, at.buckets, at.key, at.columns) for b in range(at.buckets)]
    (spark.createDataFrame(manifest, _MANIFEST).coalesce(1)
     .write.parquet(f"{folder}/manifest/generation={at.generation + 1}"))


def create_table(rows: DataFrame, folder: str, key: str = "doc_id", buckets: int = 256, change: str = "create") -> None:
    """Deal ``rows`` by their key into ``buckets``; does nothing if the table is there."""
    spark = rows.sparkSession
    if layout(spark, folder) is not None:
        return
    empty = Layout(-1, key, buckets, rows.schema.json(), frozenset(), {})
    _publish(spark, folder, change, empty, rows, set(range(buckets)))


def _change(spark: SparkSession, folder: str, change: str, keys: DataFrame, only_known: bool,
            rebuild: Callable[[DataFrame], DataFrame]) -> set[int]:
    """Rebuild the buckets of ``keys``; returns the buckets written, none if done before.

    ``only_known``: keys that no row has leave their bucket alone.
    """
    at = layout(spark, folder)
    if at is None:
        raise FileNotFoundError(f"no table at {folder}")
    if change in at.changes:
        return set()
    named = keys.select(at.key).distinct()
    touched = {r["b"] for r in named.select(_bucket(at.key, at.buckets).alias("b")).distinct().collect()}
    if only_known:
        here = _read(spark, folder, at, touched).select(at.key, "bucket").join(named, at.key, "left_semi")
        touched = {r["bucket"] for r in here.select("bucket").distinct().collect()}
    rebuilt = rebuild(_read(spark, folder, at, touched).drop("bucket"))
    columns = StructType.fromJson(json.loads(at.columns)).fieldNames()
    _publish(spark, folder, change, at, rebuilt.select(*columns), touched)
    return touched


def delete_keys(spark: SparkSession, folder: str, deleted: DataFrame, change: str) -> set[int]:
    """H13 as a write: drop the rows whose key is in ``deleted``; returns the buckets written.

    ``change`` names the deletion: an attempt that failed anywhere is repeated under
    its name, a repetition after success does nothing. One writer at a time; a second
    one that meets a generation taken meanwhile fails and is repeated.
    """
    def rest(rows):
        return rows.join(deleted.select(layout(spark, folder).key).distinct(), layout(spark, folder).key, "left_anti")
    return _change(spark, folder, change, deleted, True, rest)


def upsert_rows(spark: SparkSession, folder: str, new: DataFrame, keys: DataFrame, change: str) -> set[int]:
    """H14 as a write: rows of ``keys`` go, ``new`` ones (of those keys) come; as ``delete_keys``."""
    def replaced(rows):
        key = layout(spark, folder).key
        return rows.join(keys.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    return _change(spark, folder, change, keys, False, replaced)
