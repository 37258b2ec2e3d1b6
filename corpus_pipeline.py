"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept
and is written and read again in between. All but the last return the columns of
documents, whatever the names of further ones.

Null texts count as empty: the quality rules reject them, like empty ones. Texts of
any length are judged, compared and packed whole. Repeated rows stay or go together
up to ``near_duplicates``, which keeps one of them; rows without an id stay there. An
empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import combination_join, compression, language, packing
from ragloom.session import discard, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and compress like prose; null and empty texts go."""
    return compression.keep_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; learnt from the labels of what came in. Texts without
    letters go; without any label all others stay."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.
    The smallest id stays, with all its different texts; rows without an id stay."""
    near = combination_join.Settings(words=5, percent=80, extension=0.05)
    return combination_join.keep_one_per_component(docs, settings=near)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token windows; every id of a document is in exactly one piece."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id),
          ("near_duplicates", near_duplicates), ("pack_windows", pack_windows)]

#: SQL has no zstandard, no BPE and no expectation-maximisation; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared checkpoint folder.

    A stage's table is removed once the next stage's is whole; the last one stays, as the
    result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return docs
