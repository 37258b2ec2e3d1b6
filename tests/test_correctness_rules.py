"""Results that hold on inputs the fixtures do not have."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import chunking as C
from ragloom.operators import migrate as M
from ragloom.operators.vector_search import vector_matrix
from ragloom.sinks import writers as K
from ragloom.sources.documents import dense_index, generate_documents


def test_dense_index_with_payload_and_many_partitions(spark):
    df = spark.range(0, 200_000, 1, 7).select(
        ((F.col("id") * 7919) % 200_000).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = dense_index(df, ["k"], "i", partitions=6)
    row = got.agg(F.countDistinct("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"),
                  F.sum((F.col("i") != F.col("k")).cast("int")).alias("wrong")).first()
    assert tuple(row) == (200_000, 0, 199_999, 0)


def test_generated_documents_use_every_template(spark):
    templates = spark.range(30).select(F.col("id").alias("template_order"), F.concat(F.lit("t"), "id").alias("template"))
    got = generate_documents(spark.range(90).select(F.col("id").alias("i")), templates)
    assert got.groupBy("content").count().filter("count = 3").count() == 30


def test_non_finite_vectors_are_zero_rows():
    m = vector_matrix([[1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [0.0, 2.0]], 2)
    assert np.array_equal(m, [[1, 0], [0, 0], [0, 0], [0, 0], [0, 1]])


def greedy_sentences(sentences, size, overlap):
    """The rule told one sentence at a time."""
    chunks = []
    for s in sentences:
        if chunks and sum(map(len, chunks[-1])) + len(s) <= size:
            chunks[-1].append(s)
        else:
            chunks.append([chunks[-1][-1], s] if chunks and overlap else [s])
    return [(" ".join(c), len(c)) for c in chunks]


def test_sentence_packing_by_running_sums():
    rng = random.Random(4)
    for _ in range(500):
        text = " ".join("x" * rng.randint(1, 12) + rng.choice(".!?") for _ in range(rng.randint(1, 30)))
        for overlap in (0, 3):
            assert C.py_sentence_pack(text, 25, overlap) == greedy_sentences(text.split(" "), 25, overlap)


def test_boundary_windows_advance():
    text = ("word " * 9 + "end. ") * 400
    spans = C.boundary_spans(text, 1000, 400)
    assert all(b[0] > a[0] + 100 for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(text)
    with pytest.raises(ValueError):
        C.chunk_boundary(None, sizes=[("x", 1000, 600)])


def test_separator_texts_cover_the_words():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["aa", "b. ", "\n\n", "\n", ", ", "cccc"]) for _ in range(rng.randint(0, 80)))
        pieces = C.separator_split(text, 20, 5, ["\n\n", "\n", ". ", ", ", ""])
        assert all(len(p) <= 20 for p in pieces)
        at = 0
        for p in pieces:  # in order, and nothing but separators' blanks between them
            found = text.find(p, max(0, at - 20))
            assert found >= 0
            at = found + len(p)


def test_incremental_migration_survives_a_failed_attempt(spark, tmp_path):
    target, marks = f"file://{tmp_path}/target", f"file://{tmp_path}/marks"
    source = spark.range(5).withColumnRenamed("id", "doc_id")

    def broken(docs):
        docs.write.parquet(f"{target}/batch_id=a")
        raise InterruptedError

    with pytest.raises(InterruptedError):
        M.incremental_migration(spark, source, broken, target, marks, "a")
    grown = spark.range(8).withColumnRenamed("id", "doc_id")
    assert M.incremental_migration(spark, grown, lambda d: d, target, marks, "a") == 5
    assert M.incremental_migration(spark, grown, lambda d: d, target, marks, "a") == 5
    assert M.incremental_migration(spark, grown, lambda d: d, target, marks, "b") == 3
    rows = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    assert rows == [(i, "a") for i in range(5)] + [(i, "b") for i in range(5, 8)]


def test_a_table_is_staged_then_swapped(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "v0"))
    spark.sql(f"CREATE TABLE swap_test USING parquet LOCATION '{tmp_path}/v0'")
    try:
        fewer = M.delete_documents(spark.table("swap_test"), spark.range(3).withColumnRenamed("id", "doc_id"))
        broken = fewer.withColumn("doc_id", F.when(F.col("doc_id") < 8, F.col("doc_id")).otherwise(
            F.raise_error(F.lit("lost"))).cast("long"))
        with pytest.raises(Exception, match="lost"):
            M.replace_table(broken, "swap_test", str(tmp_path / "v1"))
        assert spark.table("swap_test").count() == 10
        for _ in range(2):  # the retry, and a repetition after the swap
            M.replace_table(fewer, "swap_test", str(tmp_path / "v1"))
            assert sorted(r.doc_id for r in spark.table("swap_test").collect()) == list(range(3, 10))
    finally:
        spark.sql("DROP TABLE swap_test")


def test_a_hot_day_is_several_sorted_files(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 10 > 0, "2024-01-01").otherwise(F.concat(F.lit("2024-02-0"), F.col("id") % 7 + 1)).alias("day"),
        F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        K.append_chunks(rows, str(tmp_path / "t"), day_col="day", cluster=("doc_id",))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "day=2024-01-01").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000
