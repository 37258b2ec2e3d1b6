"""Cache replay, streaming vs batch, writers, planning edge rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.operators import embed as EM
from ragloom.operators import planning as P
from ragloom.operators import querylog as Q
from ragloom.session import scratch_path
from ragloom.sinks import writers as K
from ragloom.sources import documents as D
from ragloom.streaming import streams as ST


def py_replay(rows, ttl=dt.timedelta(hours=24)):
    out, state = {}, {}
    for eid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start = state.get(key)
        if start is None or ts >= start + ttl:
            state[key] = ts
            out[eid] = (False, ts)
        else:
            out[eid] = (True, start)
    return out


def test_cache_replay_matches_loop_with_hot_key(spark):
    random.seed(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = 0 if i % 3 == 0 else random.randint(1, 20)      # one key holds a third of all rows
        rows.append((i, key, t0 + dt.timedelta(minutes=random.randint(0, 60 * 24 * 6))))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r.event_id: (r.hit, r.entry_start) for r in Q.cache_replay(df, F.col("user_id")).collect()}
    want = py_replay([(e, str(k), ts) for e, k, ts in rows])
    assert got == want


def test_a_hot_key_is_replayed_slice_by_slice(spark):
    random.seed(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else random.choice(["a", "b", None])
        step = random.choice([random.randint(0, 4000), random.randint(0, 40) * 24 * 60])   # ties and gaps of a TTL
        rows.append((i, key, t0 + dt.timedelta(minutes=step)))
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz")
    want = py_replay([(e, str(k), ts) for e, k, ts in rows])
    for slices, hours in ((1, 24), (40, 24), (40, 1), (300, 300)):
        want = py_replay([(e, str(k), ts) for e, k, ts in rows], dt.timedelta(hours=hours))
        out = Q.cache_replay(df, F.col("user_id"), slices=slices, ttl_hours=hours)
        assert {r.event_id: (r.hit, r.entry_start) for r in out.collect()} == want
    per_task = out.where("query_key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 50 and max(r["count"] for r in per_task) < 200
    timeless = Q.cache_replay(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")), F.col("user_id")).collect()
    assert [(r.hit, r.entry_start) for r in timeless] == [(False, None)]
    assert Q.cache_replay(df.limit(0), F.col("user_id")).collect() == []


def test_slice_transition_by_trying_every_entry():
    for seed in range(60):
        random.seed(seed)
        ttl = random.randint(1, 30)
        times = np.sort(np.array([random.randint(100, 100 + 4 * ttl) for _ in range(random.randint(1, 30))]))
        thresholds, ends = Q.slice_transition(times, ttl)
        for entry in range(int(times[0]) - ttl - 3, int(times[0]) + 1):
            expected = int(Q._entries(times, entry, ttl)[-1])
            at = int(np.searchsorted(thresholds, entry + ttl))
            assert (int(ends[at]) if at < len(ends) else entry) == expected


def test_cache_lookup_boundary(spark):
    cache = spark.createDataFrame([("h1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)),
                                   ("h2", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))],
                                  "query_hash string, created_at timestamp_ntz, expires_at timestamp_ntz")
    qs = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "query_hash string")
    got = {r.query_hash: r.hit for r in Q.cache_lookup(qs, cache, "2024-01-02 00:00:00").collect()}
    assert got == {"h1": False, "h2": True, "h3": False}     # expires_at == now is expired


def test_stream_metrics_equal_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {r.window_start: (r.queries, r.max_ms) for r in ST.query_metrics(ev).collect()}
    src = scratch_path(spark, "events-stream")
    ev.repartition(4).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.query_metrics(stream).writeStream.format("memory").queryName("qm_test").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.window_start: (r.queries, r.max_ms) for r in spark.table("qm_test").collect()}
    assert got == batch


def test_stream_dedup_late_duplicate(spark):
    path = scratch_path(spark, "dedup-test")
    rows = [("h1", dt.datetime(2024, 1, 1, 0, 0)), ("h1", dt.datetime(2024, 1, 1, 0, 10)),
            ("h2", dt.datetime(2024, 1, 1, 5, 0)), ("h1", dt.datetime(2024, 1, 1, 9, 0))]
    spark.createDataFrame(rows, "chunk_hash string, published_at timestamp_ntz").coalesce(1) \
         .write.mode("overwrite").json(path)
    schema = T.StructType([T.StructField("chunk_hash", T.StringType()), T.StructField("published_at", T.TimestampNTZType())])
    s = ST.dedup_stream(spark.readStream.schema(schema).json(path), delay="1 hour")
    q = s.writeStream.format("memory").queryName("dd_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.chunk_hash for r in spark.table("dd_test").collect())
    assert got.count("h2") == 1 and 1 <= got.count("h1") <= 2


def test_late_rows_are_kept_in_a_table(spark, tmp_path):
    schema = "chunk_hash string, published_at timestamp_ntz, n int"
    at = dt.datetime(2024, 1, 1)
    hours = [[("a", 0, 1), ("a", 0, 2), ("b", 1, 3)], [("a", 2, 4), ("c", 30, 5)], [("b", 3, 6), ("c", 31, 7), ("d", 20, 8)],
             [("a", 33, 9), (None, 33, 10), ("e", None, 11)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for rows in hours:
        made = [(k, None if h is None else at + dt.timedelta(hours=h), n) for k, h, n in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept, late, marks = ST.run_dedup(stream, str(tmp_path / "out"), delay="24 hours")
    # Behind 30 h the watermark is 6 h: hour 3 is late; behind 31 h hour 20 is not. "a" of hour 0 is forgotten by 33 h.
    assert sorted(r.n for r in late.collect()) == [6, 11]
    assert sorted((r.n for r in kept.collect())) in ([1, 3, 5, 8, 9, 10], [2, 3, 5, 8, 9, 10])
    total = marks.agg(*[F.sum(c).alias(c) for c in ("seen", "kept", "late", "repeated")]).first()
    assert tuple(total) == (11, 6, 2, 3) and marks.count() == 4


def test_each_text_is_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]
    rows = [(i, ["hot", f"t{i % 7}", "", None, "bad"][i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, chunk_text string").withColumn("embed_status_", F.lit(1)).repartition(4)
    store = str(tmp_path / "store")

    def run(name, frame):
        before = calls.value
        out = EM.embed_stored(frame, store, name, embedder=embedder, batch_size=1, hot=10, salts=4)
        got = {r.id: (r.embedding, r.embed_status) for r in out.collect()}
        return got, calls.value - before
    got, n = run("r1", df)
    assert len(got) == 200 and n == 8 + 2              # 8 good texts; the bad one alone and again
    assert got[0] == ([3.0, 1.0], "ok") and got[2] == got[3] == (None, "empty") and got[4] == (None, "failed")
    again, n = run("r2", df)
    assert again == got and n == 2                     # only what failed
    more, n = run("r3", df.unionByName(spark.createDataFrame([(999, "new", 1)], df.schema)))
    assert n == 3 and more[999] == ([3.0, 1.0], "ok")


def test_evolve_schema_adds_nulls(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, summary string")
    out = K.evolve_schema(df, {"summary": T.StringType(), "importance_score": T.DoubleType()})
    assert out.columns == ["doc_id", "summary", "importance_score"]
    assert out.first().importance_score is None


def test_normalize_both_spellings(spark):
    a = spark.createDataFrame([("d1", "t", "manual", "fab1")], "document_id string, content string, "
                                                               "document_type string, facility string")
    b = spark.createDataFrame([("d2", "u", None, None)], "id string, content string, doc_type string, facility_code string")
    n = {r.document_id: r for r in D.normalize_documents(a.unionByName(b, allowMissingColumns=True)).collect()}
    assert n["d1"].document_type == "manual" and n["d2"].document_type == "general"
    assert n["d2"].facility == "unknown" and n["d2"].source == "manual_upload" and n["d2"].version == "1.0"


def test_complexity_cuts(spark):
    rows = [("s1", 1000, 10.0, ["a"], False, 0), ("s2", 5000, 10.0, ["a"], False, 0),
            ("s3", 10001, 10001.0, ["a", "b", "c", "d", "e", "f"], True, 60000)]
    inv = spark.createDataFrame(rows, "store_id string, document_count long, total_size_mb double, "
                                      "document_types array<string>, custom_schema boolean, api_usage_monthly long")
    got = {r.store_id: r.migration_complexity for r in P.migration_complexity(inv).collect()}
    assert got == {"s1": "low", "s2": "low", "s3": "very_high"}
    t = {r.store_id: r.migration_hours for r in P.migration_time(P.migration_complexity(inv)).collect()}
    assert t["s3"] == 48 * 1.5                    # the > 10,000 branch stays unreachable


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k").sample(0.5, seed=3)
    idx = [r.row_index for r in D.dense_index(df, ["k"], partitions=7).orderBy("k").collect()]
    assert idx == list(range(len(idx)))
