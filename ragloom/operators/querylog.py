"""Query cache and query log as tables (Q1-Q5, A18 input).

The cache is data: entries (query_hash, created_at, expires_at), lookups
are joins, hit counts are aggregates over an append-only hit table, and
``cache_replay`` recomputes which logged queries would have been served
from a TTL cache.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import cut_lineage


def cache_store(results: DataFrame, key_cols, ts: str = "ts", ttl_hours: int = 24) -> DataFrame:
    """Q2: cache rows for query results; expiry = time + TTL (time is a
    column of the input, never the wall clock)."""
    return results.select(X.query_hash(*key_cols).alias("query_hash"), F.col(ts).alias("created_at"),
                          (F.col(ts) + F.expr(f"INTERVAL {int(ttl_hours)} HOURS")).alias("expires_at"),
                          F.lit(0).cast("long").alias("hit_count"))


def cache_lookup(queries: DataFrame, cache: DataFrame, as_of, key: str = "query_hash") -> DataFrame:
    """Q1: hit/miss of a batch of queries against the entries live at
    ``as_of`` (created before, expiring after). The live cache is reduced
    to one row per key before the join, so a key never fans out."""
    at = F.lit(as_of).cast("timestamp_ntz")
    live = cache.where((F.col("created_at") <= at) & (F.col("expires_at") > at)) \
                .groupBy(key).agg(F.max("created_at").alias("cached_at"), F.max("expires_at").alias("expires_at"))
    return queries.join(live, key, "left").withColumn("hit", F.col("cached_at").isNotNull())


def cache_hit_counts(replayed: DataFrame, key: str = "query_key") -> DataFrame:
    """Q3: hit counts per cache entry from the append-only replay rows
    (instead of UPDATE ... SET hit_count = hit_count + 1)."""
    return replayed.groupBy(key, "entry_start").agg(
        F.sum(F.col("hit").cast("int")).cast("long").alias("hit_count"),
        F.count(F.lit(1)).alias("lookups"))


def log_query(results: DataFrame, text: str, ts: str, results_count: str, ms: str) -> DataFrame:
    """Q4: analytics rows for answered queries (id = md5(text + time))."""
    return results.select(X.query_id(text, ts).alias("query_id"), F.col(text).alias("query_text"),
                          F.col(results_count).cast("long").alias("results_count"),
                          F.col(ms).cast("double").alias("response_time_ms"), F.col(ts).alias("created_at"))


REPLAY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("query_key", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("hit", T.BooleanType()),
    T.StructField("entry_start", T.TimestampNTZType())])


def _runs(keys: np.ndarray) -> Iterator[tuple[object, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield keys[a], a, b


def _entries(times: np.ndarray, start: int | None, ttl: int) -> np.ndarray:
    """Start of the cache entry that each lookup of one key meets or makes.

    ``start``: the entry the key has before, if any. From entry to entry by search."""
    out = np.empty_like(times)
    at = 0
    if start is not None:
        at = int(np.searchsorted(times, start + ttl))
        out[:at] = start
    while at < len(times):
        after = int(np.searchsorted(times, times[at] + ttl))
        out[at:after] = times[at]
        at = after
    return out


def slice_transition(times: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a slice of a key's history does to an entry made before it.

    Returns thresholds and last entries: an entry that ends at x leaves the slice as
    the last entry of the first threshold >= x; behind the last threshold it stays.
    Only lookups up to one TTL after the slice began, and the next one, can be the first
    miss. Entries are followed to the last one by doubling pointers.
    """
    n = len(times)
    following = np.append(np.searchsorted(times, times + ttl), n)
    last = np.append(np.arange(n), -1)
    jump = following
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[np.minimum(jump, n - 1)], last)
        jump = np.where(jump < n, jump[jump], n)
    reach = min(n, int(np.searchsorted(times, times[0] + ttl)) + 1)
    end = times[last[:reach]]
    # Neighbours with one last entry are one threshold: the later one's.
    kept = np.append(end[1:] != end[:-1], True)
    return times[:reach][kept], end[kept]


def cache_replay(log: DataFrame, key, ts: str = "ts", order: str = "event_id", ttl_hours: int = 24,
                 slices: int | None = None) -> DataFrame:
    """Q5: replay a query log through a TTL cache whose entries live
    ``ttl_hours`` from the miss that created them.

    A lookup's outcome depends on the key's entry before it, but a key's history is
    not replayed in one task: the log is range-partitioned by key and time into
    ``slices`` (default: the shuffle partitions), so a hot key has many. Each slice of
    a key that goes on from the partition before states, as a short table, which entry
    it ends with for every entry it may begin with; these tables are composed key by key,
    and every partition is then replayed on its own from the entry it begins with.
    Lookups without a key form a key; those without a time come first and are misses.
    """
    spark = log.sparkSession
    ttl = ttl_hours * 3_600_000_000
    src = log.select(F.col(order).cast("long").alias("event_id"), X.col_(key).cast("string").alias("query_key"),
                     F.col(ts).cast("timestamp_ntz").alias("ts"))
    known = src.where("ts is not null")
    dealt = (known.withColumn("at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))
             .withColumn("k", F.coalesce(F.concat(F.lit("="), "query_key"), F.lit(""))))
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the borders of ranges are sampled, and two passes have to agree on them.
    sorted_log = cut_lineage(dealt.repartitionByRange(parts, "k", "ts", "event_id")
                             .sortWithinPartitions("k", "ts", "event_id"))

    def transitions(batches: Iterator[pd.DataFrame]):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        first, now, held = None, None, []

        def table():
            times, ends = slice_transition(np.concatenate(held), ttl)
            return pd.DataFrame({"k": [now], "part": [part], "leads": [first == now],
                                 "times": [times.tobytes()], "ends": [ends.tobytes()]})
        for pdf in batches:
            at = pdf["at"].to_numpy()
            for k, a, b in _runs(pdf["k"].to_numpy()):
                first = k if first is None else first
                if k != now:
                    if now == first and held:
                        yield table()
                    now, held = k, []
                held.append(at[a:b])
        if held:
            yield table()

    def compose(batches: Iterator[pd.DataFrame]):
        now, entry = None, None
        for pdf in batches:
            starts = []
            for k, times, ends in zip(pdf["k"], pdf["times"], pdf["ends"]):
                if k != now:
                    now, entry = k, None
                starts.append(entry)
                times, ends = np.frombuffer(times, np.int64), np.frombuffer(ends, np.int64)
                at = 0 if entry is None else int(np.searchsorted(times, entry + ttl))
                entry = int(ends[at]) if at < len(ends) else entry
            yield pd.DataFrame({"part": pdf["part"], "entry": pd.array(starts, dtype="Int64"), "leads": pdf["leads"]})

    tables = sorted_log.mapInPandas(transitions, "k string, part int, leads boolean, times binary, ends binary")
    begin = (tables.repartition("k").sortWithinPartitions("k", "part")
             .mapInPandas(compose, "part int, entry long, leads boolean").where("leads and entry is not null"))
    # At most one row a partition.
    entry_of = {r["part"]: r["entry"] for r in begin.select("part", "entry").collect()}

    def replay(batches: Iterator[pd.DataFrame]):
        from pyspark import TaskContext
        now, entry = None, entry_of.get(TaskContext.get().partitionId())
        for pdf in batches:
            at = pdf["at"].to_numpy()
            starts = np.empty_like(at)
            hit = np.ones(len(at), dtype=bool)
            for k, a, b in _runs(pdf["k"].to_numpy()):
                if now is not None and k != now:
                    entry = None
                now, before = k, entry
                starts[a:b] = _entries(at[a:b], entry, ttl)
                # The first lookup that meets a new entry made it.
                made = np.append(True if before is None else starts[a] != before, starts[a + 1:b] != starts[a:b - 1])
                hit[a:b] = ~made
                entry = int(starts[b - 1])
            out = pdf[["event_id", "query_key", "ts"]].copy()
            out["hit"] = hit
            out["entry_start"] = pd.Series(starts, index=pdf.index).astype("datetime64[us]")
            yield out

    timeless = src.where("ts is null").select("event_id", "query_key", "ts", F.lit(False).alias("hit"),
                                              F.col("ts").alias("entry_start"))
    return sorted_log.mapInPandas(replay, REPLAY_SCHEMA).unionByName(timeless)
