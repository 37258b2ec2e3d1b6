"""Query cache and log on the fixture log (``events``: user_id = query key)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import querylog as Q
from ..operators import stats as A
from .common import register

AS_OF = "2024-01-30 00:00:00"

REPLAY_SQL = """
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS k, ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
rep(k, n, event_id, ts, value, entry_start, hit) AS (
  SELECT k, n, event_id, ts, value, ts, FALSE FROM ev WHERE n = 1
  UNION ALL
  SELECT e.k, e.n, e.event_id, e.ts, e.value,
         CASE WHEN e.ts >= r.entry_start + INTERVAL 24 HOUR THEN e.ts ELSE r.entry_start END,
         e.ts < r.entry_start + INTERVAL 24 HOUR
  FROM rep r JOIN ev e ON e.k = r.k AND e.n = r.n + 1)"""


def _replay(t):
    return Q.cache_replay(t.events, F.col("user_id"))


@register("cache_replay", REPLAY_SQL + """
SELECT event_id, k AS query_key, hit, entry_start FROM rep""")
def cache_replay(t):
    """Q5: which logged queries a 24 h TTL cache would have served."""
    return _replay(t).select("event_id", "query_key", "hit", "entry_start")


@register("cache_hit_update", REPLAY_SQL + """
SELECT k AS query_key, entry_start, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hit_count,
       CAST(count(*) AS BIGINT) AS lookups FROM rep GROUP BY k, entry_start""")
def cache_hit_update(t):
    """Q3: per cache entry hit counts as an aggregate of append-only hits."""
    return Q.cache_hit_counts(_replay(t))


@register("cache_effect", REPLAY_SQL + """
SELECT round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, round(avg(CASE WHEN hit THEN value END), 6) AS cached_ms,
       round(avg(CASE WHEN NOT hit THEN value END), 6) AS first_ms,
       round(coalesce(avg(CASE WHEN NOT hit THEN value END) / avg(CASE WHEN hit THEN value END), 0.0), 6) AS speedup
FROM rep""")
def cache_effect(t):
    """Hit rate, mean served/missed time, speed-up, from the replay."""
    rep = _replay(t).join(t.events.select("event_id", "value"), "event_id")
    r = A.cache_effect(rep)
    return r.select(*[F.round(c, 6).alias(c) for c in ("hit_rate", "cached_ms", "first_ms", "speedup")])


@register("cache_lookup", f"""
WITH live AS (SELECT md5(CAST(user_id AS VARCHAR)) AS query_hash, max(ts) AS cached_at
              FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND ts + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}'
              GROUP BY 1),
q AS (SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR)) AS query_hash FROM events)
SELECT q.user_id, live.cached_at, live.cached_at IS NOT NULL AS hit FROM q LEFT JOIN live USING (query_hash)""")
def cache_lookup(t):
    """Q1 + Q2 + P3 + F8: every query key looked up at as_of against the
    entries written by the log (TTL 24 h)."""
    ev = t.events
    cache = Q.cache_store(ev, [F.col("user_id")])
    qs = ev.select("user_id").distinct().withColumn("query_hash", F.md5(F.col("user_id").cast("string")))
    r = Q.cache_lookup(qs, cache, AS_OF)
    return r.select("user_id", "cached_at", "hit")


@register("log_query", """
SELECT md5(CAST(user_id AS VARCHAR) || CAST(ts AS VARCHAR)) AS query_id, CAST(user_id AS VARCHAR) AS query_text,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS results_count, value AS response_time_ms
FROM events WHERE event_type <> 'error'""")
def log_query(t):
    """Q4: analytics rows of the answered queries."""
    ev = t.events.where(F.col("event_type") != "error") \
                 .withColumn("q", F.col("user_id").cast("string")) \
                 .withColumn("k", F.get_json_object("props", "$.k"))
    r = Q.log_query(ev, "q", "ts", "k", "value")
    return r.select("query_id", "query_text", "results_count", "response_time_ms")
