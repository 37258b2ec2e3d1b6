"""Aggregations over the fixture chunk table and the query log.

Query log mapping: ``events`` rows are logged queries -- ``value`` the
response time in ms, ``event_type`` the category, ``user_id`` the query
key, ``props.k`` the result count; ``error`` rows are failed queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import chunking
from ..operators import enrich as E
from ..operators import stats as A
from .common import register, search_chunks_ctes, sql_contains_any, sql_count_present, window_chunks_sql
from .text import _quality_sql

AS_OF = "2024-01-30 00:00:00"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _log(t):
    return t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long")) \
                   .withColumn("success", F.col("event_type") != "error")


def _chunks(t):
    ch = chunking.chunk_window(t.documents, keep=("lang", "source"))
    return ch.withColumn("quality_score", F.round(E.quality_score("chunk_text"), 6)) \
             .withColumn("technical_complexity", X.technical_complexity("chunk_text"))


CH = window_chunks_sql(extra=", lang, source")
QUAL = f"round(CAST({_quality_sql('chunk_text')} AS DOUBLE), 6)"
CPLX = f"least(10, {sql_count_present('lower(chunk_text)', L.TECHNICAL_INDICATORS)})"


@register("system_statistics", f"""
SELECT CAST(count(*) AS BIGINT) AS total_chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS total_documents,
       round(avg({QUAL}), 6) AS avg_quality_score, round(avg({CPLX}), 6) AS avg_complexity,
       CAST(count(DISTINCT lang) AS BIGINT) AS unique_doc_types,
       CAST(count(DISTINCT source) AS BIGINT) AS unique_facilities
FROM {CH}""")
def system_statistics(t):
    """A1."""
    r = A.system_statistics(_chunks(t), doc_type="lang", facility="source")
    return r.select("total_chunks", "total_documents", F.round("avg_quality_score", 6).alias("avg_quality_score"),
                    F.round("avg_complexity", 6).alias("avg_complexity"), "unique_doc_types", "unique_facilities")


@register("type_distribution", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS count FROM {CH} GROUP BY lang""")
def type_distribution(t):
    """A2."""
    return A.type_distribution(_chunks(t), "lang")


@register("index_status", f"""
SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS chunks,
       CAST(1 AS BIGINT) AS models FROM {CH}""")
def index_status(t):
    """A3 (one embedding model name on every row)."""
    return A.index_status(_chunks(t).withColumn("embedding_model", F.lit("hash-embedder")))


@register("ingest_validation", f"""
WITH ch AS {window_chunks_sql(source="(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")}
SELECT CAST(count(DISTINCT ch.doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS chunks,
       round(avg(len(e.embedding)), 6) AS avg_embedding_size,
       CAST(min(length(chunk_text)) AS BIGINT) AS min_text_length,
       CAST(max(length(chunk_text)) AS BIGINT) AS max_text_length,
       round(avg(length(chunk_text)), 6) AS avg_text_length
FROM ch JOIN embeddings e ON e.vec_id = ch.doc_id""")
def ingest_validation(t):
    """A4 on chunks carrying their document vector."""
    from ..plans import retrieval
    r = A.ingest_validation(retrieval.chunk_vectors(t.documents, t.embeddings))
    return r.select("documents", "chunks", F.round("avg_embedding_size", 6).alias("avg_embedding_size"),
                    "min_text_length", "max_text_length", F.round("avg_text_length", 6).alias("avg_text_length"))


@register("type_doc_chunk_counts", f"""
SELECT lang AS document_type, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents,
       CAST(count(*) AS BIGINT) AS chunks FROM {CH} GROUP BY lang""")
def type_doc_chunk_counts(t):
    """A5: grouped by a JSON metadata field."""
    ch = _chunks(t).withColumn("metadata", F.to_json(F.struct(F.col("lang").alias("document_type"))))
    return A.type_doc_chunk_counts(ch)


A6_SQL = f"""SELECT CAST(count(*) AS BIGINT) AS total_queries, round(avg(value), 6) AS avg_response_time_ms,
       max(value) AS max_response_time_ms, min(value) AS min_response_time_ms,
       round(avg({K}), 6) AS avg_results_count
FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"""
A7_SQL = f"""SELECT CAST(count(*) AS BIGINT) AS total_cached, round(avg({K} % 5), 6) AS avg_hits_per_query
FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}'"""
A8_SQL = f"""SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS total_documents, CAST(count(*) AS BIGINT) AS total_chunks,
       round(avg(importance_score), 6) AS avg_importance_score FROM sc"""


def _a6(t):
    r = A.query_log_stats(_log(t), AS_OF, results="k")
    return r.select("total_queries", F.round("avg_response_time_ms", 6).alias("avg_response_time_ms"),
                    "max_response_time_ms", "min_response_time_ms",
                    F.round("avg_results_count", 6).alias("avg_results_count"))


def _a7(t):
    cache = _log(t).select((F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
                           (F.col("k") % 5).alias("hit_count"))
    r = A.cache_stats(cache, AS_OF)
    return r.select("total_cached", F.round("avg_hits_per_query", 6).alias("avg_hits_per_query"))


def _a8(t):
    from ..plans import fixtures as FX
    r = A.document_stats(FX.search_chunks(t, with_vectors=False))
    return r.select("total_documents", "total_chunks", F.round("avg_importance_score", 6).alias("avg_importance_score"))


@register("query_log_stats", A6_SQL)
def query_log_stats(t):
    """A6 + F9: last-24 h log stats as of a fixed time."""
    return _a6(t)


@register("cache_stats", A7_SQL)
def cache_stats(t):
    """A7 + F8: live cache entries (expire 24 h after logging) and mean hits."""
    return _a7(t)


@register("document_stats", f"WITH {search_chunks_ctes(False)} {A8_SQL}")
def document_stats(t):
    """A8."""
    return _a8(t)


@register("analytics_summary", f"""
WITH {search_chunks_ctes(False)},
qs AS ({A6_SQL}), cs AS ({A7_SQL}), ds AS ({A8_SQL})
SELECT * FROM qs, cs, ds""")
def analytics_summary(t):
    """A9 + J4: the three one-row summaries side by side."""
    return A.analytics_summary(_a6(t), _a7(t), _a8(t))


@register("daily_query_stats", """
SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS queries, round(avg(value), 6) AS avg_ms,
       round(quantile_cont(value, 0.95), 6) AS p95_ms
FROM events GROUP BY CAST(ts AS DATE)""")
def daily_query_stats(t):
    """A10 (grouped p95, not the invalid analytic form)."""
    r = A.daily_query_stats(t.events)
    return r.select("day", "queries", F.round("avg_ms", 6).alias("avg_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@register("latency_percentiles", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_ms,
       round(coalesce(stddev_samp(value), 0.0), 6) AS std_ms,
       round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms
FROM events GROUP BY event_type""")
def latency_percentiles(t):
    """Per category mean, stdev, p50/p95/p99 (linear interpolation)."""
    r = A.latency_percentiles(t.events, ["event_type"])
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in
                                         ("mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms")])


@register("latency_by_category", """
WITH q AS (SELECT event_type, user_id, avg(value) AS avg_ms FROM events GROUP BY event_type, user_id)
SELECT event_type, CAST(count(*) AS BIGINT) AS queries, round(avg(avg_ms), 6) AS avg_latency_ms,
       round(quantile_cont(avg_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(avg_ms, 0.95), 6) AS p95_latency_ms
FROM q GROUP BY event_type""")
def latency_by_category(t):
    """Category statistics of per-query averages."""
    r = A.latency_by_category(t.events)
    return r.select("event_type", "queries", *[F.round(c, 6).alias(c) for c in
                                               ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms")])


LEVEL_SQL = f"CASE WHEN {K} < 34 THEN 'simple' WHEN {K} < 67 THEN 'complex' ELSE 'technical' END"


@register("latency_by_complexity", f"""
SELECT {LEVEL_SQL} AS level, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
       round(quantile_cont(value, 0.95), 6) AS p95_ms, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")
def latency_by_complexity(t):
    """Levels from the logged result count."""
    log = _log(t)
    lvl = F.when(F.col("k") < 34, "simple").when(F.col("k") < 67, "complex").otherwise("technical")
    r = A.latency_by_level(log, lvl)
    return r.select("level", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")], "n")


@register("implementation_compare", """
SELECT 'w' || CAST(weekofyear(ts) AS VARCHAR) AS implementation, CAST(count(*) AS BIGINT) AS runs,
       round(sum(value), 6) AS total_ms, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
       round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate
FROM events GROUP BY 1""")
def implementation_compare(t):
    """One 'implementation' per log week."""
    log = _log(t).withColumn("implementation", F.concat(F.lit("w"), F.weekofyear("ts").cast("string")))
    r = A.implementation_compare(log)
    return r.select("implementation", "runs", F.round("total_ms", 6).alias("total_ms"),
                    F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms",
                    F.round("success_rate", 6).alias("success_rate"))


@register("throughput", """
SELECT event_type, CAST(count(*) AS BIGINT) AS completed,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS qps
FROM events GROUP BY event_type""")
def throughput(t):
    """Completed / elapsed per category."""
    r = A.throughput(t.events, ["event_type"])
    return r.select("event_type", "completed", F.round("elapsed_s", 6).alias("elapsed_s"),
                    F.round("qps", 9).alias("qps"))


@register("user_level_success", f"""
SELECT CAST(floor({K} / 10) AS BIGINT) AS level, round(avg(value), 6) AS avg_ms,
       round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS success_pct,
       CAST(count(*) - sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM events GROUP BY 1""")
def user_level_success(t):
    """Per load level (result-count decile) avg, p95, success %, errors."""
    log = _log(t)
    r = A.level_success(log, F.floor(F.col("k") / 10).cast("long"))
    return r.select("level", F.round("avg_ms", 6).alias("avg_ms"), F.round("p95_ms", 6).alias("p95_ms"),
                    F.round("success_pct", 6).alias("success_pct"), F.col("errors").cast("long").alias("errors"))


@register("scaling_growth", """
WITH d AS (SELECT CAST(ts AS DATE) AS scale, avg(value) AS avg_ms FROM events GROUP BY 1),
g AS (SELECT (avg_ms - lag(avg_ms) OVER (ORDER BY scale)) / lag(avg_ms) OVER (ORDER BY scale) AS growth, avg_ms FROM d),
a AS (SELECT avg(growth) AS r, CAST(count(growth) AS BIGINT) AS steps, max(avg_ms) AS m FROM g)
SELECT round(r, 6) AS avg_latency_growth_rate, steps, round(m, 6) AS max_avg_ms,
       CASE WHEN steps = 0 THEN 'unknown' WHEN r < 0.5 THEN 'good' ELSE 'poor' END AS scaling_efficiency FROM a""")
def scaling_growth(t):
    """Each log day is one 'scale'; growth of the daily mean latency."""
    per = t.events.groupBy(F.to_date("ts").alias("scale")).agg(F.avg("value").alias("avg_ms"))
    r = A.scaling_growth(per)
    return r.select(F.round("avg_latency_growth_rate", 6).alias("avg_latency_growth_rate"), "steps",
                    F.round("max_avg_ms", 6).alias("max_avg_ms"), "scaling_efficiency")


@register("source_summary", """
WITH r AS (SELECT source, doc_id, CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END AS title,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, CAST(count(*) AS BIGINT) AS documents,
       string_agg(CASE WHEN rn <= 3 THEN title END, '|' ORDER BY rn) AS sample_titles
FROM r GROUP BY source""")
def source_summary(t):
    """Documents and first three titles per source."""
    d = t.documents.withColumn("title", X.summary("text", 30))
    r = A.source_summary(d)
    return r.select("source", "documents", F.array_join("sample_titles", "|").alias("sample_titles"))


@register("dataset_quality", f"""
SELECT CAST(count(*) AS BIGINT) AS total_documents,
       round(avg(CASE WHEN text IS NOT NULL AND length(text) > 100 THEN 1.0 ELSE 0.0 END), 6) AS completeness_rate,
       round(avg(CASE WHEN {sql_contains_any("lower(coalesce(text, ''))", L.DATASET_QUALITY_TERMS)} THEN 1.0 ELSE 0.0 END), 6)
         AS technical_content_rate,
       array_to_string(list_filter([
         CASE WHEN avg(CASE WHEN text IS NOT NULL AND length(text) > 100 THEN 1.0 ELSE 0.0 END) < 0.8
              THEN 'Low document completeness rate' END,
         CASE WHEN avg(CASE WHEN {sql_contains_any("lower(coalesce(text, ''))", L.DATASET_QUALITY_TERMS)} THEN 1.0 ELSE 0.0 END) < 0.6
              THEN 'Low technical content rate' END], lambda x: x IS NOT NULL), '|') AS issues
FROM documents""")
def dataset_quality(t):
    """A20 + F7 + E12-style issues."""
    r = A.dataset_quality(t.documents, terms=L.DATASET_QUALITY_TERMS)
    return r.select("total_documents", F.round("completeness_rate", 6).alias("completeness_rate"),
                    F.round("technical_content_rate", 6).alias("technical_content_rate"),
                    F.array_join("issues", "|").alias("issues"))


@register("domain_distribution", "SELECT lang AS domain, CAST(count(*) AS BIGINT) AS documents FROM documents GROUP BY lang")
def domain_distribution(t):
    """Domain distribution part."""
    return t.documents.groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("documents"))


@register("corpus_statistics", """
SELECT CAST(count(*) AS BIGINT) AS files, round(sum(strlen(text)) / 1048576.0, 6) AS total_mb FROM documents""")
def corpus_statistics(t):
    """A21."""
    r = A.corpus_statistics(t.documents)
    return r.select("files", F.round("total_mb", 6).alias("total_mb"))


@register("phase_summary", """
SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS successful_phases,
       CAST(count(*) AS BIGINT) AS total_phases,
       round(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS success_rate,
       CASE WHEN sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) = count(*) THEN 'success'
            WHEN sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) > 0 THEN 'partial_success'
            ELSE 'failed' END AS overall_status
FROM events GROUP BY 1""")
def phase_summary(t):
    """One run per log day, each logged step a phase."""
    r = A.phase_summary(_log(t).withColumn("day", F.to_date("ts")), ["day"])
    return r.select("day", F.col("successful_phases").cast("long").alias("successful_phases"), "total_phases",
                    F.round("success_rate", 6).alias("success_rate"), "overall_status")
