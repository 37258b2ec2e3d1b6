"""Aggregations over chunk tables and query logs.

All are ``groupBy``/global aggregates with map-side partial aggregation;
percentiles (linear interpolation) are exact by refined histograms
(``percentiles``), and ``approx=True`` switches to one pass with the
``percentile_approx`` sketch.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_
from .percentiles import with_percentiles


def grouped(df: DataFrame, by: Sequence[str], value, shares: dict[str, float], *aggs: Column,
            approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """``aggs`` and the percentiles ``shares`` (name -> share) of ``value``, one row a group."""
    if approx:
        sketches = [F.percentile_approx(col_(value).cast("double"), p, accuracy).alias(n) for n, p in shares.items()]
        return df.groupBy(*by).agg(*aggs, *sketches)
    return with_percentiles(df.groupBy(*by).agg(*aggs), df, by, value, shares)


def sd0(col) -> Column:
    """Sample standard deviation, 0 when fewer than two values."""
    return F.coalesce(F.stddev_samp(col_(col)), F.lit(0.0))


def system_statistics(chunks: DataFrame, doc="doc_id", quality="quality_score",
                      complexity="technical_complexity", doc_type="document_type",
                      facility="facility_code") -> DataFrame:
    """A1."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"),
                      F.countDistinct(doc).alias("total_documents"),
                      F.avg(quality).alias("avg_quality_score"),
                      F.avg(complexity).alias("avg_complexity"),
                      F.countDistinct(doc_type).alias("unique_doc_types"),
                      F.countDistinct(facility).alias("unique_facilities"))


def type_distribution(chunks: DataFrame, doc_type="document_type") -> DataFrame:
    """A2: rows per type, most frequent first (ties by type)."""
    return chunks.groupBy(doc_type).agg(F.count(F.lit(1)).alias("count")) \
                 .orderBy(F.col("count").desc(), F.col(doc_type))


def index_status(chunks: DataFrame, doc="doc_id", model="embedding_model") -> DataFrame:
    """A3."""
    return chunks.agg(F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("chunks"),
                      F.countDistinct(model).alias("models"))


def ingest_validation(chunks: DataFrame, doc="doc_id", emb="embedding", text="chunk_text") -> DataFrame:
    """A4."""
    ln = F.length(text)
    return chunks.agg(F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("chunks"),
                      F.avg(F.size(emb)).alias("avg_embedding_size"),
                      F.min(ln).cast("long").alias("min_text_length"),
                      F.max(ln).cast("long").alias("max_text_length"),
                      F.avg(ln).alias("avg_text_length"))


def type_doc_chunk_counts(chunks: DataFrame, metadata="metadata", doc="doc_id",
                          path: str = "$.document_type") -> DataFrame:
    """A5: per JSON type, distinct documents and chunks."""
    return chunks.groupBy(F.get_json_object(metadata, path).alias("document_type")).agg(
        F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("chunks"))


def query_log_stats(log: DataFrame, as_of, ts="ts", ms="value", results="results_count",
                    hours: int = 24) -> DataFrame:
    """Count and latency stats of the log in the ``hours`` before as_of."""
    recent = log.where(col_(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.agg(F.count(F.lit(1)).alias("total_queries"), F.avg(ms).alias("avg_response_time_ms"),
                      F.max(ms).alias("max_response_time_ms"), F.min(ms).alias("min_response_time_ms"),
                      F.avg(results).alias("avg_results_count"))


def cache_stats(cache: DataFrame, as_of, expires="expires_at", hits="hit_count") -> DataFrame:
    """Live entries and their mean hit count."""
    live = cache.where(col_(expires) > F.lit(as_of).cast("timestamp_ntz"))
    return live.agg(F.count(F.lit(1)).alias("total_cached"), F.avg(hits).alias("avg_hits_per_query"))


def document_stats(chunks: DataFrame, doc="doc_id", importance="importance_score") -> DataFrame:
    """A8."""
    return chunks.agg(F.countDistinct(doc).alias("total_documents"), F.count(F.lit(1)).alias("total_chunks"),
                      F.avg(importance).alias("avg_importance_score"))


def analytics_summary(q: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """A9 (+J4): three one-row aggregates side by side (1x1x1 cross join)."""
    return q.crossJoin(c).crossJoin(d)


def daily_query_stats(log: DataFrame, ts="ts", ms="value", approx: bool = False) -> DataFrame:
    """A10: per day count, mean and p95 (grouped percentile)."""
    days = log.select(F.to_date(ts).alias("day"), col_(ms).alias("ms"))
    return grouped(days, ["day"], "ms", {"p95_ms": 0.95}, F.count(F.lit(1)).alias("queries"),
                   F.avg("ms").alias("avg_ms"), approx=approx).select("day", "queries", "avg_ms", "p95_ms")


def latency_percentiles(log: DataFrame, by: Sequence[str], ms="value", approx: bool = False) -> DataFrame:
    """Mean, sample stdev (0 if n<2), p50/p95/p99 per group."""
    return grouped(log, by, ms, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, F.count(F.lit(1)).alias("n"),
                   F.avg(ms).alias("mean_ms"), sd0(ms).alias("std_ms"), approx=approx)


def latency_by_category(log: DataFrame, category="event_type", query="user_id", ms="value",
                        approx: bool = False) -> DataFrame:
    """Per query avg/min/max/std, then per category the mean, median
    and p95 *of the per-query averages*."""
    per_q = log.groupBy(category, query).agg(F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"),
                                              F.max(ms).alias("max_ms"), sd0(ms).alias("std_ms"))
    return grouped(per_q, [category], "avg_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
                   F.count(F.lit(1)).alias("queries"), F.avg("avg_ms").alias("avg_latency_ms"), approx=approx)


def latency_by_level(log: DataFrame, level: Column, ms="value", approx: bool = False) -> DataFrame:
    """Avg / p50 / p95 / count per complexity level."""
    return grouped(log.select(level.alias("level"), col_(ms).alias("ms")), ["level"], "ms",
                   {"p50_ms": 0.5, "p95_ms": 0.95}, F.avg("ms").alias("avg_ms"), F.count(F.lit(1)).alias("n"),
                   approx=approx).select("level", "avg_ms", "p50_ms", "p95_ms", "n")


def implementation_compare(runs: DataFrame, impl="implementation", ms="value", ok="success") -> DataFrame:
    """Per implementation total/avg/min/max time and success rate."""
    return runs.groupBy(impl).agg(F.count(F.lit(1)).alias("runs"), F.sum(ms).alias("total_ms"),
                                  F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
                                  F.avg(col_(ok).cast("double")).alias("success_rate"))


def throughput(log: DataFrame, by: Sequence[str], ts="ts") -> DataFrame:
    """Completed / elapsed seconds (NULL when elapsed is 0)."""
    secs = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6      # no session-zone conversion
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("completed"), secs.alias("elapsed_s")) \
              .withColumn("qps", F.expr("try_divide(completed, elapsed_s)"))


def level_success(log: DataFrame, level, ms="value", ok="success", expected: Column | None = None,
                  approx: bool = False) -> DataFrame:
    """Per concurrency level avg, p95, success %, errors."""
    g = grouped(log.select(col_(level).alias("level"), col_(ms).alias("ms"), col_(ok).alias("ok")), ["level"], "ms",
                {"p95_ms": 0.95}, F.avg("ms").alias("avg_ms"), F.count(F.lit(1)).alias("attempts"),
                F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("succeeded"), approx=approx)
    return g.select("level", "avg_ms", "p95_ms", (F.col("succeeded") * 100.0 / F.col("attempts")).alias("success_pct"),
                    (F.col("attempts") - F.col("succeeded")).alias("errors"))


def scaling_growth(per_scale: DataFrame, scale="scale", ms="avg_ms", poor_at: float = 0.5) -> DataFrame:
    """Relative growth vs the previous scale, its mean, good/poor.

    The input is already one row per scale (small), so the unpartitioned
    ``lag`` window is over a handful of rows."""
    w = Window.orderBy(scale)
    g = per_scale.withColumn("growth", (F.col(ms) - F.lag(ms).over(w)) / F.lag(ms).over(w))
    return g.agg(F.avg("growth").alias("avg_latency_growth_rate"), F.count("growth").alias("steps"),
                 F.max(ms).alias("max_avg_ms")) \
            .withColumn("scaling_efficiency",
                        F.when(F.col("steps") == 0, "unknown")
                         .when(F.col("avg_latency_growth_rate") < poor_at, "good").otherwise("poor"))


def cache_effect(log: DataFrame, hit="hit", ms="value") -> DataFrame:
    """Hit rate, mean hit/miss time and the speed-up factor."""
    g = log.agg(F.avg(col_(hit).cast("double")).alias("hit_rate"),
                F.avg(F.when(col_(hit), col_(ms))).alias("cached_ms"),
                F.avg(F.when(~col_(hit), col_(ms))).alias("first_ms"))
    return g.withColumn("speedup", F.expr("coalesce(try_divide(first_ms, cached_ms), 0.0)"))


def source_summary(docs: DataFrame, source="source", title="title", order="doc_id", n: int = 3) -> DataFrame:
    """Count and first ``n`` titles per source (partial top-n per
    partition before the shuffle via WindowGroupLimit)."""
    w = Window.partitionBy(source).orderBy(order)
    first = docs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n) \
                .groupBy(source).agg(F.sort_array(F.collect_list(F.struct("_rn", title))).alias("_t"))
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(first, source).select(source, "documents",
                                             F.transform("_t", lambda x: x[title]).alias("sample_titles"))


def dataset_quality(docs: DataFrame, text="text", domain="domain", terms: Sequence[str] = (),
                    min_complete: float = 0.8, min_technical: float = 0.6, min_chars: int = 100) -> DataFrame:
    """Completeness and technical-content rates with issue flags."""
    from ..functions.text import contains_any
    complete = col_(text).isNotNull() & (F.length(text) > min_chars)
    tech = contains_any(F.lower(F.coalesce(col_(text), F.lit(""))), list(terms))
    g = docs.agg(F.count(F.lit(1)).alias("total_documents"),
                 F.avg(complete.cast("double")).alias("completeness_rate"),
                 F.avg(tech.cast("double")).alias("technical_content_rate"))
    issues = F.filter(F.array(
        F.when(F.col("completeness_rate") < min_complete, F.lit("Low document completeness rate")),
        F.when(F.col("technical_content_rate") < min_technical, F.lit("Low technical content rate"))),
        lambda x: x.isNotNull())
    return g.withColumn("issues", issues)


def corpus_statistics(docs: DataFrame, text="text") -> DataFrame:
    """Number of files and total MB (UTF-8 bytes / 2^20)."""
    return docs.agg(F.count(F.lit(1)).alias("files"),
                    (F.sum(F.octet_length(text)) / 1048576.0).alias("total_mb"))


def phase_summary(runs: DataFrame, by: Sequence[str], ok="success") -> DataFrame:
    """Successful / total phases, success %, overall status."""
    g = runs.groupBy(*by).agg(F.sum(F.when(col_(ok), 1).otherwise(0)).alias("successful_phases"),
                              F.count(F.lit(1)).alias("total_phases"))
    return g.withColumn("success_rate", F.col("successful_phases") * 100.0 / F.col("total_phases")) \
            .withColumn("overall_status", F.when(F.col("successful_phases") == F.col("total_phases"), "success")
                        .when(F.col("successful_phases") > 0, "partial_success").otherwise("failed"))
