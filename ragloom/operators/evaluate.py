"""Retrieval evaluation (E1-E17, U1 reductions, H11 rules).

Metrics are Column expressions over per-query result sets; reductions are
ordinary groupBy aggregates. A result table has one row per (query_id,
rank) with the retrieved row's attributes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import col_, contains_any, count_present


# --------------------------------------------------------------- E1 / E3
def prf(retrieved, expected) -> Column:
    """precision/recall/F1 on *sets* (both empty -> 1/1/1; nothing
    retrieved -> 0/0/0; nothing expected -> 0/1/0)."""
    r = F.array_distinct(F.coalesce(col_(retrieved), F.array().cast("array<string>")))
    e = F.array_distinct(F.coalesce(col_(expected), F.array().cast("array<string>")))
    nr, ne = F.size(r), F.size(e)
    hit = F.size(F.array_intersect(r, e)).cast("double")
    p = F.when((nr == 0) & (ne == 0), 1.0).when(nr == 0, 0.0).when(ne == 0, 0.0).otherwise(hit / nr)
    rc = F.when((nr == 0) & (ne == 0), 1.0).when(nr == 0, 0.0).when(ne == 0, 1.0).otherwise(hit / ne)
    f1 = F.when((nr == 0) & (ne == 0), 1.0).when((nr == 0) | (ne == 0), 0.0) \
          .when(p + rc > 0, 2 * p * rc / (p + rc)).otherwise(0.0)
    return F.struct(p.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def prf_rows(retrieved, expected) -> Column:
    """Row-count variant -- relevant rows / rows and relevant rows /
    #expected, recall capped at 1."""
    r = F.coalesce(col_(retrieved), F.array().cast("array<string>"))
    e = F.array_distinct(F.coalesce(col_(expected), F.array().cast("array<string>")))
    rel = F.size(F.filter(r, lambda x: F.array_contains(e, x))).cast("double")
    p = F.when(F.size(r) > 0, rel / F.size(r)).otherwise(0.0)
    rc = F.when(F.size(e) > 0, F.least(rel / F.size(e), F.lit(1.0))).otherwise(0.0)
    f1 = F.when(p + rc > 0, 2 * p * rc / (p + rc)).otherwise(0.0)
    return F.struct(p.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def per_query_prf(results: DataFrame, retrieved_col: str, expected: DataFrame,
                  by: Sequence[str] = ()) -> DataFrame:
    """Collect each query's retrieved values (bounded by k) and score them."""
    got = results.groupBy("query_id").agg(F.collect_list(F.col(retrieved_col).cast("string")).alias("retrieved"))
    j = expected.join(got, "query_id", "left")
    m = prf("retrieved", "expected")
    return j.select("query_id", *by, m["precision"].alias("precision"), m["recall"].alias("recall"),
                    m["f1"].alias("f1"))


def prf_by_category(per_query: DataFrame, category: str) -> DataFrame:
    """Mean P/R/F1 per category."""
    return per_query.groupBy(category).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                           F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("query_count"))


def prf_overall(per_query: DataFrame) -> DataFrame:
    """Overall means and sample standard deviations (0 if n < 2)."""
    return per_query.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                         *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{c}")
                           for c in ("precision", "recall", "f1")],
                         F.count(F.lit(1)).alias("total_queries_tested"))


# ------------------------------------------------------------- E4 - E11
def content_relevance(text, high: Sequence[str], medium: Sequence[str]) -> Column:
    """min(1, (0.8 high hits + 0.4 medium hits) / (#high + 0.5 #medium))."""
    lt = F.lower(col_(text))
    h = count_present(lt, [x.lower() for x in high])
    m = count_present(lt, [x.lower() for x in medium])
    return F.least((h * 0.8 + m * 0.4) / F.lit(len(high) + len(medium) * 0.5), F.lit(1.0))


def relevance_expectation(top: DataFrame, score: str, relevance: str, expected_min) -> DataFrame:
    """E5: average top score, average content relevance, share of queries
    whose top score meets the expectation (NULL-safe means)."""
    met = (F.col(score) >= col_(expected_min) if not isinstance(expected_min, (int, float))
           else F.col(score) >= F.lit(float(expected_min)))
    return top.agg(F.avg(score).alias("average_similarity_score"),
                   F.avg(relevance).alias("average_content_relevance"),
                   F.avg(met.cast("double")).alias("expectation_met_rate"),
                   F.count(F.lit(1)).alias("queries"))


def term_coverage(text, terms: Sequence[str]) -> Column:
    """Share of expected terms present in the text."""
    if not terms:
        return F.lit(None).cast("double")
    return count_present(F.lower(col_(text)), [t.lower() for t in terms]) / F.lit(float(len(terms)))


def safety_prioritization(results: DataFrame, level: str = "safety_level", text: str = "chunk_text",
                          keywords: Sequence[str] = L.SAFETY_RESULT_KEYWORDS) -> DataFrame:
    """Per query (high + 0.5 medium) / n and keyword hits of rank 1."""
    kw = count_present(F.lower(F.col(text)), keywords)
    return results.groupBy("query_id").agg(
        F.sum(F.when(F.col(level) == "high", 1).otherwise(0)).alias("high_safety_results"),
        F.sum(F.when(F.col(level) == "medium", 1).otherwise(0)).alias("medium_safety_results"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("rank") == 1, kw)).alias("safety_keyword_count")) \
        .withColumn("safety_prioritization_score",
                    (F.col("high_safety_results") * 1.0 + F.col("medium_safety_results") * 0.5) / F.col("n"))


def multimodal_score(has_tables, has_images, has_diagrams, text,
                     indicators: Sequence[str] = L.MULTIMODAL_TEXT_INDICATORS) -> Column:
    """(tables + images + diagrams + min(text references, 3)) / 6."""
    refs = count_present(F.lower(col_(text)), indicators)
    return (col_(has_tables).cast("int") + col_(has_images).cast("int") + col_(has_diagrams).cast("int")
            + F.least(refs, F.lit(3))) / 6.0


def occurrences(text, word: str) -> Column:
    """Non-overlapping occurrences of ``word`` (like str.count)."""
    t = col_(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("long")


def facility_diversity(results: DataFrame, facility: str = "facility", text: str = "chunk_text",
                       words: Sequence[str] = L.FACILITY_WORDS) -> DataFrame:
    """Distinct facilities / results and facility-word references."""
    lt = F.lower(F.col(text))
    refs = sum((occurrences(lt, w) for w in words), F.lit(0))
    return results.groupBy("query_id").agg(
        F.countDistinct(facility).alias("unique_facilities_covered"), F.count(F.lit(1)).alias("total_results"),
        F.sum(refs).alias("facility_references")) \
        .withColumn("facility_diversity_ratio", F.col("unique_facilities_covered") / F.col("total_results"))


def keyword_relevance(text, expected: Sequence[str], custom: Column) -> Column:
    """E10 per result: (expected-keyword share + custom 0/1) / 2."""
    share = count_present(F.lower(col_(text)), [x.lower() for x in expected]) / F.lit(float(len(expected)))
    return (share + F.when(custom, 1.0).otherwise(0.0)) / 2


def safety_density(text, indicators: Sequence[str] = L.SAFETY_DENSITY_INDICATORS,
                   markers: Sequence[str] = L.SAFETY_DENSITY_MARKERS) -> Column:
    """E11 per result: min(hits / #indicators, 1), x1.2 with an explicit marker."""
    lt = F.lower(col_(text))
    s = F.least(count_present(lt, indicators) / F.lit(float(len(indicators))), F.lit(1.0))
    return F.when(contains_any(lt, markers), s * 1.2).otherwise(s)


# ---------------------------------------------------------- E12 - E17
def threshold_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics (metric, value) x rules (metric, op, threshold, message)
    -> the messages whose condition holds. Rules are a small table joined
    on the metric name."""
    j = metrics.join(rules, "metric")
    v, th, op = F.col("value"), F.col("threshold"), F.col("op")
    fire = (F.when(op == "<", v < th).when(op == "<=", v <= th).when(op == ">", v > th)
             .when(op == ">=", v >= th).when(op == "=", v == th).otherwise(F.lit(False)))
    return j.where(fire).select("metric", "value", "op", "threshold", "message")


def grade(value, bands) -> Column:
    """First band whose lower bound the value reaches, else D."""
    expr = None
    for bound, g in bands:
        cond = col_(value) >= bound
        expr = F.when(cond, F.lit(g)) if expr is None else expr.when(cond, F.lit(g))
    return expr.otherwise(F.lit("D"))


def overall_score(f1, avg_latency_ms, savings_pct) -> Column:
    """Mean of (f1*100, max(0, 100 - ms/10), clamp(savings, 0, 100))."""
    return (col_(f1) * 100 + F.greatest(F.lit(0.0), 100 - col_(avg_latency_ms) / 10)
            + F.least(F.lit(100.0), F.greatest(F.lit(0.0), col_(savings_pct)))) / 3.0


def metric_improvement(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """% change per metric, sign flipped where lower is better (names
    containing 'cost' or 'latency'); better flag."""
    j = baseline.select("metric", F.col("value").alias("baseline_value")) \
                .join(current.select("metric", F.col("value").alias("current_value")), "metric")
    lower_better = F.col("metric").contains("cost") | F.col("metric").contains("latency")
    imp = F.when(lower_better, (F.col("baseline_value") - F.col("current_value")) / F.col("baseline_value")) \
           .otherwise((F.col("current_value") - F.col("baseline_value")) / F.col("baseline_value")) * 100
    return j.withColumn("improvement_percentage", imp).withColumn("better", F.col("improvement_percentage") > 0)


def improvement_summary(improvements: DataFrame) -> DataFrame:
    """Mean improvement of the improved metrics, counts, grade."""
    g = improvements.agg(
        F.coalesce(F.avg(F.when(F.col("better"), F.round("improvement_percentage", 1))), F.lit(0.0))
         .alias("overall_improvement_percentage"),
        F.sum(F.col("better").cast("int")).alias("metrics_improved"), F.count(F.lit(1)).alias("total_metrics"))
    return g.withColumn("performance_grade", grade("overall_improvement_percentage", L.IMPROVEMENT_GRADES))


def answer_coverage(text, groups=L.ANSWER_TERM_GROUPS) -> Column:
    """Share of term groups with at least one term in the answer."""
    lt = F.lower(col_(text))
    return sum((contains_any(lt, g).cast("double") for g in groups), F.lit(0.0)) / float(len(groups))


def key_metrics(long_metrics: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """Pick and round headline metrics from a (metric, value) table
    into one row (pivot over a fixed list of names)."""
    p = long_metrics.groupBy().pivot("metric", list(names)).agg(F.first("value"))
    return p.select(*[F.round(F.col(n), digits).alias(n) for n in names])


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """Per threshold the results, the queries that have any, the mean score, and
    the quality: precision (results with the query's label among results), recall (among
    all chunks with it) and F1 over all queries, and the mean precision of the queries
    with results.

    ``scores`` has one row a query and threshold (``vector_search.sweep_scores``).
    """
    hits, results, relevant = (F.sum(c) for c in ("hits", "results", "relevant"))
    some = F.when(F.col("results") > 0, F.col("hits") / F.col("results"))
    g = scores.groupBy("threshold").agg(
        results.cast("long").alias("results"), F.count(F.when(F.col("results") > 0, 1)).alias("queries_with_results"),
        F.expr("try_divide(sum(score_sum), sum(results))").alias("avg_score"),
        F.when(results > 0, hits / results).alias("precision"), F.when(relevant > 0, hits / relevant).alias("recall"),
        F.avg(some).alias("avg_query_precision"))
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), 0.0))
