"""Store assessment, migration planning and cost models.

The store inventory is an aggregate of the document table (one row per
store); everything after it works on that small table, so the few
unpartitioned windows here (priority order, waves) span one row per store,
never the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_

# FIXED VALUES: base hours per complexity level (setup, migration, validation)
BASE_HOURS = {"low": (2, 4, 2), "medium": (4, 12, 4), "high": (8, 24, 8), "very_high": (12, 48, 12)}
LEVEL_PRIORITY = {"low": 4, "medium": 3, "high": 2, "very_high": 1}


def store_inventory(docs: DataFrame, store="source", text="text", doc_type="lang", doc_id="doc_id",
                    doc_unit: int = 1, api_usage: str | None = None, custom: str | None = None) -> DataFrame:
    """G1: per store documents, MB, document types, last document, API use, custom schema.

    ``doc_unit`` scales the document count (a store record may stand for
    ``doc_unit`` source documents per stored row). ``api_usage`` names a numeric column
    that is summed to the monthly use, ``custom`` a boolean one that is true for rows
    outside the standard schema; without them a store has no use and no custom schema."""
    used = F.sum(api_usage) if api_usage else F.lit(0)
    own = F.coalesce(F.max(custom), F.lit(False)) if custom else F.lit(False)
    g = docs.groupBy(F.col(store).alias("store_id")).agg(
        (F.count(F.lit(1)) * doc_unit).alias("document_count"),
        (F.sum(F.octet_length(text)) * doc_unit / 1048576.0).alias("total_size_mb"),
        F.sort_array(F.collect_set(doc_type)).alias("document_types"),
        F.max(doc_id).alias("last_document"),
        F.coalesce(used.cast("long"), F.lit(0).cast("long")).alias("api_usage_monthly"), own.alias("custom_schema"))
    return g


def complexity_points(docs, size_mb, types, custom, api) -> Column:
    d, s, ty, api = col_(docs), col_(size_mb), col_(types), col_(api)
    pts = (F.when(d > 10000, 3).when(d > 5000, 2).when(d > 1000, 1).otherwise(0)
           + F.when(s > 10000, 3).when(s > 5000, 2).when(s > 1000, 1).otherwise(0)
           + F.when(ty > 5, 2).when(ty > 3, 1).otherwise(0)
           + F.when(col_(custom), 2).otherwise(0)
           + F.when(api > 50000, 2).when(api > 20000, 1).otherwise(0))
    return pts


def complexity_level(points) -> Column:
    p = col_(points)
    return F.when(p >= 10, "very_high").when(p >= 7, "high").when(p >= 4, "medium").otherwise("low")


def migration_complexity(inv: DataFrame) -> DataFrame:
    """Points over docs, MB, type diversity, custom schema, API use."""
    pts = complexity_points("document_count", "total_size_mb", F.size("document_types"), "custom_schema",
                            "api_usage_monthly")
    return inv.withColumn("complexity_points", pts) \
              .withColumn("migration_complexity", complexity_level("complexity_points"))


def migration_time(assessed: DataFrame) -> DataFrame:
    """Base hours by level, x1.5 migration above 5,000 documents (the
    x2 branch above 10,000 is unreachable in the reference and is kept
    unreachable), custom schema x1.5 setup / x1.3 validation."""
    lvl = F.col("migration_complexity")

    def base(i):
        e = None
        for k, v in BASE_HOURS.items():
            e = F.when(lvl == k, float(v[i])) if e is None else e.when(lvl == k, float(v[i]))
        return e

    custom = F.col("custom_schema")
    setup = base(0) * F.when(custom, 1.5).otherwise(1.0)
    mig = base(1) * F.when(F.col("document_count") > 5000, 1.5).otherwise(1.0)
    val = base(2) * F.when(custom, 1.3).otherwise(1.0)
    return assessed.withColumn("setup_hours", setup).withColumn("migration_hours", mig) \
                   .withColumn("validation_hours", val) \
                   .withColumn("total_hours", F.col("setup_hours") + F.col("migration_hours") + F.col("validation_hours")) \
                   .withColumn("estimated_days", F.col("total_hours") / 8) \
                   .withColumn("recommended_parallel_workers",
                               F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("document_count") / 1000).cast("int"))))


def migration_risks(assessed: DataFrame) -> DataFrame:
    """One row per applicable risk (type, severity)."""
    risks = F.array(
        F.struct((F.col("document_count") > 5000).alias("on"), F.lit("data_loss").alias("type"), F.lit("high").alias("severity")),
        F.struct((F.col("api_usage_monthly") > 30000).alias("on"), F.lit("performance_impact").alias("type"),
                 F.lit("medium").alias("severity")),
        F.struct(F.col("custom_schema").alias("on"), F.lit("schema_compatibility").alias("type"),
                 F.lit("medium").alias("severity")),
        F.struct(F.col("migration_complexity").isin("high", "very_high").alias("on"),
                 F.lit("embedding_compatibility").alias("type"), F.lit("low").alias("severity")))
    return assessed.select("store_id", F.explode(F.filter(risks, lambda r: r["on"])).alias("r")) \
                   .select("store_id", "r.type", "r.severity")


def migration_strategy(assessed: DataFrame) -> DataFrame:
    """Direct / streaming / batch."""
    lvl, d = F.col("migration_complexity"), F.col("document_count")
    s = (F.when((lvl == "low") & (d < 1000) & ~F.col("custom_schema"), "direct_transfer")
          .when((lvl == "very_high") | (d > 10000) | (F.col("total_size_mb") > 10000), "streaming_migration")
          .otherwise("batch_reprocessing"))
    return assessed.withColumn("migration_strategy", s)


def migration_priority(assessed: DataFrame) -> DataFrame:
    """Level points + API points + 1, ordered desc (ties by store id)."""
    lvl = F.col("migration_complexity")
    lp = None
    for k, v in LEVEL_PRIORITY.items():
        lp = F.when(lvl == k, v) if lp is None else lp.when(lvl == k, v)
    api = F.col("api_usage_monthly")
    score = lp.otherwise(1) + F.when(api > 50000, 3).when(api > 20000, 2).when(api > 10000, 1).otherwise(0) + 1
    w = Window.orderBy(F.col("priority_score").desc(), F.col("store_id"))
    return assessed.withColumn("priority_score", score).withColumn("priority_rank", F.row_number().over(w))


def migration_waves(prioritized: DataFrame, per_wave: int = 2) -> DataFrame:
    """Consecutive groups of ``per_wave`` stores in priority order."""
    wv = prioritized.withColumn("wave_number", F.floor((F.col("priority_rank") - 1) / per_wave).cast("int") + 1)
    g = wv.groupBy("wave_number").agg(
        F.max("estimated_days").alias("estimated_duration_days"), F.sum("document_count").alias("total_documents"),
        F.sort_array(F.collect_list(F.struct("priority_rank", "store_id", "migration_complexity"))).alias("_s"))
    return g.select("wave_number", "estimated_duration_days", "total_documents",
                    F.transform("_s", lambda x: x["store_id"]).alias("stores"),
                    F.transform("_s", lambda x: x["migration_complexity"]).alias("complexity_levels"))


def resource_requirements(timed: DataFrame, engineer_rate: float = 100.0, compute_rate: float = 2.0,
                          gb_per_worker: int = 4) -> DataFrame:
    """G8."""
    g = timed.agg(F.sum("total_hours").alias("total_engineering_hours"),
                  F.max("recommended_parallel_workers").alias("max_parallel_workers"),
                  F.count(F.lit(1)).alias("stores"), F.sum("total_size_mb").alias("mb"))
    return g.select(F.round("total_engineering_hours", 1).alias("total_engineering_hours"),
                    F.least(F.lit(4), F.greatest(F.lit(2), F.col("stores"))).alias("recommended_team_size"),
                    "max_parallel_workers",
                    (F.col("total_engineering_hours") * engineer_rate).alias("estimated_engineering_cost"),
                    (F.col("total_engineering_hours") * compute_rate * F.col("max_parallel_workers"))
                    .alias("estimated_compute_cost"),
                    (F.col("max_parallel_workers") * gb_per_worker).alias("peak_memory_gb"),
                    (F.col("mb") / 1024 * 2).alias("storage_requirements_gb")) \
            .withColumn("total_estimated_cost", F.col("estimated_engineering_cost") + F.col("estimated_compute_cost"))


def risk_summary(risks: DataFrame) -> DataFrame:
    """Risk type x severity counts (pivot on the three severities)."""
    p = risks.groupBy("type").pivot("severity", ["high", "medium", "low"]).count()
    return p.select("type", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in ("high", "medium", "low")])


def plan_summary(timed: DataFrame) -> DataFrame:
    """Totals, GB, hours and 40-hour weeks."""
    g = timed.agg(F.count(F.lit(1)).alias("total_stores"), F.sum("document_count").alias("total_documents"),
                  F.sum("total_size_mb").alias("mb"), F.sum("total_hours").alias("h"))
    return g.select("total_stores", "total_documents", F.round(F.col("mb") / 1024, 2).alias("total_size_gb"),
                    F.round("h", 1).alias("estimated_total_hours"), F.round(F.col("h") / 40, 1).alias("estimated_weeks"))


# ------------------------------------------------------------------ costs
def monthly_cost(usage: DataFrame, chunks="total_chunks", queries="monthly_queries") -> DataFrame:
    """M1: warehouse-side monthly cost vs the managed baseline."""
    c, q = F.col(chunks).cast("double"), F.col(queries).cast("double")
    storage_gb = c * 0.001
    out = usage.select(
        storage_gb.alias("estimated_storage_gb"),
        (storage_gb * 0.02).alias("storage_cost"),
        ((q * 0.5) / (1024 * 1024) * 5).alias("query_processing_cost"),
        (q * 0.1 * 0.0001).alias("embedding_api_cost"),
        F.lit(24 * 30 * 0.05).alias("compute_cost"),
        (F.lit(500.0) + q * 0.001).alias("baseline_total_monthly_cost"))
    out = out.withColumn("total_monthly_cost", F.col("storage_cost") + F.col("query_processing_cost")
                         + F.col("embedding_api_cost") + F.col("compute_cost"))
    out = out.withColumn("absolute_monthly_savings", F.col("baseline_total_monthly_cost") - F.col("total_monthly_cost"))
    return out.withColumn("percentage_savings", F.when(F.col("baseline_total_monthly_cost") > 0,
                          F.col("absolute_monthly_savings") / F.col("baseline_total_monthly_cost") * 100).otherwise(0.0))


def migration_cost(stores: DataFrame, docs="document_count", preserve: Column | bool = True) -> DataFrame:
    """M2: per-document migration cost with or without embedding reuse."""
    n = F.col(docs).cast("double")
    keep = preserve if isinstance(preserve, Column) else F.lit(bool(preserve))
    emb = F.when(keep, 0.0).otherwise(n * 0.0001)
    out = stores.withColumn("embedding_generation", emb).withColumn("rag_engine_storage", n * 0.00001) \
                .withColumn("bigquery_storage", n * 0.000002).withColumn("processing", n * 0.00001)
    return out.withColumn("total_rag", F.col("embedding_generation") + F.col("rag_engine_storage") + F.col("processing")) \
              .withColumn("total_bigquery", F.col("embedding_generation") + F.col("bigquery_storage") + F.col("processing"))


def reuse_savings(vectors: DataFrame, action="action", per_embedding: float = 0.0001) -> DataFrame:
    """M3: vectors reused x the per-embedding price."""
    return vectors.agg(F.sum(F.when(F.col(action) == "reuse", 1).otherwise(0)).alias("embeddings_reused"),
                       F.count(F.lit(1)).alias("vectors")) \
                  .withColumn("estimated_savings", F.col("embeddings_reused") * per_embedding)


def cost_comparison(costs: DataFrame, components, total: str) -> DataFrame:
    """M4: unpivot cost components into rows with their share of the total
    and an 'other' remainder row."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("cost"))
                                for c in components]
                              + [F.struct(F.lit("other").alias("component"),
                                          (F.col(total) - sum((F.col(c) for c in components), F.lit(0.0))).alias("cost"))]))
    return costs.select(F.col(total).alias("_t"), stack.alias("c")) \
                .select("c.component", "c.cost", (F.col("c.cost") / F.col("_t") * 100).alias("share_pct"))
