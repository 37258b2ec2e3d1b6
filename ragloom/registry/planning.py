"""Store planning and cost models on stores = documents grouped by source.

Each fixture store row stands for ``UNIT`` source documents so that the
complexity cuts (1,000 / 5,000 / 10,000 documents) are reachable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import planning as P
from .common import dbl, window_chunks_sql
from .common import register as _register


def register(name, sql=None):
    return _register(name, dbl(sql) if sql else sql)

UNIT = 40

ASSESS_SQL = f"""
WITH inv AS (
  SELECT source AS store_id, CAST(count(*) * {UNIT} AS BIGINT) AS document_count,
         CAST(sum(strlen(text)) * {UNIT} AS DOUBLE) / 1048576.0 AS total_size_mb,
         list_sort(list(DISTINCT lang)) AS document_types, max(doc_id) AS last_document,
         CAST(floor(sum(length(text)) / 4) AS BIGINT) AS api_usage_monthly,
         max(length(text)) > 20000 AS custom_schema
  FROM documents GROUP BY source),
a AS (SELECT *, (CASE WHEN document_count > 10000 THEN 3 WHEN document_count > 5000 THEN 2 WHEN document_count > 1000 THEN 1 ELSE 0 END
               + CASE WHEN total_size_mb > 10000 THEN 3 WHEN total_size_mb > 5000 THEN 2 WHEN total_size_mb > 1000 THEN 1 ELSE 0 END
               + CASE WHEN len(document_types) > 5 THEN 2 WHEN len(document_types) > 3 THEN 1 ELSE 0 END
               + CASE WHEN custom_schema THEN 2 ELSE 0 END
               + CASE WHEN api_usage_monthly > 50000 THEN 2 WHEN api_usage_monthly > 20000 THEN 1 ELSE 0 END) AS complexity_points
      FROM inv),
b AS (SELECT *, CASE WHEN complexity_points >= 10 THEN 'very_high' WHEN complexity_points >= 7 THEN 'high'
                     WHEN complexity_points >= 4 THEN 'medium' ELSE 'low' END AS migration_complexity FROM a),
h AS (SELECT *,
        CASE migration_complexity WHEN 'low' THEN 2.0 WHEN 'medium' THEN 4.0 WHEN 'high' THEN 8.0 ELSE 12.0 END
          * CASE WHEN custom_schema THEN 1.5 ELSE 1.0 END AS setup_hours,
        CASE migration_complexity WHEN 'low' THEN 4.0 WHEN 'medium' THEN 12.0 WHEN 'high' THEN 24.0 ELSE 48.0 END
          * CASE WHEN document_count > 5000 THEN 1.5 ELSE 1.0 END AS migration_hours,
        CASE migration_complexity WHEN 'low' THEN 2.0 WHEN 'medium' THEN 4.0 WHEN 'high' THEN 8.0 ELSE 12.0 END
          * CASE WHEN custom_schema THEN 1.3 ELSE 1.0 END AS validation_hours,
        CAST(least(10, greatest(2, floor(document_count / 1000))) AS INTEGER) AS recommended_parallel_workers
      FROM b),
t AS (SELECT *, setup_hours + migration_hours + validation_hours AS total_hours,
             (setup_hours + migration_hours + validation_hours) / 8 AS estimated_days FROM h),
pr AS (SELECT *, (CASE migration_complexity WHEN 'low' THEN 4 WHEN 'medium' THEN 3 WHEN 'high' THEN 2 ELSE 1 END
                  + CASE WHEN api_usage_monthly > 50000 THEN 3 WHEN api_usage_monthly > 20000 THEN 2
                         WHEN api_usage_monthly > 10000 THEN 1 ELSE 0 END + 1) AS priority_score FROM t),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, store_id) AS priority_rank FROM pr),
risks AS (
  SELECT store_id, 'data_loss' AS type, 'high' AS severity FROM t WHERE document_count > 5000
  UNION ALL SELECT store_id, 'performance_impact', 'medium' FROM t WHERE api_usage_monthly > 30000
  UNION ALL SELECT store_id, 'schema_compatibility', 'medium' FROM t WHERE custom_schema
  UNION ALL SELECT store_id, 'embedding_compatibility', 'low' FROM t WHERE migration_complexity IN ('high', 'very_high'))"""


def inventory(t):
    """The stores of the fixture; text length stands for API use and custom schemas."""
    size = F.length("text")
    docs = t.documents.withColumn("api_calls", size / 4).withColumn("custom", size > 20000)
    return P.store_inventory(docs, doc_unit=UNIT, api_usage="api_calls", custom="custom")


_inv = inventory


def _timed(t):
    return P.migration_time(P.migration_complexity(_inv(t)))


@register("store_inventory", ASSESS_SQL + """
SELECT store_id, document_count, round(total_size_mb, 6) AS total_size_mb,
       array_to_string(document_types, '|') AS document_types, last_document, api_usage_monthly, custom_schema
FROM inv""")
def store_inventory(t):
    """G1: documents grouped by store."""
    r = _inv(t)
    return r.select("store_id", F.col("document_count").cast("long").alias("document_count"),
                    F.round("total_size_mb", 6).alias("total_size_mb"),
                    F.array_join("document_types", "|").alias("document_types"), "last_document",
                    "api_usage_monthly", "custom_schema")


@register("migration_complexity", ASSESS_SQL + """
SELECT store_id, CAST(complexity_points AS INTEGER) AS complexity_points, migration_complexity FROM b""")
def migration_complexity(t):
    """G2."""
    return P.migration_complexity(_inv(t)).select("store_id", F.col("complexity_points").cast("int").alias("complexity_points"),
                                                  "migration_complexity")


@register("migration_time", ASSESS_SQL + """
SELECT store_id, round(setup_hours, 6) AS setup_hours, round(migration_hours, 6) AS migration_hours,
       round(validation_hours, 6) AS validation_hours, round(total_hours, 6) AS total_hours,
       round(estimated_days, 6) AS estimated_days, recommended_parallel_workers FROM t""")
def migration_time(t):
    """G3."""
    r = _timed(t)
    return r.select("store_id", *[F.round(c, 6).alias(c) for c in
                                  ("setup_hours", "migration_hours", "validation_hours", "total_hours", "estimated_days")],
                    "recommended_parallel_workers")


@register("migration_risks", ASSESS_SQL + " SELECT store_id, type, severity FROM risks")
def migration_risks(t):
    """G4."""
    return P.migration_risks(_timed(t))


@register("migration_strategy", ASSESS_SQL + """
SELECT store_id, CASE WHEN migration_complexity = 'low' AND document_count < 1000 AND NOT custom_schema THEN 'direct_transfer'
                      WHEN migration_complexity = 'very_high' OR document_count > 10000 OR total_size_mb > 10000
                      THEN 'streaming_migration' ELSE 'batch_reprocessing' END AS migration_strategy FROM t""")
def migration_strategy(t):
    """G5."""
    return P.migration_strategy(_timed(t)).select("store_id", "migration_strategy")


@register("migration_priority", ASSESS_SQL + """
SELECT store_id, CAST(priority_score AS INTEGER) AS priority_score, priority_rank FROM ranked""")
def migration_priority(t):
    """G6."""
    r = P.migration_priority(_timed(t))
    return r.select("store_id", F.col("priority_score").cast("int").alias("priority_score"),
                    F.col("priority_rank").cast("long").alias("priority_rank"))


@register("migration_waves", ASSESS_SQL + """
SELECT CAST(floor((priority_rank - 1) / 2) + 1 AS INTEGER) AS wave_number, round(max(estimated_days), 6) AS estimated_duration_days,
       CAST(sum(document_count) AS BIGINT) AS total_documents,
       string_agg(store_id, '|' ORDER BY priority_rank) AS stores,
       string_agg(migration_complexity, '|' ORDER BY priority_rank) AS complexity_levels
FROM ranked GROUP BY 1""")
def migration_waves(t):
    """Waves of two stores in priority order."""
    r = P.migration_waves(P.migration_priority(_timed(t)))
    return r.select("wave_number", F.round("estimated_duration_days", 6).alias("estimated_duration_days"),
                    F.col("total_documents").cast("long").alias("total_documents"),
                    F.array_join("stores", "|").alias("stores"),
                    F.array_join("complexity_levels", "|").alias("complexity_levels"))


@register("resource_requirements", ASSESS_SQL + """,
g AS (SELECT sum(total_hours) AS th, max(recommended_parallel_workers) AS w, count(*) AS n, sum(total_size_mb) AS mb FROM t)
SELECT round(th, 1) AS total_engineering_hours, CAST(least(4, greatest(2, n)) AS BIGINT) AS recommended_team_size,
       w AS max_parallel_workers, round(th * 100.0, 6) AS estimated_engineering_cost,
       round(th * 2.0 * w, 6) AS estimated_compute_cost, w * 4 AS peak_memory_gb,
       round(mb / 1024 * 2, 6) AS storage_requirements_gb, round(th * 100.0 + th * 2.0 * w, 6) AS total_estimated_cost FROM g""")
def resource_requirements(t):
    """G8."""
    r = P.resource_requirements(_timed(t))
    return r.select("total_engineering_hours", F.col("recommended_team_size").cast("long").alias("recommended_team_size"),
                    "max_parallel_workers", *[F.round(c, 6).alias(c) for c in
                                              ("estimated_engineering_cost", "estimated_compute_cost")],
                    "peak_memory_gb", F.round("storage_requirements_gb", 6).alias("storage_requirements_gb"),
                    F.round("total_estimated_cost", 6).alias("total_estimated_cost"))


@register("risk_summary", ASSESS_SQL + """
SELECT type, CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high,
       CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS medium,
       CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS low FROM risks GROUP BY type""")
def risk_summary(t):
    """G9."""
    return P.risk_summary(P.migration_risks(_timed(t)))


@register("plan_summary", ASSESS_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total_stores, CAST(sum(document_count) AS BIGINT) AS total_documents,
       round(sum(total_size_mb) / 1024, 2) AS total_size_gb, round(sum(total_hours), 1) AS estimated_total_hours,
       round(sum(total_hours) / 40, 1) AS estimated_weeks FROM t""")
def plan_summary(t):
    """G10."""
    r = P.plan_summary(_timed(t))
    return r.select("total_stores", F.col("total_documents").cast("long").alias("total_documents"),
                    "total_size_gb", "estimated_total_hours", "estimated_weeks")


MONTHLY_QUERIES = "(SELECT CAST(count(*) AS DOUBLE) * 10 FROM events)"


@register("monthly_cost", f"""
WITH u AS (SELECT CAST(count(*) AS DOUBLE) AS c, {MONTHLY_QUERIES} AS q FROM {window_chunks_sql()}),
m AS (SELECT c * 0.001 AS gb, c * 0.001 * 0.02 AS sc, (q * 0.5) / (1024 * 1024) * 5 AS qc, q * 0.1 * 0.0001 AS ec,
             36.0 AS cc, 500.0 + q * 0.001 AS base FROM u)
SELECT round(gb, 6) AS estimated_storage_gb, round(sc, 6) AS storage_cost, round(qc, 6) AS query_processing_cost,
       round(ec, 6) AS embedding_api_cost, round(cc, 6) AS compute_cost, round(base, 6) AS baseline_total_monthly_cost,
       round(sc + qc + ec + cc, 6) AS total_monthly_cost, round(base - (sc + qc + ec + cc), 6) AS absolute_monthly_savings,
       round((base - (sc + qc + ec + cc)) / base * 100, 6) AS percentage_savings FROM m""")
def monthly_cost(t):
    """M1: chunks from the window chunker; monthly queries = 10 x log rows."""
    from ..operators import chunking
    c = chunking.chunk_window(t.documents).agg(F.count(F.lit(1)).alias("total_chunks"))
    q = t.events.agg((F.count(F.lit(1)).cast("double") * 10).alias("monthly_queries"))
    r = P.monthly_cost(c.crossJoin(q))
    return r.select(*[F.round(c_, 6).alias(c_) for c_ in r.columns])


@register("migration_cost", ASSESS_SQL + """
SELECT store_id, round(CAST(document_count AS DOUBLE) * 0.0001, 6) AS embedding_generation,
       round(document_count * 0.00001, 6) AS rag_engine_storage, round(document_count * 0.000002, 6) AS bigquery_storage,
       round(document_count * 0.00001, 6) AS processing,
       round(document_count * 0.0001 + document_count * 0.00001 + document_count * 0.00001, 6) AS total_rag,
       round(document_count * 0.0001 + document_count * 0.000002 + document_count * 0.00001, 6) AS total_bigquery
FROM inv""")
def migration_cost(t):
    """M2 without embedding reuse (re-embedding every document)."""
    r = P.migration_cost(_inv(t), preserve=False)
    return r.select("store_id", *[F.round(c, 6).alias(c) for c in
                                  ("embedding_generation", "rag_engine_storage", "bigquery_storage", "processing",
                                   "total_rag", "total_bigquery")])


@register("reuse_savings", """
SELECT CAST(sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END) AS BIGINT) AS embeddings_reused,
       CAST(count(*) AS BIGINT) AS vectors,
       round(sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END) * 0.0001, 6) AS estimated_savings FROM embeddings""")
def reuse_savings(t):
    """M3: savings from reusing compatible stored vectors (V6)."""
    v = t.embeddings.select(V.embedding_compatibility("embedding", 64).alias("action"))
    r = P.reuse_savings(v)
    return r.select(F.col("embeddings_reused").cast("long").alias("embeddings_reused"), "vectors",
                    F.round("estimated_savings", 6).alias("estimated_savings"))


@register("cost_comparison", f"""
WITH u AS (SELECT CAST(count(*) AS DOUBLE) AS c, {MONTHLY_QUERIES} AS q FROM {window_chunks_sql()}),
m AS (SELECT c * 0.001 * 0.02 AS storage_cost, (q * 0.5) / (1024 * 1024) * 5 AS query_processing_cost,
             q * 0.1 * 0.0001 AS embedding_api_cost, 500.0 + q * 0.001 AS total FROM u),
s AS (SELECT 'storage_cost' AS component, storage_cost AS cost, total FROM m
      UNION ALL SELECT 'query_processing_cost', query_processing_cost, total FROM m
      UNION ALL SELECT 'embedding_api_cost', embedding_api_cost, total FROM m
      UNION ALL SELECT 'other', total - (0.0 + storage_cost + query_processing_cost + embedding_api_cost), total FROM m)
SELECT component, round(cost, 6) AS cost, round(cost / total * 100, 6) AS share_pct FROM s""")
def cost_comparison(t):
    """M4: cost components against the baseline total, with the remainder."""
    from ..operators import chunking
    c = chunking.chunk_window(t.documents).agg(F.count(F.lit(1)).alias("total_chunks"))
    q = t.events.agg((F.count(F.lit(1)).cast("double") * 10).alias("monthly_queries"))
    m = P.monthly_cost(c.crossJoin(q))
    r = P.cost_comparison(m, ["storage_cost", "query_processing_cost", "embedding_api_cost"],
                          "baseline_total_monthly_cost")
    return r.select("component", F.round("cost", 6).alias("cost"), F.round("share_pct", 6).alias("share_pct"))
