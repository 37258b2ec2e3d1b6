"""Migration execution and validation.

Everything is a join or an aggregate over id/attribute columns; the
"already migrated" checkpoint is a table, deletes and upserts are
anti-joins, and writers commit through Spark's output protocol into the
shared folder (no local files, no driver-side state).
"""

from __future__ import annotations

from typing import Sequence
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import vectors as V
from . import chunking, embed, enrich, search


# ----------------------------------------------------------- planning joins
def template_expand(stores: DataFrame, templates=L.QUERY_TEMPLATES, general=L.GENERAL_QUERIES,
                    limit: int | None = None, alias: dict | None = None,
                    types_col: str = "document_types") -> DataFrame:
    """Test queries of each store = templates of its document types (in
    its type order), then the general queries (the first ``limit`` if given).

    ``alias`` maps store type names onto template keys (the reference's
    type names never match its template keys)."""
    spark = stores.sparkSession
    rows = [(k, i, q) for k, qs in templates for i, q in enumerate(qs)]
    tpl = spark.createDataFrame(rows, "template_key string, template_pos int, query string")
    al = alias or {}
    key = F.col("doc_type")
    if al:
        m = F.create_map(*[x for k, v in al.items() for x in (F.lit(k), F.lit(v))])
        key = F.coalesce(m[F.col("doc_type")], F.col("doc_type"))
    typed = stores.select("store_id", F.posexplode(types_col).alias("type_pos", "doc_type")) \
                  .withColumn("template_key", key) \
                  .join(F.broadcast(tpl), "template_key") \
                  .select("store_id", "type_pos", "template_pos", "query")
    gen_rows = stores.select("store_id", F.posexplode(F.array(*[F.lit(q) for q in general]))
                             .alias("template_pos", "query")) \
                     .select("store_id", F.lit(1 << 30).alias("type_pos"), "template_pos", "query")
    w = Window.partitionBy("store_id").orderBy("type_pos", "template_pos")
    ranked = typed.unionByName(gen_rows).withColumn("query_rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.where(F.col("query_rank") <= limit)
    return ranked.select("store_id", "query_rank", "query")


def reuse_or_regenerate(docs: DataFrame, vectors: DataFrame, target_dim: int,
                        id_col: str = "doc_id", vec_id: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """J8 + V6: every document with 'reuse' (stored vector of the target
    dimension), 'regenerate' (wrong dimension) or 'missing'."""
    v = vectors.select(F.col(vec_id).alias(id_col), F.col(vec_col).alias("_stored"))
    j = docs.join(v, id_col, "left")
    return j.withColumn("embedding_action", V.embedding_compatibility("_stored", target_dim))


def migrate_embeddings(docs: DataFrame, vectors: DataFrame, target_dim: int, text_col: str = "text",
                       id_col: str = "doc_id", embedder=None) -> DataFrame:
    """Keep compatible stored vectors, embed the rest, union."""
    a = reuse_or_regenerate(docs, vectors, target_dim, id_col)
    keep = a.where(F.col("embedding_action") == "reuse") \
            .withColumn("embedding", V.as_double("_stored")).withColumn("embedding_model", F.lit("stored")) \
            .withColumn("embed_status", F.lit("reused")).drop("_stored")
    todo = a.where(F.col("embedding_action") != "reuse").drop("_stored")
    made = embed.embed_batches(todo, text_col=text_col, dim=target_dim, embedder=embedder)
    return keep.unionByName(made)


# ------------------------------------------------------------ ingestion
def batch_ingest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", type_col: str = "lang",
                 source_col: str | None = "source", embedder=None, dim: int = 64) -> DataFrame:
    """H1: boundary chunks -> manufacturing metadata + quality + hash ->
    vectors; one plan, failures as ``embed_status``."""
    keep = [source_col] if source_col else []
    ch = chunking.chunk_boundary(docs, text_col=text_col, id_col=id_col, type_col=type_col, keep=keep)
    if source_col:
        ch = ch.withColumnRenamed(source_col, "source_system")
    meta = enrich.manufacturing_metadata(ch).withColumn("chunk_hash", F.md5("chunk_text"))
    return embed.embed_batches(meta, "chunk_text", embedder=embedder, dim=dim)


def ingest_counts(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """H1 counters derived from data: documents in, documents with chunks,
    chunks, failed embeddings."""
    d = docs.agg(F.count(F.lit(1)).alias("total_documents"))
    c = chunks.agg(F.countDistinct(id_col).alias("processed_documents"), F.count(F.lit(1)).alias("processed_chunks"),
                   F.sum(F.when(F.col("embed_status") == "failed", 1).otherwise(0)).alias("failed_chunks"))
    return d.crossJoin(c)


def incremental_batch(source: DataFrame, done_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """H3 step 1 (J5): the source rows not yet in the checkpoint table."""
    return search.not_yet_migrated(source, done_ids, key)


def _read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path``; empty if nothing has been written there.
    Any other failure to read is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def incremental_migration(spark: SparkSession, source: DataFrame, transform, target_path: str,
                          checkpoint_path: str, batch_id: str, key: str = "doc_id") -> int:
    """H3: migrate what no earlier batch has migrated; returns the number of ids.

    The ids of a batch are written first and stay its ids whatever the source does
    later; no batch takes ids that another has, finished or not. Its rows overwrite ``target_path/batch_id=<id>`` and a finished batch
    is marked last, under ``checkpoint_path``; so a batch that failed anywhere
    is repeated under the same ``batch_id`` without duplicates or losses. Both
    paths are shared storage.
    """
    schema = source.select(key).schema
    frozen, done = (f"{checkpoint_path}/{step}" for step in ("frozen", "done"))
    finished = _read_if_there(spark, f"{done}/batch_id={batch_id}", schema)
    if not finished.isEmpty():
        return finished.count()
    own = f"{frozen}/batch_id={batch_id}"
    ids = _read_if_there(spark, own, schema)
    if ids.isEmpty():
        taken = _read_if_there(spark, frozen, schema)
        incremental_batch(source, taken, key).select(key).distinct().write.mode("overwrite").parquet(own)
        ids = _read_if_there(spark, own, schema)
    transform(source.join(ids, key, "left_semi")).write.mode("overwrite").parquet(f"{target_path}/batch_id={batch_id}")
    ids.write.mode("overwrite").parquet(f"{done}/batch_id={batch_id}")
    return ids.count()


def delete_documents(chunks: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunk table without the chunks of deleted documents."""
    return chunks.join(deleted.select(key).distinct(), key, "left_anti")


def upsert_documents(chunks: DataFrame, new_docs: DataFrame, chunker, key: str = "doc_id") -> DataFrame:
    """Drop the old chunks of updated documents, add the re-chunked
    new versions (``sinks.buckets.upsert_rows`` writes them)."""
    kept = delete_documents(chunks, new_docs, key)
    return kept.unionByName(chunker(new_docs), allowMissingColumns=True)


def replace_table(rows: DataFrame, table: str, location: str, change: str | None = None) -> None:
    """Replace a whole table: stage ``rows`` at ``location``, then point ``table`` there.

    For changes of most rows; ``sinks.buckets`` rewrites only what a change touches.
    ``rows`` may be computed from the table itself. Readers see the old rows until
    the one catalog change; a failed staging is overwritten by the next attempt at
    the same ``location``, and a repetition of the same ``change`` (by default the
    location names it) does nothing. A second change to the location in use is an
    error. The location is shared storage; the old one stays for readers of it.
    """
    spark, change = rows.sparkSession, change or location
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(
        "col_name in ('Location')").collect()}
    if urlparse(facts["Location"]).path.rstrip("/") == urlparse(location).path.rstrip("/"):
        made_by = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}.get("change")
        if made_by != change:
            raise ValueError(f"{location} is in use and holds change {made_by}, not {change}")
        return
    rows.write.mode("overwrite").parquet(location)
    place, name = (x.replace("'", "\\'") for x in (location, change))
    # The change is named first: a failure in between is repeated by staging again.
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('change' = '{name}')")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
    spark.catalog.refreshTable(table)


def corpus_file_list(chunks: DataFrame, key: str = "doc_id", text: str = "chunk_text") -> DataFrame:
    """One row per file: name, chunks, characters."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"),
                                   F.sum(F.length(text)).cast("long").alias("chunk_chars"))


# ----------------------------------------------------------- validation
def validate_counts(expected: DataFrame, chunks: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """H5: exact distinct-document check per ``by`` plus the reference's
    chunks/2.5 estimate (variance < 20 %)."""
    got = chunks.groupBy(by).agg(F.countDistinct(key).alias("actual_documents"),
                                 F.count(F.lit(1)).alias("actual_chunks"))
    j = expected.join(got, by, "left").fillna(0, ["actual_documents", "actual_chunks"])
    est = F.col("actual_chunks") / L.CHUNKS_PER_DOCUMENT_ESTIMATE
    var = F.abs(F.col("expected_documents") - est) / F.col("expected_documents")
    return j.withColumn("estimated_documents", est).withColumn("variance", var) \
            .withColumn("estimate_passed", F.col("variance") < L.COUNT_VARIANCE_MAX) \
            .withColumn("passed", F.col("actual_documents") == F.col("expected_documents"))


def validate_search_quality(results: DataFrame, score: str = "score", quality: str = "quality_score") -> DataFrame:
    """H6: per query result count, top score, mean quality; averaged and
    tested against 1 / 0.6 / 0.7."""
    per_q = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"),
                                            F.max(score).alias("top_similarity"), F.avg(quality).alias("avg_quality"))
    g = per_q.agg(F.avg("result_count").alias("average_results_per_query"),
                  F.avg("top_similarity").alias("average_similarity_score"),
                  F.avg("avg_quality").alias("average_quality_score"), F.count(F.lit(1)).alias("queries"))
    return g.withColumn("passed", (F.col("average_results_per_query") >= L.SEARCH_MIN_RESULTS)
                        & (F.col("average_similarity_score") >= L.SEARCH_MIN_SIMILARITY)
                        & (F.col("average_quality_score") >= L.SEARCH_MIN_QUALITY))


def validate_latency(log: DataFrame, by: Sequence[str], ms: str = "value") -> DataFrame:
    """H7: mean <= 1000 ms and max <= 2000 ms, with warnings."""
    g = log.groupBy(*by).agg(F.avg(ms).alias("average_query_time_ms"), F.max(ms).alias("max_query_time_ms"),
                             F.count(F.lit(1)).alias("queries_tested"))
    warn = F.filter(F.array(
        F.when(F.col("average_query_time_ms") > L.LATENCY_AVG_MAX_MS, F.lit("average query time too high")),
        F.when(F.col("max_query_time_ms") > L.LATENCY_MAX_MS, F.lit("maximum query time too high"))),
        lambda x: x.isNotNull())
    return g.withColumn("warnings", warn).withColumn("passed", F.size("warnings") == 0)


def validate_integrity(expected_types: DataFrame, chunks: DataFrame, by: str, type_col: str,
                       quality: str = "quality_score") -> DataFrame:
    """H8: chunks present, type coverage >= 0.8, mean quality >= 0.7;
    passed when at least 80 % of the checks pass."""
    got = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.collect_set(type_col).alias("actual_types"),
                                 F.avg(quality).alias("avg_quality"))
    j = expected_types.join(got, by, "left")
    cov = F.when(F.size("expected_types") > 0,
                 F.size(F.array_intersect("expected_types", F.coalesce("actual_types", F.array().cast("array<string>"))))
                 / F.size("expected_types")).otherwise(0.0)
    checks = F.array(F.coalesce(F.col("chunks"), F.lit(0)) > 0, cov >= L.INTEGRITY_TYPE_COVERAGE,
                     F.coalesce(F.col("avg_quality"), F.lit(0.0)) >= L.INTEGRITY_MIN_QUALITY)
    passed = F.size(F.filter(checks, lambda c: c))
    return j.select(by, F.coalesce("chunks", F.lit(0)).alias("chunks"), cov.alias("type_coverage"),
                    "avg_quality", passed.alias("checks_passed"), F.lit(3).alias("checks_performed")) \
            .withColumn("integrity_score", F.col("checks_passed") / F.col("checks_performed")) \
            .withColumn("passed", F.col("checks_passed") >= F.col("checks_performed") * L.INTEGRITY_PASS_SHARE)


def validate_wave(results: DataFrame, wave: str = "wave_number", ok: str = "passed") -> DataFrame:
    """H9: a wave passes when >= 80 % of its store migrations succeeded."""
    g = results.groupBy(wave).agg(F.avg(F.col(ok).cast("double")).alias("success_rate"),
                                  F.count(F.lit(1)).alias("stores"))
    return g.withColumn("wave_passed", F.col("success_rate") >= L.WAVE_MIN_SUCCESS)


def migration_report(stores: DataFrame, ok: str = "passed", docs: str = "document_count",
                     chunks: str = "chunks", quality: str = "avg_quality") -> DataFrame:
    """Success rate, totals, quality min/max/avg over store results."""
    return stores.agg(F.count(F.lit(1)).alias("stores"), F.sum(F.col(ok).cast("int")).alias("successful"),
                      F.avg(F.col(ok).cast("double")).alias("success_rate"), F.sum(docs).alias("documents"),
                      F.sum(chunks).alias("chunks"), F.min(quality).alias("min_quality"),
                      F.max(quality).alias("max_quality"), F.avg(quality).alias("avg_quality"))


def compare_systems(per_query: DataFrame, sim: str = "jaccard") -> DataFrame:
    """Mean result similarity of two systems, issue / advice flags."""
    g = per_query.agg(F.avg(sim).alias("average_similarity"), F.count(F.lit(1)).alias("queries"))
    return g.withColumn("has_issue", F.col("average_similarity") < L.SYSTEM_SIMILARITY_ISSUE) \
            .withColumn("needs_tuning", F.col("average_similarity") < L.SYSTEM_SIMILARITY_ADVICE)
