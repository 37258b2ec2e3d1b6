"""Migration, validation and the data-dependent chunkers.

Fixture mapping: the source store is ``documents``; documents that have a
``labels`` row count as already migrated (the checkpoint table); labelled
``toxic`` documents are deleted, labelled low-quality ones are revised.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import chunking
from ..operators import embed as EM
from ..operators import enrich as E
from ..operators import migrate as M
from ..operators import planning as P
from ..operators import search as S
from ..session import scratch_path
from ..sinks import buckets
from .common import register, window_chunks_sql
from .planning import ASSESS_SQL, inventory
from .text import _quality_sql

ALIAS = {"en": "procedure", "fr": "specification", "de": "safety_guide", "es": "quality_manual"}


@register("not_yet_migrated", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_migrated(t):
    """Documents not in the checkpoint table (left anti join)."""
    return S.not_yet_migrated(t.documents.select("doc_id"), t.labels, "doc_id")


@register("store_completeness", f"""
WITH s AS (SELECT DISTINCT doc_id FROM documents), c AS (SELECT DISTINCT doc_id FROM {window_chunks_sql()})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM s) AS source_count, (SELECT CAST(count(*) AS BIGINT) FROM c) AS target_count,
       (SELECT CAST(count(*) AS BIGINT) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c)) AS missing_count,
       (SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c)) = 0 AS complete""")
def store_completeness(t):
    """Source documents vs documents present in the chunk table."""
    return S.store_completeness(t.documents, chunking.chunk_window(t.documents), "doc_id")


TPL_VALUES = ", ".join(f"('{k}', {i}, '{q}')" for k, qs in L.QUERY_TEMPLATES for i, q in enumerate(qs))
GEN_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(L.GENERAL_QUERIES))
ALIAS_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in ALIAS.items())


@register("template_expand", f"""
WITH st AS (SELECT source AS store_id, list_sort(list(DISTINCT lang)) AS types FROM documents GROUP BY source),
ty AS (SELECT store_id, unnest(types) AS doc_type, unnest(range(0, len(types))) AS type_pos FROM st),
al AS (SELECT * FROM (VALUES {ALIAS_VALUES}) a(doc_type, template_key)),
tpl AS (SELECT * FROM (VALUES {TPL_VALUES}) t(template_key, template_pos, query)),
gen AS (SELECT * FROM (VALUES {GEN_VALUES}) g(template_pos, query)),
u AS (SELECT ty.store_id, ty.type_pos, tpl.template_pos, tpl.query FROM ty
      JOIN al ON al.doc_type = ty.doc_type JOIN tpl ON tpl.template_key = al.template_key
      UNION ALL SELECT st.store_id, 1073741824, gen.template_pos, gen.query FROM st, gen),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY type_pos, template_pos) AS query_rank FROM u)
SELECT store_id, query_rank, query FROM r""")
def template_expand(t):
    """The test queries of every store from its document types + general."""
    stores = inventory(t)
    r = M.template_expand(stores, alias=ALIAS)
    return r.select("store_id", F.col("query_rank").cast("long").alias("query_rank"), "query")


@register("reuse_or_regenerate", """
SELECT d.doc_id, CASE WHEN e.embedding IS NULL OR len(e.embedding) <= 0 THEN 'missing'
                      WHEN len(e.embedding) = 64 THEN 'reuse' ELSE 'regenerate' END AS embedding_action
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def reuse_or_regenerate(t):
    """J8 + V6: which documents can keep their stored vector."""
    return M.reuse_or_regenerate(t.documents.select("doc_id"), t.embeddings, 64).select("doc_id", "embedding_action")


@register("embed_batches", """
SELECT d.doc_id, CASE WHEN e.embedding IS NULL OR len(e.embedding) <= 0 THEN 'missing'
                      WHEN len(e.embedding) = 64 THEN 'reuse' ELSE 'regenerate' END AS embedding_action,
       CASE WHEN e.embedding IS NOT NULL AND len(e.embedding) = 64 THEN 'reused'
            WHEN d.text IS NULL OR d.text = '' THEN 'empty' ELSE 'ok' END AS embed_status,
       CAST(CASE WHEN (e.embedding IS NOT NULL AND len(e.embedding) = 64) OR coalesce(d.text, '') <> '' THEN 64 ELSE 0 END
            AS INTEGER) AS dims
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def embed_batches(t):
    """V5 + X4 + J8: keep stored vectors, embed the other documents' whole texts
    in Arrow batches of 100 with the hash embedder (rows-only check)."""
    r = M.migrate_embeddings(t.documents.select("doc_id", "text"), t.embeddings, 64)
    dims = F.when(F.col("embedding").isNull(), F.lit(0)).otherwise(F.size("embedding"))
    return r.select("doc_id", "embedding_action", "embed_status", dims.cast("int").alias("dims"))


@register("embed_store", f"""
WITH ch AS {window_chunks_sql()}
SELECT 'first' AS run, CAST(count(DISTINCT chunk_text) AS BIGINT) AS embedded, CAST(count(*) AS BIGINT) AS chunks,
       CAST(count(*) AS BIGINT) AS with_vector FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT 'second', CAST((SELECT count(DISTINCT chunk_text) FROM ch)
                      - (SELECT count(DISTINCT chunk_text) FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT),
       CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM ch
UNION ALL
SELECT 'third', 0, CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM ch""")
def embed_store(t):
    """V5 + J8 across runs: chunks of unlabelled documents, then of all, then of all again,
    against one store of vectors; each distinct text is embedded once."""
    store = scratch_path(t.spark, f"vectors-{uuid.uuid4().hex[:12]}")
    every = chunking.chunk_window(t.documents).select("doc_id", "chunk_id", "chunk_text")
    out = None
    for run, chunks in (("first", M.incremental_batch(every, t.labels.select("doc_id"))), ("second", every),
                        ("third", every)):
        done = EM.embed_stored(chunks, store, run)
        new = t.spark.read.schema(EM.STORED).parquet(f"{store}/model=hash-embedder/run={run}").agg(
            F.count(F.lit(1)).alias("embedded"))
        row = done.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("with_vector")).crossJoin(new).select(
            F.lit(run).alias("run"), "embedded", "chunks", "with_vector")
        out = row if out is None else out.unionByName(row)
    return out


def _batch_ingest_sql() -> str:
    return f"""WITH bi AS ({_ingest_meta_sql()})
SELECT bi.*, 'ok' AS embed_status, d.source AS source_system FROM bi JOIN documents d ON d.doc_id = bi.doc_id"""


@register("batch_ingest", None)
def batch_ingest(t):
    """H1: boundary chunks + metadata + quality + hash + vectors (rows)."""
    r = M.batch_ingest(t.documents)
    return r.select("doc_id", "chunk_id", "section_type", "document_type", "equipment_type", "safety_level",
                    "process_category", "technical_complexity", F.array_join("keyword_tags", "|").alias("keyword_tags"),
                    F.round("quality_score", 6).alias("quality_score"), "has_diagrams", "chunk_hash", "embed_status",
                    "source_system")


@register("ingest_counts", None)
def ingest_counts(t):
    """H1 counters (documents in, documents with chunks, chunks, failures)."""
    docs = t.documents
    return M.ingest_counts(M.batch_ingest(docs), docs)


@register("incremental_batch", f"""
WITH ch AS {window_chunks_sql(source="(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")}
SELECT doc_id, chunk_id, md5(chunk_text) AS chunk_hash FROM ch""")
def incremental_batch(t):
    """H3 step: chunks of the documents not yet migrated (what the next
    incremental run appends)."""
    b = M.incremental_batch(t.documents, t.labels.select("doc_id"))
    return chunking.chunk_window(b).select("doc_id", "chunk_id", F.md5("chunk_text").alias("chunk_hash"))


@register("incremental_migration", f"""
WITH ch AS {window_chunks_sql()}
SELECT doc_id, chunk_id, md5(chunk_text) AS chunk_hash,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'b1' ELSE 'b2' END AS batch_id FROM ch""")
def incremental_migration(t):
    """H3 as a write: a first batch of the labelled documents that fails before it is
    marked done and is repeated, then a second batch over the whole source."""
    target, marks = (scratch_path(t.spark, f"h3-{uuid.uuid4().hex}/{x}") for x in ("target", "marks"))

    def chunks(docs):
        return chunking.chunk_window(docs).select("doc_id", "chunk_id", F.md5("chunk_text").alias("chunk_hash"))

    def failing(docs):
        chunks(docs).write.parquet(f"{target}/batch_id=b1")  # rows of the failed attempt are left behind
        raise InterruptedError

    first = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    try:
        M.incremental_migration(t.spark, first, failing, target, marks, "b1")
    except InterruptedError:
        M.incremental_migration(t.spark, first, chunks, target, marks, "b1")
    M.incremental_migration(t.spark, t.documents, chunks, target, marks, "b2")
    return t.spark.read.parquet(target).select("doc_id", "chunk_id", "chunk_hash", "batch_id")


GUARDED = window_chunks_sql(extra=", lang, source", source="(SELECT * FROM documents WHERE text IS NOT NULL AND length(text) >= 50)")


def _guarded_chunks(t):
    docs = chunking.short_document_guard(t.documents)
    return chunking.chunk_window(docs, keep=("lang", "source")) \
                   .withColumn("quality_score", F.round(E.quality_score("chunk_text"), 6))


@register("validate_counts", f"""
WITH e AS (SELECT source, CAST(count(*) AS BIGINT) AS expected_documents FROM documents GROUP BY source),
g AS (SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS actual_documents, CAST(count(*) AS BIGINT) AS actual_chunks
      FROM {GUARDED} GROUP BY source)
SELECT e.source, expected_documents, coalesce(actual_documents, 0) AS actual_documents,
       round(abs(expected_documents - coalesce(actual_chunks, 0) / 2.5) / expected_documents, 6) AS variance,
       abs(expected_documents - coalesce(actual_chunks, 0) / 2.5) / expected_documents < 0.2 AS estimate_passed,
       coalesce(actual_documents, 0) = expected_documents AS passed
FROM e LEFT JOIN g ON g.source = e.source""")
def validate_counts(t):
    """H5: exact per-store document check and the 2.5-chunks estimate."""
    exp = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("expected_documents"))
    r = M.validate_counts(exp, _guarded_chunks(t), "source")
    return r.select("source", "expected_documents", F.col("actual_documents").cast("long").alias("actual_documents"),
                    F.round("variance", 6).alias("variance"), "estimate_passed", "passed")


@register("validate_search_quality", f"""
WITH ch AS {window_chunks_sql(source="(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")},
s AS (SELECT q.vec_id AS query_id, ch.chunk_id, ch.chunk_text,
             round(CASE WHEN isnan(list_cosine_similarity(CAST(ce.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) THEN 0.0
                   ELSE list_cosine_similarity(CAST(ce.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) END, 9) AS score
      FROM embeddings q CROSS JOIN ch JOIN embeddings ce ON ce.vec_id = ch.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.3),
res AS (SELECT *, round(CAST({_quality_sql('chunk_text')} AS DOUBLE), 6) AS q FROM r WHERE rank <= 5),
pq AS (SELECT query_id, count(*) AS n, max(score) AS top, avg(q) AS aq FROM res GROUP BY query_id)
SELECT round(avg(n), 6) AS average_results_per_query, round(avg(top), 6) AS average_similarity_score,
       round(avg(aq), 6) AS average_quality_score, CAST(count(*) AS BIGINT) AS queries,
       avg(n) >= 1 AND avg(top) >= 0.6 AND avg(aq) >= 0.7 AS passed FROM pq""")
def validate_search_quality(t):
    """H6 over the semantic top-5 of every query vector."""
    from .evaluate import _results
    res = _results(t).withColumn("quality_score", F.round(E.quality_score("chunk_text"), 6))
    r = M.validate_search_quality(res)
    return r.select(*[F.round(c, 6).alias(c) for c in
                      ("average_results_per_query", "average_similarity_score", "average_quality_score")],
                    "queries", "passed")


@register("validate_latency", """
SELECT event_type, round(avg(value), 6) AS average_query_time_ms, max(value) AS max_query_time_ms,
       CAST(count(*) AS BIGINT) AS queries_tested,
       array_to_string(list_filter([CASE WHEN avg(value) > 1000 THEN 'average query time too high' END,
                                    CASE WHEN max(value) > 2000 THEN 'maximum query time too high' END],
                                   lambda x: x IS NOT NULL), '|') AS warnings,
       avg(value) <= 1000 AND max(value) <= 2000 AS passed
FROM events GROUP BY event_type""")
def validate_latency(t):
    """H7 per query category of the log."""
    r = M.validate_latency(t.events, ["event_type"])
    return r.select("event_type", F.round("average_query_time_ms", 6).alias("average_query_time_ms"),
                    "max_query_time_ms", "queries_tested", F.array_join("warnings", "|").alias("warnings"), "passed")


INTEGRITY_SQL = f"""
WITH et AS (SELECT source, list(DISTINCT lang) AS expected_types FROM documents GROUP BY source),
g AS (SELECT source, count(*) AS chunks, list(DISTINCT lang) AS actual_types,
             avg(round(CAST({_quality_sql('chunk_text')} AS DOUBLE), 6)) AS avg_quality FROM {GUARDED} GROUP BY source),
j AS (SELECT et.source, coalesce(g.chunks, 0) AS chunks,
             CASE WHEN len(expected_types) > 0
                  THEN len(list_filter(expected_types, lambda x: list_contains(coalesce(g.actual_types, []), x))) / CAST(len(expected_types) AS DOUBLE)
                  ELSE 0.0 END AS type_coverage, g.avg_quality
      FROM et LEFT JOIN g ON g.source = et.source),
k AS (SELECT *, CAST(chunks > 0 AS INTEGER) + CAST(type_coverage >= 0.8 AS INTEGER)
                + CAST(coalesce(avg_quality, 0.0) >= 0.7 AS INTEGER) AS checks_passed FROM j),
integ AS (SELECT source, CAST(chunks AS BIGINT) AS chunks, type_coverage, avg_quality, checks_passed, 3 AS checks_performed,
                 checks_passed / 3.0 AS integrity_score, checks_passed >= 3 * 0.8 AS passed FROM k)"""


@register("validate_integrity", INTEGRITY_SQL + """
SELECT source, chunks, round(type_coverage, 6) AS type_coverage, round(avg_quality, 6) AS avg_quality,
       checks_passed, checks_performed, round(integrity_score, 6) AS integrity_score, passed FROM integ""")
def validate_integrity(t):
    """H8 per store."""
    return _integrity(t).select("source", "chunks", F.round("type_coverage", 6).alias("type_coverage"),
                                F.round("avg_quality", 6).alias("avg_quality"), "checks_passed", "checks_performed",
                                F.round("integrity_score", 6).alias("integrity_score"), "passed")


def _integrity(t):
    exp = t.documents.groupBy("source").agg(F.collect_set("lang").alias("expected_types"))
    r = M.validate_integrity(exp, _guarded_chunks(t), "source", "lang")
    return r.withColumn("chunks", F.col("chunks").cast("long"))


@register("validate_wave", ASSESS_SQL.replace("WITH inv AS", "WITH " + INTEGRITY_SQL.split("WITH ", 1)[1] + ", inv AS") + """
SELECT CAST(floor((priority_rank - 1) / 2) + 1 AS INTEGER) AS wave_number,
       round(avg(CAST(integ.passed AS DOUBLE)), 6) AS success_rate, CAST(count(*) AS BIGINT) AS stores,
       avg(CAST(integ.passed AS DOUBLE)) >= 0.8 AS wave_passed
FROM ranked JOIN integ ON integ.source = ranked.store_id GROUP BY 1""")
def validate_wave(t):
    """H9: waves (G7 order) pass when >= 80 % of their stores pass H8."""
    pr = P.migration_priority(P.migration_time(P.migration_complexity(inventory(t))))
    wv = pr.withColumn("wave_number", F.floor((F.col("priority_rank") - 1) / 2).cast("int") + 1)
    j = wv.join(_integrity(t).withColumnRenamed("source", "store_id"), "store_id")
    r = M.validate_wave(j)
    return r.select("wave_number", F.round("success_rate", 6).alias("success_rate"), "stores", "wave_passed")


@register("migration_report", INTEGRITY_SQL + """,
dc AS (SELECT source, count(*) AS document_count FROM documents GROUP BY source)
SELECT CAST(count(*) AS BIGINT) AS stores, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS successful,
       round(avg(CAST(passed AS DOUBLE)), 6) AS success_rate, CAST(sum(document_count) AS BIGINT) AS documents,
       CAST(sum(chunks) AS BIGINT) AS chunks, round(min(avg_quality), 6) AS min_quality,
       round(max(avg_quality), 6) AS max_quality, round(avg(avg_quality), 6) AS avg_quality
FROM integ JOIN dc USING (source)""")
def migration_report(t):
    """H10 over the per-store integrity results."""
    dc = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("document_count"))
    r = M.migration_report(_integrity(t).join(dc, "source"))
    return r.select("stores", F.col("successful").cast("long").alias("successful"),
                    F.round("success_rate", 6).alias("success_rate"), "documents", "chunks",
                    *[F.round(c, 6).alias(c) for c in ("min_quality", "max_quality", "avg_quality")])


@register("corpus_file_list", f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chunk_chars
FROM {window_chunks_sql()} GROUP BY doc_id""")
def corpus_file_list(t):
    """H12."""
    return M.corpus_file_list(chunking.chunk_window(t.documents))


@register("delete_documents", f"""
SELECT chunk_id FROM {window_chunks_sql()} WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_documents(t):
    """Remove every chunk of the documents flagged toxic."""
    r = M.delete_documents(chunking.chunk_window(t.documents), t.labels.where(F.col("toxic") == 1))
    return r.select("chunk_id")


@register("upsert_documents", f"""
WITH nd AS (SELECT d.doc_id, d.text || ' (revised)' AS text FROM documents d JOIN labels l ON l.doc_id = d.doc_id
            WHERE l.quality = 0)
SELECT chunk_id, md5(chunk_text) AS chunk_hash FROM {window_chunks_sql()} WHERE doc_id NOT IN (SELECT doc_id FROM nd)
UNION ALL SELECT chunk_id, md5(chunk_text) FROM {window_chunks_sql(source='nd')}""")
def upsert_documents(t):
    """Low-quality documents replaced by a revised text and re-chunked."""
    nd = t.documents.join(t.labels.where(F.col("quality") == 0).select("doc_id"), "doc_id") \
                    .select("doc_id", F.concat("text", F.lit(" (revised)")).alias("text"))
    r = M.upsert_documents(chunking.chunk_window(t.documents), nd, lambda d: chunking.chunk_window(d))
    return r.select("chunk_id", F.md5("chunk_text").alias("chunk_hash"))


@register("rewrite_chunk_table", f"""
WITH nd AS (SELECT d.doc_id, d.text || ' (revised)' AS text FROM documents d
            WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT chunk_id, md5(chunk_text) AS chunk_hash FROM (
  SELECT * FROM {window_chunks_sql()} WHERE doc_id NOT IN (SELECT doc_id FROM nd)
  UNION ALL SELECT * FROM {window_chunks_sql(source='nd')})
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""")
def rewrite_chunk_table(t):
    """H13 + H14 as writes: a chunk table in hash buckets is upserted, then deleted
    from; each change writes the buckets it touches and the next manifest."""
    folder = scratch_path(t.spark, f"chunk-table-{uuid.uuid4().hex[:12]}")
    buckets.create_table(chunking.chunk_window(t.documents), folder, buckets=64)
    revised = (t.documents.join(t.labels.where(F.col("quality") == 0).select("doc_id"), "doc_id", "left_semi")
               .select("doc_id", F.concat("text", F.lit(" (revised)")).alias("text")))
    buckets.upsert_rows(t.spark, folder, chunking.chunk_window(revised), revised, "revise")
    buckets.delete_keys(t.spark, folder, t.labels.where(F.col("toxic") == 1), "toxic")
    return buckets.read_table(t.spark, folder).select("chunk_id", F.md5("chunk_text").alias("chunk_hash"))


@register("compare_systems", None)
def compare_systems(t):
    """Mean Jaccard of semantic vs hybrid top-5 and issue flags."""
    from .search import result_jaccard
    r = M.compare_systems(result_jaccard(t))
    return r.select(F.round("average_similarity", 6).alias("average_similarity"), "queries", "has_issue", "needs_tuning")


# ---------------------------------------- chunkers checked by rows / tests
def sentence_pack_sql(text_expr: str, size: int = 1000) -> str:
    """DuckDB form of the sentence packing fold (overlap > 0): a list of
    {t, n} structs for one text."""
    sents = f"string_split(regexp_replace({text_expr}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    red = (f"list_reduce({sents}, lambda acc, x: CASE WHEN acc.sz + length(x) > {size} AND len(acc.cur) > 0 "
           "THEN {'out': list_append(acc.out, {'t': array_to_string(acc.cur, ' '), 'n': len(acc.cur)}), "
           "'cur': [acc.cur[-1], x], 'sz': length(acc.cur[-1]) + length(x)} "
           "ELSE {'out': acc.out, 'cur': list_append(acc.cur, x), 'sz': acc.sz + length(x)} END, "
           "{'out': []::STRUCT(t VARCHAR, n BIGINT)[], 'cur': []::VARCHAR[], 'sz': 0::BIGINT})")
    return (f"(CASE WHEN len(({red}).cur) > 0 THEN list_append(({red}).out, "
            f"{{'t': array_to_string(({red}).cur, ' '), 'n': len(({red}).cur)}}) ELSE ({red}).out END)")


CHUNKS_OUT_SQL = """
SELECT doc_id, chunk_index, printf('%s_chunk_%04d', CAST(doc_id AS VARCHAR), chunk_index) AS chunk_id,
       CAST(length(ch.t) AS BIGINT) AS chunk_length, CAST(ch.n AS BIGINT) AS {count}, CAST(total_chunks AS BIGINT) AS total_chunks,
       md5(ch.t) AS h
FROM (SELECT doc_id, unnest(chunks) AS ch, unnest(range(0, len(chunks))) AS chunk_index, len(chunks) AS total_chunks FROM c)"""


@register("chunk_sentence", f"""
WITH c AS (SELECT doc_id, {sentence_pack_sql('text')} AS chunks FROM documents WHERE text IS NOT NULL)
{CHUNKS_OUT_SQL.format(count='sentence_count')}""")
def chunk_sentence(t):
    """Sentence-packed 1000/200 chunks of every document."""
    return chunking.chunk_sentence(t.documents).select("doc_id", "chunk_index", "chunk_id", "chunk_length",
                                                      "sentence_count", "total_chunks", F.md5("chunk_text").alias("h"))


RECURSIVE_SQL = f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS paras FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, list_reduce(paras, lambda acc, x:
        CASE WHEN length(x) > 1000 THEN {{'out': list_concat(acc.out,
                 CASE WHEN len(acc.cur) > 0 THEN [{{'t': array_to_string(acc.cur, chr(10)), 'n': len(acc.cur), 'big': false}}]
                      ELSE []::STRUCT(t VARCHAR, n BIGINT, big BOOLEAN)[] END, [{{'t': x, 'n': 1, 'big': true}}]),
                 'cur': []::VARCHAR[], 'sz': 0::BIGINT}}
             WHEN acc.sz + length(x) > 1000 AND len(acc.cur) > 0 THEN {{'out': list_append(acc.out,
                 {{'t': array_to_string(acc.cur, chr(10)), 'n': len(acc.cur), 'big': false}}), 'cur': [x], 'sz': length(x)}}
             ELSE {{'out': acc.out, 'cur': list_append(acc.cur, x), 'sz': acc.sz + length(x)}} END,
        {{'out': []::STRUCT(t VARCHAR, n BIGINT, big BOOLEAN)[], 'cur': []::VARCHAR[], 'sz': 0::BIGINT}}) AS r FROM p),
gg AS (SELECT doc_id, CASE WHEN len(r.cur) > 0 THEN list_append(r.out, {{'t': array_to_string(r.cur, chr(10)), 'n': len(r.cur), 'big': false}})
                           ELSE r.out END AS groups FROM g),
pieces AS (SELECT doc_id, gi, grp FROM (SELECT doc_id, unnest(groups) AS grp, unnest(range(0, len(groups))) AS gi FROM gg)),
expanded AS (SELECT doc_id, gi, CASE WHEN grp.big THEN {sentence_pack_sql('grp.t')}
                                     ELSE [{{'t': grp.t, 'n': grp.n}}] END AS parts FROM pieces),
flat AS (SELECT doc_id, gi, unnest(parts) AS ch, unnest(range(0, len(parts))) AS pi FROM expanded),
c AS (SELECT doc_id, list(ch ORDER BY gi, pi) AS chunks FROM flat GROUP BY doc_id)
{CHUNKS_OUT_SQL.format(count='piece_count')}"""


@register("chunk_recursive", RECURSIVE_SQL)
def chunk_recursive(t):
    """C4 with the line break as paragraph delimiter (the fixture has no
    blank lines)."""
    return chunking.chunk_recursive(t.documents, para_delim="\n").select(
        "doc_id", "chunk_index", "chunk_id", "chunk_length", "piece_count", "total_chunks",
        F.md5("chunk_text").alias("h"))


def _boundary_end(s: str, size: int = 1000) -> str:
    """DuckDB: end of the window starting at ``s`` (0-based), cut back to
    just after the last '.' when that lies past half the window."""
    e0 = f"least({s} + {size}, L)"
    seg = f"substring(text, {s} + 1, {e0} - {s})"
    last = f"(CASE WHEN strpos(reverse({seg}), '.') > 0 THEN {s} + length({seg}) - strpos(reverse({seg}), '.') END)"
    return (f"(CASE WHEN {e0} < L AND {last} IS NOT NULL AND {last} > {s} + {size * 0.5} "
            f"THEN {last} + 1 ELSE {e0} END)")


BOUNDARY_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS L FROM documents WHERE text IS NOT NULL AND length(text) >= 50),
w(doc_id, text, L, s, e) AS (
  SELECT doc_id, text, L, 0, {_boundary_end('0')} FROM d
  UNION ALL
  SELECT doc_id, text, L, greatest(e - 200, s + 1), {_boundary_end('greatest(e - 200, s + 1)')} FROM w WHERE e < L),
p AS (SELECT doc_id, s, e, regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS piece FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM p WHERE length(piece) > 100)
SELECT doc_id, CAST(doc_id AS VARCHAR) || '_chunk_' || CAST(i AS VARCHAR) AS chunk_id, CAST(s AS BIGINT) AS start_pos,
       CAST(e AS BIGINT) AS end_pos, CAST(length(piece) AS BIGINT) AS chunk_length FROM k"""


@register("chunk_boundary", BOUNDARY_SQL)
def chunk_boundary(t):
    """Period-boundary windows sized by document type (the fixture
    types all take the 1000/200 default)."""
    return chunking.chunk_boundary(t.documents).select("doc_id", "chunk_id", "start_pos", "end_pos", "chunk_length")


# ---- C6 in SQL: a recursive CTE for the separator recursion and a
# list_reduce fold for the overlap merge (the pop-front loop becomes "the
# smallest prefix to drop").
def sql_lit(x):
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

def c6_sql(size=1000, overlap=200, seps=L.SEPARATORS):
    """DuckDB form of ``chunking.separator_split`` over ``documents``."""
    seplist = "[" + ", ".join(sql_lit(s) for s in seps) + "]"
    n = len(seps)
    # first separator index (1-based) at or after level present in txt; else n (the last one, rest empty)
    pick = f"coalesce(list_filter(range(lvl + 1, {n} + 1), lambda i: contains(txt, {seplist}[i]))[1], {n})"
    return f"""
WITH RECURSIVE seg(doc_id, path, txt, lvl, kind) AS (
  SELECT doc_id, []::INTEGER[], text, 0, 'split' FROM documents WHERE text IS NOT NULL AND text <> ''
  UNION ALL
  SELECT doc_id, list_append(path, k), piece, j,
         CASE WHEN length(piece) < {size} THEN 'small' WHEN j < {n} AND found THEN 'split' ELSE 'big' END
  FROM (
    SELECT doc_id, path, j, found, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS k FROM (
      SELECT doc_id, path, j, found,
             list_filter(list_transform(string_split(txt, {seplist}[j]),
                                        lambda p, i: CASE WHEN i = 1 THEN p ELSE {seplist}[j] || p END), lambda p: p <> '') AS pieces
      FROM (SELECT *, {pick} AS j, len(list_filter(range(lvl + 1, {n} + 1), lambda i: contains(txt, {seplist}[i]))) > 0 AS found
            FROM seg WHERE kind = 'split')))),
leaves AS (SELECT doc_id, path, txt, kind FROM seg WHERE kind <> 'split'),
runs AS (SELECT *, path[1:len(path) - 1] AS parent,
                sum(CASE WHEN kind = 'small' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, path[1:len(path) - 1] ORDER BY path[-1]) AS run
         FROM seg WHERE len(path) > 0),
grp AS (SELECT doc_id, parent, run, min(path) AS first_path, list(txt ORDER BY path[-1]) AS pieces
        FROM runs WHERE kind = 'small' GROUP BY doc_id, parent, run),
merged AS (SELECT doc_id, first_path AS path, list_reduce(pieces, lambda acc, d:
   CASE WHEN acc.total + length(d) > {size} AND len(acc.cur) > 0 THEN
     {{'docs': CASE WHEN regexp_replace(array_to_string(acc.cur, ''), '^\\s+|\\s+$', '', 'g') <> ''
                    THEN list_append(acc.docs, regexp_replace(array_to_string(acc.cur, ''), '^\\s+|\\s+$', '', 'g')) ELSE acc.docs END,
      'cur': list_append(acc.cur[list_filter(range(0, len(acc.cur) + 1), lambda i:
                 NOT (coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) > {overlap}
                      OR (coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) + length(d) > {size}
                          AND coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) > 0)))[1] + 1:], d),
      'total': coalesce(list_sum(list_transform(acc.cur[list_filter(range(0, len(acc.cur) + 1), lambda i:
                 NOT (coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) > {overlap}
                      OR (coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) + length(d) > {size}
                          AND coalesce(list_sum(list_transform(acc.cur[i + 1:], lambda z: length(z))), 0) > 0)))[1] + 1:], lambda z: length(z))), 0) + length(d)}}
   ELSE {{'docs': acc.docs, 'cur': list_append(acc.cur, d), 'total': acc.total + length(d)}} END,
   {{'docs': []::VARCHAR[], 'cur': []::VARCHAR[], 'total': 0::BIGINT}}) AS st FROM grp),
fixed AS (SELECT doc_id, path, list_concat(st.docs,
            CASE WHEN regexp_replace(array_to_string(st.cur, ''), '^\\s+|\\s+$', '', 'g') <> ''
                 THEN [regexp_replace(array_to_string(st.cur, ''), '^\\s+|\\s+$', '', 'g')] ELSE []::VARCHAR[] END) AS outs
          FROM merged),
allp AS (SELECT doc_id, path, 0 AS sub, txt AS chunk FROM leaves WHERE kind = 'big'
         UNION ALL SELECT doc_id, path, unnest(range(0, len(outs))) AS sub, unnest(outs) AS chunk FROM fixed),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path, sub) - 1 AS chunk_index,
             count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM allp)
SELECT doc_id, printf('%s_chunk_%04d', CAST(doc_id AS VARCHAR), chunk_index) AS chunk_id,
       CAST(length(chunk) AS BIGINT) AS chunk_length, CAST(total_chunks AS BIGINT) AS total_chunks FROM o"""



@register("chunk_separators", c6_sql())
def chunk_separators(t):
    """Priority-separator splitter, 1000/200."""
    return chunking.chunk_separators(t.documents).select("doc_id", "chunk_id", "chunk_length", "total_chunks")


@register("chunk_pages", f"""
WITH ch AS {window_chunks_sql()},
pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no
       FROM documents),
pr AS (SELECT chunk_id, doc_id, string_split(chunk_text, chr(10)) AS probes FROM ch),
hit AS (SELECT pr.chunk_id, pg.page_no FROM pr JOIN pg ON pg.doc_id = pr.doc_id
        WHERE len(list_filter(pr.probes, lambda l: contains(pg.page, l))) > 0)
SELECT pr.chunk_id, coalesce((SELECT string_agg(CAST(page_no AS VARCHAR), '|' ORDER BY page_no) FROM hit
                              WHERE hit.chunk_id = pr.chunk_id), '1') AS page_numbers
FROM pr""")
def chunk_pages(t):
    """Pages (here: the lines of the document) holding any line
    of the chunk; [1] when none does. The pages live in the
    document row, so the in-row form is used (``chunk_pages`` joins an
    external page table instead)."""
    docs = t.documents.select("doc_id", "text", F.split("text", "\n", -1).alias("pages"))
    r = chunking.chunk_window_pages(docs)
    return r.select("chunk_id", F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), "|")
                    .alias("page_numbers"))


def _ingest_meta_sql() -> str:
    from .common import sql_classify, sql_contains_any, sql_count_present, sql_str_list
    lt = "lower(piece)"
    body = BOUNDARY_SQL.rsplit("SELECT doc_id, CAST(doc_id AS VARCHAR)", 1)[0]
    return body + f"""
SELECT doc_id, CAST(doc_id AS VARCHAR) || '_chunk_' || CAST(i AS VARCHAR) AS chunk_id,
  {sql_classify(lt, L.SECTION_CLASSES, 'general')} AS section_type,
  {sql_classify(lt, L.DOCUMENT_TYPE_CLASSES, 'general')} AS document_type,
  {sql_classify(lt, L.EQUIPMENT_CLASSES, 'general')} AS equipment_type,
  {sql_classify(lt, L.SAFETY_CLASSES, L.SAFETY_DEFAULT)} AS safety_level,
  {sql_classify(lt, L.PROCESS_CLASSES, 'general')} AS process_category,
  least(10, {sql_count_present(lt, L.TECHNICAL_INDICATORS)}) AS technical_complexity,
  array_to_string(list_filter({sql_str_list(L.TAG_TERMS)}, lambda x: contains({lt}, x)), '|') AS keyword_tags,
  {sql_contains_any(lt, L.DIAGRAM_INDICATORS)} AS has_diagrams,
  round(CAST({_quality_sql('piece')} AS DOUBLE), 6) AS quality_score,
  md5(piece) AS chunk_hash
FROM k"""


@register("ingest_metadata", _ingest_meta_sql())
def ingest_metadata(t):
    """H1 without the embedding step: boundary chunks (C5) with section,
    document, equipment, safety and process classes, complexity, tags,
    diagram flag, quality score and content hash (P1, P9, P11-P18)."""
    ch = chunking.chunk_boundary(t.documents)
    m = E.manufacturing_metadata(ch).withColumn("chunk_hash", F.md5("chunk_text"))
    return m.select("doc_id", "chunk_id", "section_type", "document_type", "equipment_type", "safety_level",
                    "process_category", "technical_complexity", F.array_join("keyword_tags", "|").alias("keyword_tags"),
                    "has_diagrams", F.round("quality_score", 6).alias("quality_score"), "chunk_hash")


@register("embedding_vectors", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM documents
           WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS BIGINT) AS dim,
             CASE WHEN (CAST(('0x' || substr(md5(tok), 9, 1)) AS BIGINT) & 1) = 1 THEN 1.0 ELSE -1.0 END AS sgn FROM t),
s AS (SELECT doc_id, dim, sum(sgn) AS v FROM b GROUP BY doc_id, dim),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS nrm FROM s GROUP BY doc_id)
SELECT s.doc_id, s.dim, round(CAST(s.v AS DOUBLE) / n.nrm, 6) AS value
FROM s JOIN n USING (doc_id) WHERE s.v <> 0 AND n.nrm > 0""")
def embedding_vectors(t):
    """V5: the bundled hash embedder over whole documents in Arrow batches;
    the non-zero coordinates of every vector."""
    e = EM.embed_batches(t.documents.select("doc_id", "text"), "text")
    x = e.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return x.where(F.col("value") != 0).select("doc_id", F.col("dim").cast("long").alias("dim"),
                                              F.round("value", 6).alias("value"))


# oracles that need SQL text defined further down in this module
from .common import ORACLES as _ORACLES  # noqa: E402

_ORACLES["batch_ingest"] = _batch_ingest_sql().strip()
_ORACLES["ingest_counts"] = f"""
WITH bi AS ({_ingest_meta_sql()})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS total_documents,
       CAST(count(DISTINCT doc_id) AS BIGINT) AS processed_documents, CAST(count(*) AS BIGINT) AS processed_chunks,
       CAST(0 AS BIGINT) AS failed_chunks FROM bi""".strip()

from .search import JACCARD_SQL as _JACCARD_SQL  # noqa: E402

_ORACLES["compare_systems"] = f"""
WITH jq AS ({_JACCARD_SQL})
SELECT round(avg(jaccard), 6) AS average_similarity, CAST(count(*) AS BIGINT) AS queries,
       avg(jaccard) < 0.7 AS has_issue, avg(jaccard) < 0.8 AS needs_tuning FROM jq""".strip()
