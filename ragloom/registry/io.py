"""Sources, sinks and streams on the fixture tables.

Round-trip queries write a table derived from the fixtures to a fresh
folder under the shared checkpoint folder and read it back with the
matching source operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunking
from ..session import scratch_path
from ..sinks import writers as K
from ..sources import documents as D
from ..sources import web as W
from ..streaming import streams as ST
from .common import register, window_chunks_sql


def _tmp(t, name):
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex[:12]}")


HTML_SQL = r"""
SELECT page_id, 'page_' || lower(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]) AS document_id,
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
      '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS content
FROM pages"""


@register("html_to_text", HTML_SQL)
def html_to_text(t):
    """Whole-page text of every HTML page."""
    p = t.pages
    return p.select("page_id", W.page_document_id("url").alias("document_id"), W.html_to_text("html").alias("content"))


def _links_sql(suffix: str) -> str:
    return rf"""
WITH tags AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(<a\s[^>]*>)', 1)) AS tag,
                     unnest(range(0, len(regexp_extract_all(html, '(<a\s[^>]*>)', 1)))) AS pos FROM pages),
l AS (SELECT page_id, url, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
             regexp_extract(tag, 'title="([^"]*)"', 1) AS title_attr FROM tags),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS link_rank
      FROM l WHERE href <> '' AND ends_with(href, '{suffix}')),
a AS (SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
             regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme,
             regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') || '/' AS dir0 FROM f),
b AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
                     WHEN starts_with(href, '//') THEN scheme || ':' || href
                     WHEN starts_with(href, '/') THEN origin || href
                     ELSE (CASE WHEN dir0 = origin || '/' OR dir0 = origin THEN origin || '/' ELSE dir0 END) || href END AS pdf_url
      FROM a)
SELECT page_id, link_rank, pdf_url, CASE WHEN title_attr <> '' THEN title_attr ELSE string_split(pdf_url, '/')[-1] END AS title,
       url AS source FROM b"""


@register("pdf_links", _links_sql(".pdf"))
def pdf_links(t):
    """PDF links of every page (the fixture pages have none)."""
    r = W.pdf_links(t.pages)
    return r.select("page_id", F.col("link_rank").cast("long").alias("link_rank"), "pdf_url", "title", "source")


@register("page_links", _links_sql(""))
def page_links(t):
    """S6 with an empty suffix: all links of every page, absolute."""
    r = W.pdf_links(t.pages, suffix="")
    return r.select("page_id", F.col("link_rank").cast("long").alias("link_rank"), "pdf_url", "title", "source")


@register("json_roundtrip", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS document_id, md5(text) AS content_hash, "
          "lang AS document_type, source AS facility FROM documents")
def json_roundtrip(t):
    """K3 + S2: documents written as JSON lines and read back by schema."""
    path = _tmp(t, "json-docs")
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
                              F.lit("").alias("title"), F.col("text").alias("content"),
                              F.col("lang").alias("document_type"), F.col("source").alias("facility"),
                              F.lit("fixture").alias("source"), F.lit(None).cast("string").alias("created_date"))
    K.write_json_documents(docs, path)
    back = D.read_json_documents(t.spark, path)
    return back.select("document_id", F.md5("content").alias("content_hash"), "document_type", "facility")


QA = """(SELECT u.conv_id * 1000 + u.turn AS row_order, NULL AS domain, u.text AS question, a.text AS context,
            NULL AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant')"""
CORPUS_TERMS = ["that", "tion"]


@register("filter_external_corpus", f"""
WITH qa AS {QA},
k AS (SELECT * FROM qa WHERE contains(lower(coalesce(domain, '')), 'that') OR contains(lower(coalesce(domain, '')), 'tion')
        OR contains(lower(coalesce(question, '')), 'that') OR contains(lower(coalesce(question, '')), 'tion')
        OR contains(lower(coalesce(context, '')), 'that') OR contains(lower(coalesce(context, '')), 'tion'))
SELECT 'ragbench_' || CAST(row_number() OVER (ORDER BY row_order) - 1 AS VARCHAR) AS id, question AS title,
       CAST(length(context) AS BIGINT) AS content_length FROM k""")
def filter_external_corpus(t):
    """S3: QA pairs (user turn + next assistant turn) filtered by keywords,
    numbered densely in conversation order."""
    c = t.conversations
    u = c.where(F.col("role") == "user").alias("u")
    a = c.where(F.col("role") == "assistant").alias("a")
    qa = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)) \
          .select((F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("row_order"),
                  F.lit(None).cast("string").alias("domain"), F.col("u.text").alias("question"),
                  F.col("a.text").alias("context"), F.lit(None).cast("string").alias("answer"))
    r = D.filter_external_corpus(qa, CORPUS_TERMS)
    return r.select("id", "title", F.length("content").cast("long").alias("content_length"))


@register("atom_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS document_id, lang AS title, trim(replace(text, chr(10), ' ')) AS summary
FROM documents""")
def atom_roundtrip(t):
    """Documents rendered as Atom entries (XML-escaped) and parsed back."""
    def esc(c):
        c = F.replace(c, F.lit("&"), F.lit("&amp;"))
        c = F.replace(c, F.lit("<"), F.lit("&lt;"))
        return F.replace(c, F.lit(">"), F.lit("&gt;"))
    d = t.documents
    xml = F.concat(F.lit("<entry><title>"), esc(F.col("lang")), F.lit("</title><summary>"),
                   esc(F.col("text")), F.lit("</summary><id>http://example.org/abs/"),
                   F.col("doc_id").cast("string"), F.lit("</id><published>2024-01-01</published></entry>"))
    r = D.parse_atom_entries(d.select(xml.alias("entry_xml")))
    return r.select("document_id", "title", "summary")


@register("store_export_roundtrip", f"""
SELECT chunk_id AS id, CAST(doc_id AS VARCHAR) AS name, CAST(length(chunk_text) AS BIGINT) AS n,
  md5(chunk_text) AS content_hash, CAST(len(embedding) AS BIGINT) AS dims,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[-1] AS DOUBLE), 6) AS last_value
FROM {window_chunks_sql()} c LEFT JOIN embeddings e ON e.vec_id = c.doc_id""")
def store_export_roundtrip(t):
    """K8 + S7: export a chunk table (renamed, with text and vectors) and
    extract it, so that nothing has to be embedded again."""
    path = _tmp(t, "export")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>"))
    ch = chunking.chunk_window(t.documents).join(vectors, "doc_id", "left").select(
        "chunk_id", F.col("doc_id").cast("string").alias("name"), "chunk_text", "embedding")
    K.export_chunks(ch, path, rename={"chunk_id": "id", "chunk_text": "content"})
    r = D.extract_store_documents(t.spark, path)
    v = F.col("embedding")
    return r.select("id", "name", F.length("content").cast("long").alias("n"), F.md5("content").alias("content_hash"),
                    F.when(v.isNotNull(), F.size(v)).cast("long").alias("dims"),
                    F.round(v[0], 6).alias("first_value"), F.round(F.element_at(v, -1), 6).alias("last_value"))


@register("extract_content_fields", "SELECT page_id, html || chr(10) || chr(10) || url AS content FROM pages")
def extract_content_fields(t):
    """Raw bytes decoded as UTF-8 joined with the other text fields."""
    p = t.pages.withColumn("raw", F.encode("html", "UTF-8"))
    return p.select("page_id", D.extract_content_fields("raw", "url", ["url"]).alias("content"))


@register("generate_documents", """
WITH tpl AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS t, text FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark)
SELECT printf('doc_%04d', doc_id) AS document_id, tpl.text AS content, 'FAB-' || CAST(doc_id % 3 + 1 AS VARCHAR) AS facility
FROM documents, n JOIN tpl ON tpl.t = documents.doc_id % n.n""")
def generate_documents(t):
    """One generated document per fixture document id, templates from
    the probe passages."""
    tpl = t.benchmark.select(F.col("item_id").alias("template_order"), F.col("text").alias("template"))
    return D.generate_documents(t.documents.select(F.col("doc_id").alias("i")), tpl)


@register("union_sources", """
WITH u AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS document_id, 'documents' AS source FROM documents
           UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), 'pages' FROM pages
           UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), 'benchmark' FROM benchmark)
SELECT document_id, source FROM u""")
def union_sources(t):
    """Three sources, all included, whole."""
    srcs = {"documents": t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id")),
            "pages": t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("document_id")),
            "benchmark": t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("document_id"))}
    return D.union_sources(srcs).select("document_id", "source")


@register("normalize_documents", """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS document_id, lang AS document_type, source AS facility, 'fixture' AS source,
       '1.0' AS version FROM documents
UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), role, 'unknown', 'manual_upload', '1.0'
FROM conversations""")
def normalize_documents(t):
    """Two document spellings reconciled with defaults."""
    a = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
                           F.col("text").alias("content"), F.col("lang").alias("document_type"),
                           F.col("source").alias("facility"), F.lit("fixture").alias("source"))
    b = t.conversations.select(F.format_string("c%d_%d", "conv_id", "turn").alias("id"), F.col("text"),
                               F.col("role").alias("doc_type"), F.lit(None).cast("string").alias("facility_code"))
    n = D.normalize_documents(a.unionByName(b, allowMissingColumns=True))
    return n.select("document_id", "document_type", "facility", "source", "version")


@register("append_chunks", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS chunks FROM {window_chunks_sql(extra=', lang')} GROUP BY lang""")
def append_chunks(t):
    """K1 + K6: chunks appended partitioned by a day-like column (the
    document type here) and clustered; read back with partition pruning
    per value."""
    path = _tmp(t, "chunks")
    ch = chunking.chunk_window(t.documents, keep=("lang",))
    K.append_chunks(ch, path, day_col="lang")
    back = t.spark.read.parquet(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"))


@register("batch_insert", """
SELECT CAST(sum(CASE WHEN length(text) >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
       CAST(sum(CASE WHEN length(text) >= 50 THEN 0 ELSE 1 END) AS BIGINT) AS rejected FROM documents""")
def batch_insert(t):
    """K2: rows failing validation go to a reject table."""
    path, rej = _tmp(t, "insert"), _tmp(t, "reject")
    K.batch_insert(t.documents, path, rej, F.length("text") >= 50)
    a = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("inserted"))
    b = t.spark.read.parquet(rej).agg(F.count(F.lit(1)).alias("rejected"))
    return a.crossJoin(b)


@register("evolve_schema", """
SELECT doc_id, lang, md5(text) AS chunk_hash, CAST(NULL AS VARCHAR) AS summary,
       CAST(NULL AS DOUBLE) AS importance_score FROM documents""")
def evolve_schema(t):
    """K5: missing required columns added as typed NULLs, present ones kept."""
    req = {"summary": T.StringType(), "importance_score": T.DoubleType(), "chunk_hash": T.StringType()}
    return K.evolve_schema(t.documents.select("doc_id", "lang", F.md5("text").alias("chunk_hash")), req)


@register("stream_query_metrics", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(count(*) AS BIGINT) AS queries,
       round(avg(value), 6) AS avg_ms, max(value) AS max_ms,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
       max(value) > 2000 AS latency_alert, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05 AS error_alert
FROM events GROUP BY 1""")
def stream_query_metrics(t):
    """ST3 (batch form of the streaming plan): hourly windows with alerts."""
    r = ST.query_metrics(t.events)
    return r.select("window_start", "queries", F.round("avg_ms", 6).alias("avg_ms"), "max_ms",
                    F.round("error_rate", 6).alias("error_rate"), "latency_alert", "error_alert")


_WINDOW_METRICS = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(count(*) AS BIGINT) AS queries,
       round(avg(value), 6) AS avg_ms, max(value) AS max_ms,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM events GROUP BY 1"""


@register("stream_query_metrics_run", _WINDOW_METRICS)
def stream_query_metrics_run(t):
    """ST3 on a stream: the query log as a file stream of several
    micro-batches, windowed with state and kept as a table."""
    src, sink, ck = _tmp(t, "log"), _tmp(t, "metrics"), _tmp(t, "ckpt")
    log = t.events.select("ts", "value", "event_type")
    log.repartition(8).write.parquet(src)
    stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(src)
    ST.run_complete(ST.query_metrics(stream), sink, ck)
    return t.spark.read.parquet(sink).select("window_start", "queries", F.round("avg_ms", 6).alias("avg_ms"),
                                             "max_ms", F.round("error_rate", 6).alias("error_rate"))


@register("stream_documents", f"SELECT DISTINCT md5(chunk_text) AS chunk_hash FROM {window_chunks_sql()}")
def stream_documents(t):
    """ST1 + ST2 + H4: documents as JSON messages -> file stream (4 files
    per micro-batch) -> chunk + enrich -> dedup of chunk hashes within a
    watermark that spans the whole message time range -> exactly-once file
    sink, processed with availableNow; the sink holds one row per distinct
    chunk hash (which duplicate survives depends on batch order, the set
    does not)."""
    spark = t.spark
    src, sink, ck = _tmp(t, "msgs"), _tmp(t, "sink"), _tmp(t, "ckpt")
    msgs = t.documents.select("doc_id", "text", "lang", "source",
                              (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                               + F.make_interval(mins=(F.col("doc_id") % 600).cast("int"))).alias("published_at"))
    msgs.write.mode("overwrite").json(src)
    out = ST.dedup_stream(ST.process_documents(ST.document_stream(spark, src, max_files=4)), delay="24 hours")
    out = out.select("doc_id", "chunk_id", "chunk_hash", "importance_score", "published_at")
    ST.run_available_now(out, sink, ck)
    return spark.read.parquet(sink).select("chunk_hash")


@register("stream_dedup_accounts", f"""
WITH ch AS (SELECT md5(chunk_text) AS chunk_hash, doc_id FROM {window_chunks_sql()})
SELECT 'kept' AS fate, CAST(count(DISTINCT chunk_hash) AS BIGINT) AS rows FROM ch
UNION ALL SELECT 'repeated', CAST(count(*) - count(DISTINCT chunk_hash) AS BIGINT) FROM ch
UNION ALL SELECT 'late', CAST(count(*) FILTER (doc_id % 10 = 0) AS BIGINT) FROM ch""")
def stream_dedup_accounts(t):
    """ST2 with late rows: all documents as messages of one day, then a tenth of them again
    a week too late; the run's accounts add up to every row that came in."""
    src, folder = _tmp(t, "msgs"), _tmp(t, "dedup")
    start = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    docs = t.documents.select("doc_id", "text", "lang", "source")
    at = start + F.make_interval(mins=(F.col("doc_id") % 600).cast("int"))
    docs.withColumn("published_at", at).coalesce(4).write.json(src)
    stream = ST.document_stream(t.spark, src, max_files=1)
    chunks = ST.process_documents(stream).select("doc_id", "chunk_id", "chunk_hash", "published_at")
    ST.run_dedup(chunks, folder, delay="24 hours")
    old = docs.where(F.col("doc_id") % 10 == 0).withColumn("published_at", start - F.expr("INTERVAL 7 DAYS"))
    old.coalesce(1).write.mode("append").json(src)
    _, late, marks = ST.run_dedup(chunks, folder, delay="24 hours")
    total = marks.agg(*[F.sum(c).cast("long").alias(c) for c in ("kept", "repeated")]).crossJoin(
        late.agg(F.count(F.lit(1)).alias("late")))
    return total.select(F.expr("stack(3, 'kept', kept, 'repeated', repeated, 'late', late) AS (fate, rows)"))


@register("coalesce_embedding_fields", """
SELECT vec_id, CAST(CASE WHEN label % 2 = 0 THEN 64 ELSE 63 END AS INTEGER) AS dims,
       round(CAST(CASE WHEN label % 2 = 0 THEN embedding[1] ELSE embedding[2] END AS DOUBLE), 6) AS first_value
FROM embeddings""")
def coalesce_embedding_fields(t):
    """The first present vector field (``embedding`` only on even
    labels here, else the derived ``vector`` field)."""
    e = t.embeddings.select("vec_id", F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("embedding_field"),
                            F.slice("embedding", 2, 63).alias("vector_field"))
    v = D.coalesce_embedding_fields("embedding_field", "vector_field")
    return e.select("vec_id", F.size(v).alias("dims"),
                    F.round(F.element_at(v, 1).cast("double"), 6).alias("first_value"))


@register("write_text_documents", """
SELECT 'line' AS kind, md5(line) AS value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(string_split('Title: ' || coalesce(source, '') || chr(10) || chr(10) || coalesce(text, ''), chr(10))) AS line
  FROM documents) GROUP BY ALL
UNION ALL
SELECT 'metadata', concat_ws('|', CAST(doc_id AS VARCHAR), source, lang), CAST(count(*) AS BIGINT)
FROM documents GROUP BY ALL""")
def write_text_documents(t):
    """K4: 'Title: t' + blank line + content per document (hash-bucketed
    files, metadata as a sibling table); every line and every metadata row
    is read back."""
    path = _tmp(t, "text-docs")
    docs = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("title"),
                              F.col("text").alias("content"), "lang")
    K.write_text_documents(docs, path, buckets=8)
    lines = t.spark.read.option("lineSep", "\n").text(path + "/text")
    lines = lines.select(F.lit("line").alias("kind"), F.md5("value").alias("value"))
    rows = t.spark.read.parquet(path + "/metadata").select(
        F.lit("metadata").alias("kind"), F.concat_ws("|", "document_id", "title", "lang").alias("value"))
    return lines.union(rows).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@register("save_report", """
SELECT lang AS document_type, CAST(count(*) AS BIGINT) AS documents,
       CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang""")
def save_report(t):
    """K7: a report table written as one JSON file and read back."""
    path = _tmp(t, "report")
    rep = t.documents.groupBy(F.col("lang").alias("document_type")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).cast("long").alias("characters"))
    K.save_report(rep, path)
    return t.spark.read.schema("document_type string, documents long, characters long").json(path)


@register("enhance_migrated_document", """
SELECT 'migrated_' || CAST(doc_id AS VARCHAR) AS id, lang AS meta_lang, 'v1' AS meta_migration, source AS meta_source
FROM documents""")
def enhance_migrated_document(t):
    """Id prefixed, extra metadata merged with original keys winning."""
    from ..operators import enrich as EN
    d = t.documents.select(F.col("doc_id").cast("string").alias("id"),
                           F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    r = EN.enhance_migrated_document(d, extra={"migration": "v1", "lang": "xx"})
    return r.select("id", F.col("metadata")["lang"].alias("meta_lang"),
                    F.col("metadata")["migration"].alias("meta_migration"),
                    F.col("metadata")["source"].alias("meta_source"))
