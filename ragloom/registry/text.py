"""Projection operators on whole documents, chunks, pages and logs
(P1-P26, H2). Arrays are emitted as '|'-joined strings for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import chunking
from ..operators import enrich as E
from .common import (keyword_rows_sql, register, sql_classify, sql_contains_any,
                     sql_count_present, sql_str_list, window_chunks_sql)

STOPS = L.STOP_WORDS


@register("chunk_hash", "SELECT doc_id, md5(text) AS chunk_hash FROM documents")
def chunk_hash(t):
    """md5 hex of each document text."""
    return t.documents.select("doc_id", X.md5_hex("text").alias("chunk_hash"))


@register("doc_hash_id", "SELECT page_id, substring(md5(url), 1, 12) AS doc_id FROM pages")
def doc_hash_id(t):
    """12-hex id from md5 of the page address."""
    return t.pages.select("page_id", X.doc_hash_id("url").alias("doc_id"))


@register("query_hash", """
SELECT conv_id, turn, md5(concat_ws('_', text, '5', '0.7')) AS query_hash
FROM conversations WHERE role = 'user'""")
def query_hash(t):
    """Cache key over the query text and every search parameter."""
    c = t.conversations.where(F.col("role") == "user")
    return c.select("conv_id", "turn", X.query_hash("text", F.lit("5"), F.lit("0.7")).alias("query_hash"))


@register("query_id", """
SELECT event_id, md5(concat(CAST(user_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))) AS query_id
FROM events""")
def query_id(t):
    """md5(query text + log time); here the text is the user key."""
    ev = t.events
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")   # zone-free
    return ev.select("event_id", X.query_id(F.col("user_id").cast("string"), micros).alias("query_id"))


@register("summary", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS summary
FROM documents""")
def summary(t):
    """P5: 100-character summary."""
    return t.documents.select("doc_id", X.summary("text", 100).alias("summary"))


@register("preview", "SELECT doc_id, substring(text, 1, 200) AS preview_200, substring(text, 1, 500) AS preview_500 FROM documents")
def preview(t):
    """200 and 500 character previews."""
    return t.documents.select("doc_id", X.preview("text", 200).alias("preview_200"),
                              X.preview("text", 500).alias("preview_500"))


KEYWORDS_SQL = f"""
WITH kw AS {keyword_rows_sql('documents', 'doc_id', 'text', STOPS, L.KEYWORD_MIN_LEN)},
g AS (SELECT doc_id, w, count(*) AS cnt, min(pos) AS first_pos FROM kw GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rn FROM g)
SELECT d.doc_id, coalesce(string_agg(r.w, '|' ORDER BY r.rn), '') AS keywords
FROM documents d LEFT JOIN (SELECT * FROM r WHERE rn <= 10) r ON r.doc_id = d.doc_id
GROUP BY d.doc_id"""


@register("extract_keywords", KEYWORDS_SQL)
def extract_keywords(t):
    """Top-10 keywords of every whole document."""
    d = X.with_keywords(t.documents.select("doc_id", "text"), "text", "kw", 10)
    return d.select("doc_id", F.array_join("kw", "|").alias("keywords"))


IMPORTANCE_SQL = f"""
WITH ch AS {window_chunks_sql()},
kw AS {keyword_rows_sql('ch', 'chunk_id', 'chunk_text', STOPS, L.KEYWORD_MIN_LEN)},
nk AS (SELECT chunk_id, count(DISTINCT w) AS nd FROM kw GROUP BY chunk_id)
SELECT ch.chunk_id,
  round(least(greatest(0.5
    + (1.0 - CAST(chunk_index AS DOUBLE) / greatest(CAST(total_chunks AS DOUBLE), 1.0)) * 0.2
    + greatest(0.0, 1.0 - abs(CAST(chunk_length AS DOUBLE) - 500.0) / 500.0) * 0.2
    + least(least(coalesce(nd, 0), 5) / 5.0, 1.0) * 0.1, 0.0), 1.0), 6) AS importance_score
FROM ch LEFT JOIN nk ON nk.chunk_id = ch.chunk_id"""


@register("importance_score", IMPORTANCE_SQL)
def importance_score(t):
    """P8 on 1000/200 window chunks."""
    ch = X.with_keywords(chunking.chunk_window(t.documents), "chunk_text", "kw", 5)
    return ch.select("chunk_id", F.round(E.importance_score("chunk_index", "total_chunks", "chunk_length",
                                                            "kw"), 6).alias("importance_score"))


def _quality_sql(expr: str) -> str:
    ln = f"CAST(length({expr}) AS DOUBLE)"
    lt = f"lower({expr})"
    parts = f"len(list_filter(string_split({expr}, '.'), lambda s: regexp_matches(s, '\\S')))"
    return f"""least(
  (CASE WHEN {ln} < 100 THEN 0.6 WHEN {ln} < 200 THEN 0.8 WHEN {ln} > 2000 THEN 0.9 ELSE 1.0 END)
  + least({sql_count_present(lt, L.QUALITY_TECH_TERMS)} * 0.1, 0.5)
  + least({sql_count_present(lt, L.QUALITY_STRUCTURE_MARKERS)} * 0.05, 0.2)
  + (CASE WHEN {parts} > 0 AND {ln} / {parts} >= 20 AND {ln} / {parts} <= 100 THEN 0.1 ELSE 0.0 END),
  2.0)"""


@register("quality_score", f"SELECT doc_id, round(CAST({_quality_sql('text')} AS DOUBLE), 6) AS quality_score FROM documents")
def quality_score(t):
    """P9 on whole documents."""
    return t.documents.select("doc_id", F.round(E.quality_score("text"), 6).alias("quality_score"))


def _quality_capped_sql(expr: str) -> str:
    ln = f"CAST(length({expr}) AS DOUBLE)"
    avg = f"({ln} / len(string_split({expr}, '.')))"
    return f"""least(
  (CASE WHEN {ln} < 100 THEN 0.5 WHEN {ln} > 2000 THEN 0.8 ELSE 1.0 END)
  * (CASE WHEN {sql_contains_any(f'lower({expr})', L.QUALITY_CAPPED_TERMS)} THEN 1.2 ELSE 1.0 END)
  * (CASE WHEN {avg} >= 50 AND {avg} <= 150 THEN 1.1 ELSE 1.0 END), 1.0)"""


@register("quality_score_capped",
          f"SELECT doc_id, round(CAST({_quality_capped_sql('text')} AS DOUBLE), 6) AS quality_score FROM documents")
def quality_score_capped(t):
    """P10 on whole documents."""
    return t.documents.select("doc_id", F.round(E.quality_score_capped("text"), 6).alias("quality_score"))


def _classify_query(name, classes, default, out, doc):
    sql = f"SELECT doc_id, {sql_classify('lower(text)', classes, default)} AS {out} FROM documents"

    @register(name, sql)
    def q(t):
        return t.documents.select("doc_id", X.classify_ordered("text", classes, default).alias(out))
    q.__doc__ = doc
    return q


_classify_query("classify_section", L.SECTION_CLASSES, "general", "section_type", "P11")
_classify_query("classify_document_type", L.DOCUMENT_TYPE_CLASSES, "general", "document_type", "P12")
_classify_query("classify_equipment", L.EQUIPMENT_CLASSES, "general", "equipment_type", "P13")
_classify_query("classify_safety_level", L.SAFETY_CLASSES, L.SAFETY_DEFAULT, "safety_level", "P14")
_classify_query("classify_process_category", L.PROCESS_CLASSES, "general", "process_category", "P15")
_classify_query("classify_fixture_terms", L.FIXTURE_CLASSES, "general", "term_class",
                "P11-P15 rule engine with a lexicon that fires on the fixture text")


@register("technical_complexity", f"""
SELECT doc_id, least(10, {sql_count_present('lower(text)', L.TECHNICAL_INDICATORS)}) AS technical_complexity
FROM documents""")
def technical_complexity(t):
    """P16."""
    return t.documents.select("doc_id", X.technical_complexity("text").alias("technical_complexity"))


@register("tag_terms", f"""
SELECT doc_id,
  array_to_string(list_filter({sql_str_list(L.TAG_TERMS)}, lambda x: contains(lower(text), x)), '|') AS keyword_tags,
  array_to_string(list_filter({sql_str_list(L.FIXTURE_TERMS)}, lambda x: contains(lower(text), x)), '|') AS fixture_tags
FROM documents""")
def tag_terms(t):
    """P17 with the default and the fixture lexicon."""
    return t.documents.select("doc_id", F.array_join(X.tag_terms("text"), "|").alias("keyword_tags"),
                              F.array_join(X.tag_terms("text", L.FIXTURE_TERMS), "|").alias("fixture_tags"))


@register("has_diagrams", f"""
SELECT doc_id, {sql_contains_any('lower(text)', L.DIAGRAM_INDICATORS)} AS has_diagrams FROM documents""")
def has_diagrams(t):
    """P18."""
    return t.documents.select("doc_id", X.has_any("text").alias("has_diagrams"))


def _name_head_sql():
    whens = " ".join(
        f"WHEN contains(lower(url), '{n}') OR contains(substring(lower(html), 1, {L.NAME_HEAD_CHARS}), '{h}') THEN '{c}'"
        for c, n, h in L.NAME_HEAD_CLASSES)
    return f"SELECT page_id, CASE {whens} ELSE '{L.NAME_HEAD_DEFAULT}' END AS document_class FROM pages"


@register("classify_by_name_and_head", _name_head_sql())
def classify_by_name_and_head(t):
    """P19 on pages: address as file name, HTML head as text."""
    return t.pages.select("page_id", X.classify_by_name_and_head("url", "html").alias("document_class"))


@register("build_metadata", """
SELECT doc_id, CAST(to_json({'title': '', 'document_type': lang, 'facility': source,
                        'chunk_length': CAST(length(text) AS BIGINT), 'total_chunks': CAST(1 AS BIGINT)}) AS VARCHAR) AS metadata
FROM documents""")
def build_metadata(t):
    """P20: metadata JSON per document."""
    d = t.documents
    return d.select("doc_id", E.build_metadata(title=F.lit(""), document_type=F.col("lang"),
                                               facility=F.col("source"),
                                               chunk_length=F.length("text").cast("long"),
                                               total_chunks=F.lit(1).cast("long")).alias("metadata"))


@register("json_value", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_value(t):
    """JSON path read of the log properties."""
    return t.events.select("event_id", X.json_value("props", "$.k").alias("k"))


@register("parse_score_json", r"""
SELECT event_id, CAST(json_extract(regexp_extract(props, '\{[^}]+\}', 0), '$.k') AS DOUBLE) AS k_score
FROM events""")
def parse_score_json(t):
    """First {...} block parsed to a score map; read one score."""
    return t.events.select("event_id", F.element_at(E.parse_score_json("props"), F.lit("k")).alias("k_score"))


@register("metadata_predicate", """
SELECT event_id, event_type FROM events
WHERE json_extract_string(props, '$.k') = '42' AND event_type = 'click'""")
def metadata_predicate(t):
    """P25: typed equality predicates on JSON fields and columns, ANDed."""
    ev = t.events
    return ev.where(E.metadata_predicate("props", {"k": "42"}) & (F.col("event_type") == "click")) \
             .select("event_id", "event_type")


@register("migration_document_id", """
SELECT doc_id, string_split('stores/' || source, '/')[-1] || '_' || printf('%04d', doc_id) AS document_id
FROM documents""")
def migration_document_id(t):
    """Last segment of the store path + zero-padded index."""
    d = t.documents
    return d.select("doc_id", X.migration_document_id(F.concat(F.lit("stores/"), F.col("source")),
                                                      "doc_id").alias("document_id"))


@register("sql_scalars", """
SELECT vec_id,
  CAST(len(embedding) AS BIGINT) AS dims,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm,
  round(ln(1.0 + abs(CAST(embedding[1] AS DOUBLE))), 6) AS log_abs_first,
  coalesce(lower(substring(CAST(label AS VARCHAR), 1, 1)), '?') AS label_head
FROM embeddings""")
def sql_scalars(t):
    """array_length, sqrt, log, abs, round, substr, lower, coalesce."""
    e = t.embeddings
    from ..functions.vectors import sq_norm
    return e.select("vec_id", F.size("embedding").cast("long").alias("dims"),
                    F.round(F.sqrt(sq_norm("embedding")), 6).alias("norm"),
                    F.round(F.log(1.0 + F.abs(F.element_at("embedding", 1).cast("double"))), 6).alias("log_abs_first"),
                    F.coalesce(F.lower(F.substring(F.col("label").cast("string"), 1, 1)), F.lit("?")).alias("label_head"))


ENRICH_SQL = f"""
WITH ch AS {window_chunks_sql(extra=', lang, source', source='documents')},
kw AS {keyword_rows_sql('ch', 'chunk_id', 'chunk_text', STOPS, L.KEYWORD_MIN_LEN)},
g AS (SELECT chunk_id, w, count(*) AS cnt, min(pos) AS first_pos FROM kw GROUP BY chunk_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY cnt DESC, first_pos) AS rn FROM g),
k AS (SELECT chunk_id, string_agg(w, '|' ORDER BY rn) AS keywords, least(count(*), 5) AS n5
      FROM r WHERE rn <= 10 GROUP BY chunk_id)
SELECT ch.doc_id, ch.chunk_id, ch.chunk_index, md5(chunk_text) AS chunk_hash,
  CASE WHEN length(chunk_text) > 100 THEN substring(chunk_text, 1, 100) || '...' ELSE chunk_text END AS summary,
  coalesce(k.keywords, '') AS keywords,
  round(least(greatest(0.5
    + (1.0 - CAST(chunk_index AS DOUBLE) / greatest(CAST(total_chunks AS DOUBLE), 1.0)) * 0.2
    + greatest(0.0, 1.0 - abs(CAST(chunk_length AS DOUBLE) - 500.0) / 500.0) * 0.2
    + least(coalesce(k.n5, 0) / 5.0, 1.0) * 0.1, 0.0), 1.0), 6) AS importance_score,
  CAST(to_json({{'title': '', 'document_type': lang, 'facility': source,
           'chunk_length': chunk_length, 'total_chunks': total_chunks}}) AS VARCHAR) AS metadata
FROM ch LEFT JOIN k ON k.chunk_id = ch.chunk_id"""


@register("enrich_chunks", ENRICH_SQL)
def enrich_chunks(t):
    """H2 with C1: hash, summary, keywords, importance, metadata."""
    ch = chunking.chunk_window(t.documents, keep=("lang", "source"))
    en = E.enrich_chunks(ch, title=F.lit(""), document_type="lang", facility="source")
    return en.select("doc_id", "chunk_id", "chunk_index", "chunk_hash", "summary",
                     F.array_join("keywords", "|").alias("keywords"),
                     F.round("importance_score", 6).alias("importance_score"), "metadata")
