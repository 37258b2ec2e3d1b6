"""Search, ranking, filters and set operators on the fixture chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import vectors as V
from ..operators import search as S
from ..plans import fixtures as FX
from ..plans import retrieval
from .common import (cosine_sql, keyword_rows_sql, register, search_chunks_ctes, sql_str_list,
                     window_chunks_sql)

W_KW = repr((1 - L.HYBRID_ALPHA) * L.HYBRID_KEYWORD_WEIGHT)

# query keywords: top-5 keywords of the document with the query's id
QK_CTES = f"""
qkr AS {keyword_rows_sql('(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)',
                         'doc_id', 'text', L.STOP_WORDS, L.KEYWORD_MIN_LEN)},
qkg AS (SELECT doc_id, w, count(*) AS cnt, min(pos) AS fp FROM qkr GROUP BY doc_id, w),
qko AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fp) AS rn FROM qkg),
qk AS (SELECT doc_id AS query_id, w FROM qko WHERE rn <= 5)"""

HYBRID_CORE = f"""
WITH {search_chunks_ctes()},
{QK_CTES},
m AS (SELECT qk.query_id, ck.chunk_id, count(*) AS matches FROM qk JOIN ck ON ck.w = qk.w GROUP BY 1, 2),
s AS (SELECT q.vec_id AS query_id, sc.doc_id, sc.chunk_id,
             {cosine_sql('ce.embedding', 'q.embedding')} AS sem,
             CASE WHEN sc.nkw > 0 THEN coalesce(m.matches, 0) / CAST(sc.nkw AS DOUBLE) ELSE 0.0 END AS kw,
             sc.importance_score
      FROM embeddings q CROSS JOIN sc JOIN embeddings ce ON ce.vec_id = sc.doc_id
      LEFT JOIN m ON m.query_id = q.vec_id AND m.chunk_id = sc.chunk_id),
h AS (SELECT *, round(0.7 * sem + CAST('{W_KW}' AS DOUBLE) * kw + importance_score * 0.2, 9) AS hyb
      FROM s WHERE sem > 0.3 OR kw > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hyb DESC, chunk_id) AS rank FROM h)"""

HYBRID_SQL = HYBRID_CORE + """
SELECT query_id, doc_id, chunk_id, round(sem, 6) AS semantic_score, round(kw, 6) AS keyword_score,
       round(hyb, 6) AS hybrid_score, rank
FROM r WHERE rank <= 10"""


def _hybrid(t):
    return S.hybrid_search(FX.search_chunks(t), FX.vector_queries(t, with_keywords=True), k=10)


@register("hybrid_search", HYBRID_SQL)
def hybrid_search(t):
    """R4 + J2 + R3 + F5: hybrid score over one scan, top-10 per query."""
    r = _hybrid(t)
    return r.select("query_id", "doc_id", "chunk_id", F.round("semantic_score", 6).alias("semantic_score"),
                    F.round("keyword_score", 6).alias("keyword_score"),
                    F.round("hybrid_score", 6).alias("hybrid_score"), F.col("rank").cast("long").alias("rank"))


@register("keyword_score", f"""
WITH {search_chunks_ctes()},
{QK_CTES},
m AS (SELECT qk.query_id, ck.chunk_id, count(*) AS matches FROM qk JOIN ck ON ck.w = qk.w GROUP BY 1, 2)
SELECT m.query_id, m.chunk_id, round(m.matches / CAST(sc.nkw AS DOUBLE), 6) AS keyword_score
FROM m JOIN sc ON sc.chunk_id = m.chunk_id
WHERE sc.doc_id = m.query_id""")
def keyword_score(t):
    """R3 + F4: keyword share of every chunk of the query's own document
    (the EXISTS-overlap rows), as a Column expression after an equi-join."""
    ch = FX.search_chunks(t)
    q = FX.vector_queries(t, with_keywords=True).select(F.col("query_id").alias("doc_id"),
                                                        F.col("keywords").alias("qk"))
    j = ch.join(q, "doc_id").where(S.keyword_overlap_exists("keywords", "qk"))
    return j.select(F.col("doc_id").alias("query_id"), "chunk_id",
                    F.round(S.keyword_score("keywords", "qk"), 6).alias("keyword_score"))


FILTER_SOURCES = [f"src{i}" for i in range(0, 20, 2)]
FILTERED_SQL = f"""
WITH {search_chunks_ctes()},
f AS (SELECT * FROM sc WHERE lang IN ('en', 'fr') AND source IN {tuple(FILTER_SOURCES)} AND quality_score >= 1.0),
s AS (SELECT q.vec_id AS query_id, f.doc_id, f.chunk_id, f.quality_score,
             {cosine_sql('ce.embedding', 'q.embedding')} AS score
      FROM embeddings q CROSS JOIN f JOIN embeddings ce ON ce.vec_id = f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, quality_score DESC, chunk_id) AS rank
      FROM s WHERE score >= 0.3)
SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, quality_score, rank FROM r WHERE rank <= 5"""


@register("filtered_search", FILTERED_SQL)
def filtered_search(t):
    """R2 + F1 + F2(>=): typed filters, then top-5 by similarity, quality."""
    pred = S.search_filters(document_types=["en", "fr"], facilities=FILTER_SOURCES, min_quality_score=1.0,
                            columns={"document_type": "lang", "facility": "source"})
    ch = FX.search_chunks(t).where(pred)
    r = retrieval.top_k_by_vector(ch, FX.vector_queries(t), k=5, threshold=0.3, strict=False,
                                  key_cols=("doc_id", "chunk_id"), tie_cols=("chunk_id",),
                                  secondary="quality_score")
    return r.select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "quality_score",
                    F.col("rank").cast("long").alias("rank"))


SEM20 = f"""
WITH ch AS {window_chunks_sql(source="(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")},
s AS (SELECT q.vec_id AS query_id, q.label AS qlabel, ch.doc_id, ch.chunk_id, ce.label AS clabel,
             {cosine_sql('ce.embedding', 'q.embedding')} AS score
      FROM embeddings q CROSS JOIN ch JOIN embeddings ce ON ce.vec_id = ch.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM s WHERE score > 0.3)"""


def _semantic(t, k):
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False)
    return retrieval.semantic_search(chunks, retrieval.query_vectors(t.embeddings), k=k)


def _label_scores(t, res):
    e = t.embeddings
    j = res.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("clabel")), "doc_id") \
           .join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    return j.select("query_id", "chunk_id",
                    F.when(F.col("clabel") == F.col("qlabel"), 1.0).otherwise(0.0).alias("rerank_score"))


@register("enhanced_search", SEM20 + """,
rr AS (SELECT *, CASE WHEN clabel = qlabel THEN 1.0 ELSE 0.0 END AS rerank_score
       FROM r WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rr)
SELECT query_id, chunk_id, CAST(rerank_score AS DOUBLE) AS rerank_score, rank AS prior_rank, new_rank AS rank
FROM o WHERE new_rank <= 10""")
def enhanced_search(t):
    """R5 + R6: over-fetch 2k=20, rerank them by an external score
    table (label agreement), stable, cut to k=10."""
    res = _semantic(t, 20)
    rr = S.rerank(res, _label_scores(t, res), top_k=10)
    return rr.select("query_id", "chunk_id", "rerank_score", F.col("prior_rank").cast("long").alias("prior_rank"),
                     F.col("rank").cast("long").alias("rank"))


@register("context_assembly", SEM20 + """
SELECT r.query_id, string_agg(ch.chunk_text, chr(10) || chr(10) ORDER BY r.rank) AS context,
       CAST(count(*) AS BIGINT) AS n_context
FROM r JOIN ch ON ch.chunk_id = r.chunk_id WHERE r.rank <= 3 GROUP BY r.query_id""")
def context_assembly(t):
    """First three result texts joined by a blank line."""
    res = _semantic(t, 5)
    from ..operators import chunking
    return S.context_assembly(res, chunking.chunk_window(t.documents), n=3)


@register("retrieve_with_source", SEM20 + """
SELECT r.query_id, r.chunk_id, d.source, d.lang, round(r.score, 6) AS score, r.rank
FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 5""")
def retrieve_with_source(t):
    """Results with their source and type columns."""
    res = _semantic(t, 5)
    d = t.documents.select("doc_id", "source", "lang")
    return res.join(d, "doc_id").select("query_id", "chunk_id", "source", "lang", "score", "rank")


@register("response_record", SEM20 + """
SELECT query_id, CAST(count(*) AS BIGINT) AS num_results, 'semantic' AS search_type,
       string_agg(chunk_id, '|' ORDER BY rank) AS result_ids
FROM r WHERE rank <= 5 GROUP BY query_id""")
def response_record(t):
    """One record per query with its ordered results."""
    rec = S.response_record(_semantic(t, 5), "semantic")
    return rec.select("query_id", "num_results", "search_type",
                      F.array_join(F.transform("results", lambda x: x["chunk_id"]), "|").alias("result_ids"))


@register("top_importance", f"""
WITH {search_chunks_ctes(with_vectors=False)}
SELECT chunk_id, round(importance_score, 6) AS importance_score FROM sc WHERE lang = 'en'
ORDER BY importance_score DESC, chunk_id LIMIT 10""")
def top_importance(t):
    """Metadata filter, order by importance, limit 10 (a top-k report)."""
    ch = FX.search_chunks(t, with_vectors=False)
    r = S.top_importance(ch, F.col("lang") == "en", n=10)
    return r.select("chunk_id", F.round("importance_score", 6).alias("importance_score"))


@register("random_sample", f"""
SELECT doc_id, chunk_id FROM {window_chunks_sql()} ORDER BY md5(chunk_id || ':42'), chunk_id LIMIT 5""")
def random_sample(t):
    """Seeded sample of 5 chunks (the sample is the feature)."""
    from ..operators import chunking
    return S.random_sample(chunking.chunk_window(t.documents), 5).select("doc_id", "chunk_id")


JACCARD_SQL = f"""
{HYBRID_CORE},
hy AS (SELECT query_id, chunk_id FROM r WHERE rank <= 5),
se AS (SELECT query_id, chunk_id FROM (
         SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, chunk_id) AS rk
         FROM s WHERE sem > 0.3) WHERE rk <= 5),
qs AS (SELECT query_id FROM hy UNION SELECT query_id FROM se),
inter AS (SELECT query_id, count(*) AS n FROM (SELECT * FROM hy INTERSECT SELECT * FROM se) GROUP BY query_id),
uni AS (SELECT query_id, count(*) AS n FROM (SELECT * FROM hy UNION SELECT * FROM se) GROUP BY query_id),
na AS (SELECT query_id, count(*) AS n FROM se GROUP BY query_id),
nb AS (SELECT query_id, count(*) AS n FROM hy GROUP BY query_id)
SELECT qs.query_id, round(CASE WHEN coalesce(na.n, 0) = 0 OR coalesce(nb.n, 0) = 0 THEN 0.0
                          ELSE coalesce(inter.n, 0) / CAST(uni.n AS DOUBLE) END, 6) AS jaccard
FROM qs LEFT JOIN inter USING (query_id) LEFT JOIN uni USING (query_id)
LEFT JOIN na USING (query_id) LEFT JOIN nb USING (query_id)"""


@register("result_jaccard", JACCARD_SQL)
def result_jaccard(t):
    """Jaccard of semantic top-5 vs hybrid top-5 chunk sets per query."""
    ch = FX.search_chunks(t)
    sem = retrieval.top_k_by_vector(ch, FX.vector_queries(t), k=5, threshold=0.3,
                                    key_cols=("doc_id", "chunk_id"), tie_cols=("chunk_id",))
    hyb = S.hybrid_search(ch, FX.vector_queries(t, with_keywords=True), k=5)
    return S.result_jaccard(sem, hyb).select("query_id", F.round("jaccard", 6).alias("jaccard"))


BM25_SQL = f"""
WITH ch AS {window_chunks_sql()},
ct AS (SELECT chunk_id, doc_id, regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM ch),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(toks) AS DOUBLE)) AS avgdl FROM ct),
tf AS (SELECT chunk_id, doc_id, t AS term, CAST(count(*) AS DOUBLE) AS tf, CAST(any_value(dl) AS DOUBLE) AS dl
       FROM (SELECT chunk_id, doc_id, unnest(toks) AS t, len(toks) AS dl FROM ct) GROUP BY chunk_id, doc_id, t),
q AS (SELECT DISTINCT query_id, term FROM (
        SELECT printf('%d_%d', conv_id, turn) AS query_id,
               unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term
        FROM conversations WHERE role = 'user')),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.query_id, tf.doc_id, tf.chunk_id,
             round(sum((tf.tf * CAST(2.2 AS DOUBLE)) / (tf.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE)
                   + CAST(0.75 AS DOUBLE) * tf.dl / st.avgdl))
                   * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1)), 9) AS score
      FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term CROSS JOIN st
      GROUP BY q.query_id, tf.doc_id, tf.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


@register("bm25_search", BM25_SQL)
def bm25_search(t):
    """V4: BM25 top-10 chunks for every user turn of the conversations."""
    from ..operators import chunking
    r = S.bm25_search(chunking.chunk_window(t.documents), FX.text_queries(t), k=10)
    return r.select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("long").alias("rank"))


@register("bm25_score", """
WITH c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS dl, CAST(n_chars % 7 + 1 AS DOUBLE) AS tf FROM documents),
a AS (SELECT avg(dl) AS avgdl, CAST(count(*) AS DOUBLE) AS n FROM c)
SELECT doc_id, round((tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))
                     * ln((n - 10.0 + 0.5) / (10.0 + 0.5) + 1), 6) AS bm25
FROM c CROSS JOIN a""")
def bm25_score(t):
    """V3: the scalar BM25 weight as a Column (tf from the length, df=10)."""
    d = t.documents.select("doc_id", F.length("text").cast("double").alias("dl"),
                           ((F.col("n_chars") % 7) + 1).cast("double").alias("tf"))
    a = d.agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).cast("double").alias("n"))
    return d.crossJoin(a).select("doc_id", F.round(V.bm25_score("tf", "dl", "avgdl", F.lit(10.0), "n"), 6)
                                 .alias("bm25"))


@register("cosine_pairs", f"""
SELECT a.vec_id, {cosine_sql('a.embedding', 'b.embedding').replace('round(', 'round(').replace(', 9)', ', 6)')} AS cosine,
       round(sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                                          lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(t):
    """V1 + V2 + J3: row-wise cosine/euclidean of consecutive vectors
    (positional array join as zip_with)."""
    e = t.embeddings
    j = e.select("vec_id", F.col("embedding").alias("a")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return j.select("vec_id", F.round(V.cosine_similarity("a", "b"), 6).alias("cosine"),
                    F.round(V.euclidean_distance("a", "b"), 6).alias("euclidean"))


@register("embedding_compatibility", """
SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) <= 0 THEN 'missing'
                    WHEN len(embedding) = 64 THEN 'reuse' ELSE 'regenerate' END AS action
FROM embeddings""")
def embedding_compatibility(t):
    """V6: reuse a stored vector iff its dimension equals the target's."""
    return t.embeddings.select("vec_id", V.embedding_compatibility("embedding", 64).alias("action"))


@register("dedup_chunks", f"""
WITH ch AS {window_chunks_sql()},
h AS (SELECT *, md5(chunk_text) AS chunk_hash,
             row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY doc_id, chunk_index) AS rn FROM ch)
SELECT chunk_hash, doc_id, chunk_index, chunk_id FROM h WHERE rn = 1""")
def dedup_chunks(t):
    """First chunk (by document, index) of every distinct content hash."""
    from ..operators import chunking
    ch = chunking.chunk_window(t.documents).withColumn("chunk_hash", F.md5("chunk_text")) \
                 .select("chunk_hash", "doc_id", "chunk_index", "chunk_id")
    return S.dedup_chunks(ch).select("chunk_hash", "doc_id", "chunk_index", "chunk_id")


@register("distinct_values", """
SELECT lang, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM documents GROUP BY lang""")
def distinct_values(t):
    """Distinct facilities per document type."""
    r = S.distinct_values(t.documents, "lang", "source")
    return r.select("lang", F.array_join("source_set", "|").alias("sources"))


@register("append_union", """
SELECT 'document' AS kind, doc_id AS id, lang AS tag FROM documents
UNION ALL SELECT 'page', page_id, NULL FROM pages
UNION ALL SELECT 'probe', item_id, NULL FROM benchmark""")
def append_union(t):
    """U4 + S11 shape: concatenation of sources with missing columns NULL."""
    a = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    b = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    c = t.benchmark.select(F.lit("probe").alias("kind"), F.col("item_id").alias("id"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@register("keyword_overlap_exists", f"""
WITH {search_chunks_ctes(with_vectors=False)}
SELECT DISTINCT chunk_id FROM ck WHERE list_contains({sql_str_list(L.FIXTURE_TERMS)}, w)""")
def keyword_overlap_exists(t):
    """chunks whose keywords overlap a query keyword list."""
    ch = FX.search_chunks(t, with_vectors=False)
    qk = F.array(*[F.lit(x) for x in L.FIXTURE_TERMS])
    return ch.where(S.keyword_overlap_exists("keywords", qk)).select("chunk_id")


@register("disjunctive_null_filter", """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality > 0 OR l.toxic > 0""")
def disjunctive_null_filter(t):
    """OR over columns that are NULL after a left join (NULL OR FALSE drops)."""
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.where((F.col("quality") > 0) | (F.col("toxic") > 0)).select("doc_id", "quality", "toxic")


ENTITLEMENTS = [("reader", "en", "src1"), ("reader", "en", "src2"), ("reader", "fr", "src1"),
                ("auditor", "de", "src3")]


@register("row_access_filter", """
SELECT doc_id FROM documents
WHERE (lang, source) IN (SELECT * FROM (VALUES ('en', 'src1'), ('en', 'src2'), ('fr', 'src1')))""")
def row_access_filter(t):
    """semi-join of documents with the caller role's entitlement rows."""
    spark = t.spark
    ent = spark.createDataFrame(ENTITLEMENTS, "role string, lang string, source string")
    return S.row_access_filter(t.documents, ent, "reader", ["lang", "source"]).select("doc_id")


@register("complete_document", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 100")
def complete_document(t):
    """F7."""
    return t.documents.where(S.complete_document("text")).select("doc_id")


AS_OF = "2024-01-30 00:00:00"


@register("ttl_filter", f"""
SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}'""")
def ttl_filter(t):
    """F8: cache entries (one per log row, expiring 24 h after it) alive at as_of."""
    ev = t.events.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    return ev.where(S.ttl_filter("expires_at", AS_OF)).select("event_id")


@register("recent_window", f"""
SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR""")
def recent_window(t):
    """log rows in the 24 h before as_of."""
    return t.events.where(S.recent_window("ts", AS_OF, 24)).select("event_id")


@register("free_filter", f"""
WITH ch AS {window_chunks_sql(extra=', lang')}
SELECT chunk_id FROM ch WHERE lang = 'de' AND chunk_length < 1000""")
def free_filter(t):
    """a caller-supplied Column predicate ANDed into the search input."""
    from ..operators import chunking
    pred = (F.col("lang") == "de") & (F.col("chunk_length") < 1000)
    return chunking.chunk_window(t.documents, keep=("lang",)).where(pred).select("chunk_id")


@register("hybrid_left_join", f"""
WITH {search_chunks_ctes()},
{QK_CTES},
m AS (SELECT qk.query_id, ck.chunk_id, count(*) AS matches FROM qk JOIN ck ON ck.w = qk.w GROUP BY 1, 2),
kws AS (SELECT m.query_id, m.chunk_id, m.matches / CAST(sc.nkw AS DOUBLE) AS keyword_score
        FROM m JOIN sc ON sc.chunk_id = m.chunk_id WHERE sc.doc_id = m.query_id),
sem AS (SELECT q.vec_id AS query_id, sc.chunk_id, sc.importance_score,
               {cosine_sql('ce.embedding', 'q.embedding')} AS semantic_score
        FROM embeddings q CROSS JOIN sc JOIN embeddings ce ON ce.vec_id = sc.doc_id),
j AS (SELECT sem.*, kws.keyword_score AS kw FROM sem LEFT JOIN kws ON kws.query_id = sem.query_id AND kws.chunk_id = sem.chunk_id
      WHERE sem.semantic_score > 0.3 OR kws.keyword_score > 0),
h AS (SELECT *, round(0.7 * semantic_score + CAST('{W_KW}' AS DOUBLE) * coalesce(kw, 0.0) + importance_score * 0.2, 9) AS hyb FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hyb DESC, chunk_id) AS rank FROM h)
SELECT query_id, chunk_id, round(semantic_score, 6) AS semantic_score, round(coalesce(kw, 0.0), 6) AS keyword_score,
       round(hyb, 6) AS hybrid_score, rank FROM r WHERE rank <= 10""")
def hybrid_left_join(t):
    """J2 + F5: candidates = each query's ten best past the semantic threshold (kept
    inside the scan) plus the pairs of an external keyword-score table (R3 scores of
    each query's own document chunks); candidates LEFT JOIN keyword scores, NULL-aware
    filter, top-10."""
    ch = FX.search_chunks(t)
    kws = keyword_score(t)
    cands = S.hybrid_candidates(ch, FX.vector_queries(t), kws, k=10)
    r = S.hybrid_left_join(cands, kws, k=10)
    return r.select("query_id", "chunk_id", F.round("semantic_score", 6).alias("semantic_score"),
                    F.round("keyword_score", 6).alias("keyword_score"), F.round("hybrid_score", 6).alias("hybrid_score"),
                    F.col("rank").cast("long").alias("rank"))
