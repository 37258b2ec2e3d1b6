"""Approximate search (V7) and the SQL-surface items."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import functions as F

from ..operators import ivf
from ..plans import retrieval
from ..session import scratch_path
from .common import cosine_sql, register, window_chunks_sql

N_LISTS, NPROBE = 8, 3


def _ivf(t):
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False).select("doc_id", "chunk_id", "embedding")
    cents, assigned = ivf.ivf_build(chunks, n_lists=N_LISTS, seed=7)
    idx = ivf.ivf_write_index(assigned, scratch_path(t.spark, f"ivf-{uuid.uuid4().hex[:12]}"))
    return idx, cents, chunks, retrieval.query_vectors(t.embeddings)


@register("ivf_search", f"""
WITH ch AS {window_chunks_sql(1000, 200)},
s AS (SELECT q.vec_id AS query_id, ch.chunk_id, {cosine_sql('o.embedding', 'q.embedding')} AS score
      FROM embeddings q CROSS JOIN embeddings o JOIN ch ON ch.doc_id = o.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.3)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def ivf_search(t):
    """V7: exact IVF top-5: 3 of 8 lists, then those whose bound reaches the fifth score."""
    idx, cents, _, q = _ivf(t)
    r = ivf.ivf_search(idx, q, cents, k=5, nprobe=NPROBE)
    return r.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("ivf_recall")
def ivf_recall(t):
    """V7: mean recall@5 against the exact search, of the IVF search and of its first round alone."""
    idx, cents, chunks, q = _ivf(t)
    exact = retrieval.top_k_by_vector(chunks, q, k=5, threshold=0.3)
    whole, probed = (ivf.recall_at_k(ivf.ivf_search(idx, q, cents, k=5, nprobe=NPROBE, exact=e), exact)
                     .agg(F.avg("recall").alias(name), F.count(F.lit(1)).alias("queries"))
                     for e, name in ((True, "mean_recall"), (False, "first_round_recall")))
    return whole.join(probed, "queries").select("mean_recall", "first_round_recall", "queries")


@register("ivf_class_search", f"""
WITH ch AS {window_chunks_sql(1000, 200)},
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM emb),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM unit GROUP BY ALL) GROUP BY label),
near AS (SELECT vec_id, v, cent.label AS list,
                row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, cent.label) AS place
         FROM emb CROSS JOIN cent),
s AS (SELECT q.vec_id AS query_id, ch.chunk_id, round(list_cosine_similarity(o.v, q.v), 9) AS score
      FROM near q JOIN near o ON o.place = 1 AND o.list = q.list JOIN ch ON ch.doc_id = o.vec_id
      WHERE q.place <= {NPROBE}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.3)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def ivf_class_search(t):
    """V7 with given centroids: one list per vector class, its mean vector
    the centroid; top-5 of the 3 nearest lists."""
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False).select("doc_id", "chunk_id", "embedding")
    cents = ivf.mean_centroids(t.embeddings, "label")
    idx = ivf.ivf_write_index(ivf.assign_lists(chunks, cents), scratch_path(t.spark, f"ivf-{uuid.uuid4().hex[:12]}"))
    r = ivf.ivf_search(idx, retrieval.query_vectors(t.embeddings), cents, k=5, nprobe=NPROBE, exact=False)
    return r.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


COSINE_FN = """
CREATE OR REPLACE TEMPORARY FUNCTION rl_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN CASE WHEN a IS NULL OR b IS NULL OR size(a) <> size(b) THEN 0.0
            WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0.0
            ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
                 / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END"""


@register("sql_function_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sql_function_cosine(t):
    """The cosine as a SQL function (CREATE FUNCTION ... RETURN)
    used from SQL over a DataFrame bound as a parameter."""
    spark = t.spark
    spark.sql(COSINE_FN)
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return spark.sql("SELECT a.vec_id, round(rl_cosine(a.embedding, b.embedding), 6) AS cosine "
                     "FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1", e=e)


@register("named_parameters", """
SELECT doc_id, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src3') AND length(text) >= 200""")
def named_parameters(t):
    """Scalar and array query parameters bound by name (no SQL text
    splicing of values)."""
    return t.spark.sql("SELECT doc_id, source FROM {d} WHERE lang = :lang AND array_contains(:srcs, source) "
                       "AND length(text) >= :min_len",
                       args={"lang": "fr", "srcs": F.array(F.lit("src1"), F.lit("src3")), "min_len": 200},
                       d=t.documents)


@register("column_encryption", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def column_encryption(t):
    """AES-GCM column encryption with the document id as AAD; the
    round trip is decrypted and measured. The key is the session's
    ``spark.ragloom.encryption.key``, else one made for this query."""
    d = t.documents
    key = F.lit(t.spark.conf.get("spark.ragloom.encryption.key", None) or secrets.token_hex(16))
    aad = F.col("doc_id").cast("string")
    enc = F.aes_encrypt(F.col("text"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"),
                        aad)
    dec = F.aes_decrypt(F.col("cipher"), key, F.lit("GCM"), F.lit("DEFAULT"), aad)
    return d.select("doc_id", enc.alias("cipher"), aad.alias("doc_aad")).select(
        "doc_id", F.length(F.decode(dec, "UTF-8")).cast("long").alias("n"))
