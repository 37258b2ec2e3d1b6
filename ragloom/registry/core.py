"""Flagship retrieval slice and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..plans import retrieval
from .common import register, window_chunks_sql

FLAGSHIP_SQL = f"""
WITH ch AS {window_chunks_sql(1000, 200, source="(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")},
cv AS (SELECT ch.doc_id, ch.chunk_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM ch JOIN embeddings e ON e.vec_id = ch.doc_id),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings),
s AS (SELECT q.query_id, cv.doc_id, cv.chunk_id,
             round(CASE WHEN isnan(list_cosine_similarity(cv.v, q.qv)) THEN 0.0
                        ELSE list_cosine_similarity(cv.v, q.qv) END, 9) AS score
      FROM q CROSS JOIN cv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM s WHERE score > 0.3)
SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5
"""


@register("semantic_search", FLAGSHIP_SQL)
def semantic_search(t):
    """S1+C1+C8+J1+V1+F2+R1: top-5 chunks per query vector, cosine > 0.3."""
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False)
    return retrieval.semantic_search(chunks, retrieval.query_vectors(t.embeddings))


@register("chunk_window", f"SELECT * FROM {window_chunks_sql(1000, 200)}")
def chunk_window(t):
    """C1 + C8: 1000/200 windows of every document."""
    return chunking.chunk_window(t.documents)


@register("chunk_window_512", f"SELECT * FROM {window_chunks_sql(512, 100)}")
def chunk_window_512(t):
    """C1 with the 512/100 setting."""
    return chunking.chunk_window(t.documents, size=512, overlap=100)


@register("chunk_fixed", f"SELECT * FROM {window_chunks_sql(500, 0)}")
def chunk_fixed(t):
    """Non-overlapping 500-character blocks."""
    return chunking.chunk_fixed(t.documents, size=500)


@register("short_document_guard", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
WHERE text IS NOT NULL AND length(text) >= 50""")
def short_document_guard(t):
    """Documents that are long enough to be chunked."""
    return chunking.short_document_guard(t.documents).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"))
