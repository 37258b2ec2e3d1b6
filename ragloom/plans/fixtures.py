"""How the operators are fed from the fixture tables (Spark side).

* chunk table: 1000/200 window chunks of every document that has a vector,
  carrying the vector, document type (``lang``), facility (``source``),
  top-10 keywords, importance and quality scores;
* vector queries: every vector in ``embeddings`` (query id = vec_id), with
  the top-5 keywords of the document of the same id as its keywords;
* text queries: the ``user`` turns of ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking
from ..operators import enrich as E


def docs_with_vectors(t) -> DataFrame:
    return t.documents.select("doc_id", "text", "lang", "source").join(
        t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id")


def search_chunks(t, with_vectors: bool = True) -> DataFrame:
    docs = docs_with_vectors(t) if with_vectors else t.documents.select("doc_id", "text", "lang", "source")
    keep = ("lang", "source", "embedding", "label") if with_vectors else ("lang", "source")
    ch = chunking.chunk_window(docs, keep=keep)
    ch = X.with_keywords(ch, "chunk_text", "keywords", 10)
    return ch.withColumn("importance_score",
                         E.importance_score("chunk_index", "total_chunks", "chunk_length", "keywords")) \
             .withColumn("quality_score", F.round(E.quality_score("chunk_text"), 6))


def vector_queries(t, with_keywords: bool = False) -> DataFrame:
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    if not with_keywords:
        return q
    d = t.documents.select(F.col("doc_id").alias("query_id"), "text").join(q.select("query_id"), "query_id", "left_semi")
    d = X.with_keywords(d, "text", "keywords", 5)
    return q.join(d.select("query_id", "keywords"), "query_id", "left") \
            .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def text_queries(t) -> DataFrame:
    c = t.conversations.where(F.col("role") == "user")
    return c.select(F.format_string("%d_%d", "conv_id", "turn").alias("query_id"),
                    F.col("text").alias("query_text"))
