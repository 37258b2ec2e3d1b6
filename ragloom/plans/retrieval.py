"""Composed retrieval plans over the fixture tables.

The flagship: documents -> window chunks -> each chunk carries its
document's vector (equi-join on the id) -> every vector in ``embeddings``
is a query -> exact top-k chunks per query above the semantic threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import chunking
from ..operators.vector_search import top_k_by_vector


def chunk_vectors(documents: DataFrame, embeddings: DataFrame, size: int = 1000,
                  overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Window chunks of every document that has a vector, with that vector.

    The join is done at document granularity (one row per document on both
    sides) before the chunks multiply the rows. Without ``with_text`` only
    (doc_id, text length) meets the vectors, so a shuffle join moves no
    text at all; the chunk keys follow from the length.
    """
    vecs = embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    if not with_text:
        lens = documents.select("doc_id", F.length("text").alias("text_length"))
        return chunking.chunk_window_keys(lens.join(vecs, "doc_id"), size=size, overlap=overlap,
                                          keep=("embedding",))
    docs = documents.select("doc_id", "text").join(vecs, "doc_id")
    return chunking.chunk_window(docs, size=size, overlap=overlap, keep=("embedding",))


def query_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


def semantic_search(chunks: DataFrame, queries: DataFrame, k: int = 5,
                    threshold: float = L.SEMANTIC_THRESHOLD, strict: bool = True,
                    key_cols=("doc_id", "chunk_id"), tie_cols=("chunk_id",)) -> DataFrame:
    """Cosine > threshold, top-k per query, ties by chunk id."""
    res = top_k_by_vector(chunks, queries, k=k, threshold=threshold, strict=strict,
                          key_cols=key_cols, tie_cols=tie_cols)
    return res.select("query_id", *key_cols, F.round("score", 6).alias("score"),
                      F.col("rank").cast("long").alias("rank"))
