"""Vector scalars as Column expressions (V1-V3, V6).

Vectors are ``ARRAY<FLOAT|DOUBLE>``; arithmetic is done in DOUBLE. These are
row-wise expressions for rows that already carry both vectors (after an
equi-join). Scoring many queries against a large chunk table goes through
``operators.vector_search`` instead, which never builds the pair table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def as_double(v) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def sq_norm(a) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + F.coalesce(x * x, F.lit(0.0)))


def cosine_similarity(a, b) -> Column:
    """V1: dot / (|a| |b|).

    NULL vector, length mismatch or a zero norm give 0.0 (never an error,
    never a silently truncated product).
    """
    a, b = col_(a), col_(b)
    na, nb = sq_norm(a), sq_norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return (F.when(~ok, F.lit(0.0))
            .when((na == 0.0) | (nb == 0.0), F.lit(0.0))
            .otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb))))


def euclidean_distance(a, b, mismatch: float | None = None) -> Column:
    """V2: sqrt(sum (a-b)^2); NULL (or ``mismatch``) when lengths differ."""
    a, b = col_(a), col_(b)
    d = F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                           F.lit(0.0), lambda acc, x: acc + x))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    fallback = F.lit(None).cast("double") if mismatch is None else F.lit(float(mismatch))
    return F.when(ok, d).otherwise(fallback)


def l2_normalize(a) -> Column:
    n = F.sqrt(sq_norm(a))
    # The norm is an element of an outer array: inside the inner lambda it would be computed for each number.
    unit = F.transform(F.array(n), lambda m: F.transform(as_double(a), lambda x: x / m))
    return F.when(n > 0, unit[0])


def bm25_score(tf, dl, avgdl, df, n_docs, k1: float = 1.2, b: float = 0.75) -> Column:
    """V3: Okapi BM25 term weight with the ``ln(1 + ...)`` idf."""
    tf, dl, avgdl, df, n_docs = (col_(x).cast("double") for x in (tf, dl, avgdl, df, n_docs))
    norm = tf + k1 * ((1 - b) + b * dl / avgdl)
    idf = F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    return tf * (k1 + 1) / norm * idf


def embedding_compatibility(emb, target_dim: int) -> Column:
    """V6: reuse a stored vector iff its dimension equals the target."""
    e = col_(emb)
    return (F.when(e.isNull() | (F.size(e) <= 0), F.lit("missing"))
            .when(F.size(e) == target_dim, F.lit("reuse"))
            .otherwise(F.lit("regenerate")))
