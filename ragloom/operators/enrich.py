"""Per-chunk scores, tags and metadata (P5-P21, P23, P25, H1/H2 bodies).

All are narrow projections (no shuffle); they compose with any chunker.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..functions.text import col_


def importance_score(chunk_index, total_chunks, chunk_length, keywords) -> Column:
    """Position, length and keyword-density blend clamped to [0, 1].

    ``keywords`` is the chunk's keyword array (its first 5 count)."""
    idx, tot, ln = (col_(c).cast("double") for c in (chunk_index, total_chunks, chunk_length))
    pos = F.lit(1.0) - idx / F.greatest(tot, F.lit(1.0))
    length_f = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(ln - 500.0) / 500.0)
    kw = F.least(F.least(F.coalesce(F.size(col_(keywords)), F.lit(0)), F.lit(5)).cast("double") / 5.0,
                 F.lit(1.0))
    s = F.lit(0.5) + pos * 0.2 + length_f * 0.2 + kw * 0.1
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def non_blank_dot_parts(text) -> Column:
    return F.size(F.filter(F.split(col_(text), r"\.", -1), lambda s: s.rlike(r"\S")))


def quality_score(text, tech_terms: Sequence[str] = L.QUALITY_TECH_TERMS,
                  markers: Sequence[str] = L.QUALITY_STRUCTURE_MARKERS) -> Column:
    """Length factor, term and structure bonuses, readability, cap 2.0."""
    t = col_(text)
    ln = F.length(t).cast("double")
    lt = F.lower(t)
    s = (F.when(ln < 100, 0.6).when(ln < 200, 0.8).when(ln > 2000, 0.9).otherwise(1.0))
    s = s + F.least(X.count_present(lt, tech_terms) * 0.1, F.lit(0.5))
    s = s + F.least(X.count_present(lt, markers) * 0.05, F.lit(0.2))
    avg = ln / F.nullif(non_blank_dot_parts(t), F.lit(0))  # conditions that share it compute it first
    s = s + F.when((avg >= 20) & (avg <= 100), 0.1).otherwise(0.0)
    return F.least(s, F.lit(2.0))


def quality_score_capped(text, terms: Sequence[str] = L.QUALITY_CAPPED_TERMS) -> Column:
    """P10: older multiplicative variant capped at 1.0."""
    t = col_(text)
    ln = F.length(t).cast("double")
    s = F.when(ln < 100, 0.5).when(ln > 2000, 0.8).otherwise(1.0)
    s = s * F.when(X.contains_any(F.lower(t), terms), 1.2).otherwise(1.0)
    avg = ln / F.size(F.split(t, r"\.", -1))
    s = s * F.when((avg >= 50) & (avg <= 150), 1.1).otherwise(1.0)
    return F.least(s, F.lit(1.0))


def safety_level(text, classes=L.SAFETY_CLASSES, default=L.SAFETY_DEFAULT) -> Column:
    """High / medium / low by two lexicons."""
    return X.classify_ordered(text, classes, default)


def enrich_chunks(chunks: DataFrame, text_col: str = "chunk_text",
                  title=None, document_type=None, facility=None, created_date=None,
                  top_k: int = L.KEYWORD_TOP_K) -> DataFrame:
    """H2 body: hash, summary, keywords, importance and metadata JSON.

    Expects chunk_index, chunk_length, total_chunks from a chunker.
    """
    t = F.col(text_col)

    def opt(c, default):
        return F.coalesce(col_(c) if c is not None else F.lit(None).cast("string"), F.lit(default))

    fields = [opt(title, "").alias("title"), opt(document_type, "unknown").alias("document_type"),
              opt(facility, "unknown").alias("facility")]
    if created_date is not None:      # the caller passes ``as_of``; no wall clock
        fields.append(col_(created_date).cast("string").alias("created_date"))
    fields += [F.col("chunk_length").alias("chunk_length"), F.col("total_chunks").alias("total_chunks")]
    meta = F.to_json(F.struct(*fields))
    kw = X.with_keywords(chunks, t, "keywords", top_k)
    return kw.select(
        "*",
        X.md5_hex(t).alias("chunk_hash"),
        X.summary(t, 100).alias("summary"),
        importance_score("chunk_index", "total_chunks", "chunk_length", "keywords").alias("importance_score"),
        meta.alias("metadata"),
    )


def manufacturing_metadata(chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """H1 body (P9, P11-P18): classes, complexity, tags, diagrams, quality.

    ``lower(text)`` is computed once in an inner projection and shared by
    all the lexicon tests.
    """
    lt = F.col("_lt")
    base = chunks.withColumn("_lt", F.lower(F.col(text_col)))
    return base.select(
        *[c for c in chunks.columns],
        X.classify_ordered(lt, L.SECTION_CLASSES, "general", lowered=True).alias("section_type"),
        X.classify_ordered(lt, L.DOCUMENT_TYPE_CLASSES, "general", lowered=True).alias("document_type"),
        X.classify_ordered(lt, L.EQUIPMENT_CLASSES, "general", lowered=True).alias("equipment_type"),
        X.classify_ordered(lt, L.SAFETY_CLASSES, L.SAFETY_DEFAULT, lowered=True).alias("safety_level"),
        X.classify_ordered(lt, L.PROCESS_CLASSES, "general", lowered=True).alias("process_category"),
        F.least(F.lit(L.COMPLEXITY_CAP), X.count_present(lt, L.TECHNICAL_INDICATORS)).alias("technical_complexity"),
        X.tag_terms(lt).alias("keyword_tags"),
        X.contains_any(lt, L.DIAGRAM_INDICATORS).alias("has_diagrams"),
        quality_score(F.col(text_col)).alias("quality_score"),
    )


def build_metadata(**fields) -> Column:
    """P20: nested metadata JSON from named columns."""
    return F.to_json(F.struct(*[col_(v).alias(k) for k, v in fields.items()]))


def enhance_migrated_document(df: DataFrame, id_col: str = "id", meta_col: str = "metadata",
                              extra: Mapping[str, str] | None = None,
                              prefix: str = "migrated_") -> DataFrame:
    """Prefix the id; merge extra metadata where original keys win."""
    extra = extra or {}
    add = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.lit(v))]) if extra \
        else F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(F.col(meta_col), add, lambda k, v1, v2: F.coalesce(v1, v2))
    return df.withColumn(id_col, F.concat(F.lit(prefix), F.col(id_col))).withColumn(meta_col, merged)


def parse_score_json(text) -> Column:
    """First ``{...}`` block of a reply parsed as map<string,double>."""
    return F.from_json(F.regexp_extract(col_(text), r"\{[^}]+\}", 0), "map<string,double>")


def metadata_predicate(json_col, filters: Mapping[str, str]) -> Column:
    """P25: AND of equality tests on JSON fields; no filters -> TRUE."""
    if not filters:
        return F.lit(True)
    return reduce(lambda a, b: a & b,
                  [F.get_json_object(col_(json_col), f"$.{k}") == F.lit(v) for k, v in filters.items()])
