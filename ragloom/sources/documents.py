"""Document sources.

Readers take explicit schemas; reshaping is projections, unions and a
distributed dense numbering (never a global single-task window).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.text import col_, contains_any
from ..session import cut_lineage

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("document_type", T.StringType()),
    T.StructField("facility", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("created_date", T.StringType()),
])


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
                        multi_line: bool = False) -> DataFrame:
    """Documents saved as JSON (JSON lines by default; ``multi_line``
    for one JSON array document per file)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def dense_index(df: DataFrame, order: Sequence[str], name: str = "row_index",
                partitions: int | None = None) -> DataFrame:
    """0-based dense numbering in ``order`` without a single-task window:
    range-partition, number rows inside each partition, add the partition's
    offset (per-partition counts are one small aggregate).

    Range bounds are sampled, so two plans of one range shuffle may cut
    differently; the partitioned rows are therefore written once (a reliable
    checkpoint), and both numbers come from what was written."""
    n = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    p = cut_lineage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = p.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = offs.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    return p.join(F.broadcast(offs), "_pid").withColumn(name, F.col("_off") + F.col("_rn") - 1) \
            .drop("_pid", "_rn", "_off")


def filter_external_corpus(qa: DataFrame, keywords: Sequence[str] = L.CORPUS_KEYWORDS,
                           fields: Sequence[str] = ("domain", "question", "context"),
                           id_prefix: str = "ragbench_", order: Sequence[str] = ("row_order",)) -> DataFrame:
    """S3: keep QA rows whose domain, question or context (lower-cased)
    contains any keyword; running id in input order; document shape."""
    cond = None
    for f in fields:
        c = contains_any(F.lower(F.coalesce(F.col(f), F.lit(""))), keywords)
        cond = c if cond is None else cond | c
    kept = dense_index(qa.where(cond), list(order), "_i")
    return kept.select(
        F.concat(F.lit(id_prefix), F.col("_i").cast("string")).alias("id"),
        F.coalesce(F.col("question"), F.lit("Industrial Document")).alias("title"),
        F.coalesce(F.col("context"), F.lit("")).alias("content"),
        F.lower(F.coalesce(F.col("domain"), F.lit(""))).alias("domain"),
        F.lit("ragbench").alias("source"),
        F.struct(F.col("question").alias("original_question"), F.col("answer").alias("answer")).alias("metadata"))


ATOM_SCHEMA = "title STRING, summary STRING, id STRING, published STRING"


def parse_atom_entries(xml_entries: DataFrame, col: str = "entry_xml") -> DataFrame:
    """One Atom ``<entry>`` per row -> title, summary (newlines to
    spaces, trimmed), last URL segment of the id, published."""
    e = xml_entries.select(F.from_xml(F.col(col), ATOM_SCHEMA).alias("e")).select("e.*")
    return e.select(F.trim(F.regexp_replace("title", r"\s*\n\s*", " ")).alias("title"),
                    F.trim(F.regexp_replace("summary", r"\n", " ")).alias("summary"),
                    F.element_at(F.split("id", "/"), -1).alias("document_id"), "published")


def extract_store_documents(spark: SparkSession, path: str, with_embeddings: bool = True) -> DataFrame:
    """A document-store export (JSON lines) -> id, name, content,
    metadata, create_time[, embedding]."""
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("create_time", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    df = spark.read.schema(schema).json(path)
    return df if with_embeddings else df.drop("embedding")


def extract_content_fields(raw_bytes=None, uri=None, fields: Sequence = (), json_doc=None) -> Column:
    """content = raw bytes as UTF-8 (or a URI placeholder), then any
    present text fields, then the JSON ``content`` field, joined by a blank
    line (absent parts skipped)."""
    parts = []
    if raw_bytes is not None:
        raw = F.decode(col_(raw_bytes), "UTF-8")
        parts.append(F.when(raw.isNotNull(), raw).otherwise(
            F.concat(F.lit("[Content from URI: "), col_(uri), F.lit("]")) if uri is not None else F.lit(None)))
    parts += [col_(f) for f in fields]
    if json_doc is not None:
        parts.append(F.get_json_object(col_(json_doc), "$.content"))
    return F.concat_ws("\n\n", *parts)


def coalesce_embedding_fields(*cols) -> Column:
    """First present vector among the candidate columns, in order
    (e.g. embedding, embeddings, _embedding, derived.embedding, ...)."""
    return F.coalesce(*[F.when(F.size(col_(c)) > 0, col_(c)) for c in cols])


def generate_documents(ids: DataFrame, templates: DataFrame, id_col: str = "i",
                       n_facilities: int = 3) -> DataFrame:
    """Document i uses template i % n_templates, id ``doc_%04d``,
    facility ``FAB-<i % n + 1>``."""
    n = templates.count()
    if n == 0:
        raise ValueError("no templates")
    tpl = dense_index(templates, ["template_order"], "_t").select("_t", "template")
    d = ids.select(F.col(id_col).cast("long").alias("_i")).withColumn("_t", F.col("_i") % n)
    return d.join(tpl, "_t").select(
        F.format_string("doc_%04d", "_i").alias("document_id"), F.col("template").alias("content"),
        F.concat(F.lit("FAB-"), ((F.col("_i") % n_facilities) + 1).cast("string")).alias("facility"))


def union_sources(sources: Mapping[str, DataFrame], include: Mapping[str, bool] | None = None,
                  max_per_source: int | None = None, order: str = "document_id") -> DataFrame:
    """S11 (+U4): concatenate the included sources (missing columns NULL),
    at most ``max_per_source`` rows each (first by ``order``)."""
    dfs = [df.withColumn("source", F.lit(name)) for name, df in sources.items()
           if (include or {}).get(name, True)]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    if max_per_source is not None:
        w = Window.partitionBy("source").orderBy(order)
        out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_per_source).drop("_rn")
    return out


def source_counts(docs: DataFrame) -> DataFrame:
    """Documents per source."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def normalize_documents(df: DataFrame) -> DataFrame:
    """Reconcile the two document spellings
    (document_id/document_type/facility vs id/doc_type/facility_code) and
    apply the defaults ``unknown`` / ``general`` / ``manual_upload`` / ``1.0``."""
    cols = set(df.columns)

    def pick(*names):
        present = [F.col(n) for n in names if n in cols]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return df.select(
        pick("document_id", "id").alias("document_id"),
        F.coalesce(pick("title", "name"), F.lit("")).alias("title"),
        pick("content", "text").alias("content"),
        F.coalesce(pick("document_type", "doc_type"), F.lit("general")).alias("document_type"),
        F.coalesce(pick("facility", "facility_code"), F.lit("unknown")).alias("facility"),
        F.coalesce(pick("source"), F.lit("manual_upload")).alias("source"),
        F.coalesce(pick("version"), F.lit("1.0")).alias("version"))
