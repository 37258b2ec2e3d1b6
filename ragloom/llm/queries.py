"""The registered query of every operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, combination_join, compression, conversation_repair, language, licenses, packing, periodic_runs,
               permutation_index, preference, site_templates, suffix_dedup, token_counts)
from .common import table


def op1_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(*preference.echo_negatives(table(spark, sf_dir, "conversations")))


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(table(spark, sf_dir, "documents"))


def op6_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract_pages(table(spark, sf_dir, "pages"))


def op10_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combination_join.jaccard_components(table(spark, sf_dir, "documents"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """One text in ten with its words from some place on repeated periodically."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+",
                                              " "), " "), lambda w: w != "")
    numbered = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    planted = numbered.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int"))).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil(rest / F.col("p")).cast("int")
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")),
                        F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest))
    return planted.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(repeated, " ")).otherwise(
        F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    found = periodic_runs.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    # Greatest length, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def op11_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(planted_repeats(table(spark, sf_dir, "documents")))


def repeat_digests(docs: DataFrame, settings: suffix_dedup.Settings = suffix_dedup.Settings()) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return suffix_dedup.remove_repeats(docs, settings=settings).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with one row in four damaged, each by its own checksum."""
    one_space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one_space) for c in ("conv_id", "turn")))
    harm = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), one_space) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(harm == 0, F.array().cast("array<int>")).when(harm == 3, F.array(F.lit(1), F.lit(2)))
                  .otherwise(F.array(F.lit(1)))).alias("copy"))


def op13_path_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(damaged(turns), conversations=turns)


QUERIES = {f.__name__: f for f in (
    op1_slack_packing, op2_permutation_search, op3_preference_pairs, op4_license_templates, op5_compression_bands,
    op6_backtrack_bpe, op7_prefix_counts, op8_language_mixture, op9_site_templates, op10_combination_join,
    op11_automaton_runs, op12_suffix_dedup, op13_path_repair)}

_CHATML = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"

ORACLES = {
    "op3_preference_pairs": f"""
WITH turns AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         coalesce(lag(text) OVER w, '') AS before, row_number() OVER w AS place,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
numbered AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN place END) OVER (PARTITION BY pair_id) AS last_place FROM turns),
kept AS (
  SELECT *, CASE WHEN role = 'assistant' AND (CASE WHEN last IS NULL THEN place = last_place ELSE turn = last END)
                 THEN before ELSE text END AS echoed
  FROM numbered WHERE place <= last_place OR turn <= last),
parted AS (
  SELECT *, min(CASE WHEN text <> echoed THEN place END) OVER (PARTITION BY pair_id) AS parting FROM kept),
sides AS (
  SELECT pair_id, place, role, text, CASE WHEN parting IS NULL OR place < parting THEN 'p' ELSE 'c' END AS side
  FROM parted
  UNION ALL
  SELECT pair_id, place, role, echoed, 'r' FROM parted WHERE place >= parting),
pieces AS (SELECT *, {_CHATML} AS piece FROM sides),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side ORDER BY place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces),
spans AS (
  SELECT *, CASE WHEN role = 'assistant'
                 THEN (start + 13 + length(role)) || '-' || (start + length(piece)) END AS span FROM placed)
SELECT pair_id,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (side = 'p'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (side = 'c'), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (side = 'r'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (side = 'c'), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (side = 'r'), '') AS rejected_spans,
  count(*) FILTER (side = 'p') AS n_prompt_turns, count(*) FILTER (side = 'c') AS n_chosen_turns,
  count(*) FILTER (side = 'r') AS n_rejected_turns
FROM spans GROUP BY pair_id""",
}
