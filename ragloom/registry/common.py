"""Registration of checked queries: a Spark callable plus (optionally) an
independent DuckDB SQL text computing the same rows and column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# ---- SQL fragments shared by several oracles (DuckDB dialect) ------------
def window_chunks_sql(size: int = 1000, overlap: int = 200, source: str = "documents",
                      id_col: str = "doc_id", text_col: str = "text", extra: str = "") -> str:
    """Closed-form window chunks of ``source`` as a DuckDB subquery."""
    step = size - overlap
    return f"""(
  SELECT {id_col}{extra}, i AS chunk_index,
         printf('%s_chunk_%04d', CAST({id_col} AS VARCHAR), i) AS chunk_id,
         substring({text_col}, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk_text,
         i * {step} AS start_char,
         least(i * {step} + {size}, len) AS end_char,
         CAST(length(substring({text_col}, CAST(i * {step} + 1 AS BIGINT), {size})) AS BIGINT) AS chunk_length,
         n AS total_chunks
  FROM (
    SELECT *, unnest(range(0, n)) AS i FROM (
      SELECT *, CAST(length({text_col}) AS BIGINT) AS len,
             CASE WHEN {text_col} IS NULL OR length({text_col}) = 0 THEN 0
                  WHEN length({text_col}) <= {size} THEN 1
                  ELSE CAST(ceil((length({text_col}) - {size}) / {float(step)}) AS BIGINT) + 1 END AS n
      FROM {source})))"""


def sql_str_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def sql_contains_any(expr: str, terms) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"contains({expr}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


def sql_count_present(expr: str, terms) -> str:
    if not terms:
        return "0"
    return "(" + " + ".join(f"CAST(contains({expr}, '{t.replace(chr(39), chr(39) * 2)}') AS INTEGER)"
                            for t in terms) + ")"


def sql_classify(expr: str, classes, default: str) -> str:
    whens = " ".join(f"WHEN {sql_contains_any(expr, terms)} THEN '{label}'" for label, terms in classes)
    return f"CASE {whens} ELSE '{default}' END"


# Keyword tokens of a text column: lower-cased word tokens, a-z only,
# stop words and short words removed; returns (rowkey, w, pos) rows.
def keyword_rows_sql(source: str, key: str, text_expr: str, stop_words, min_len: int) -> str:
    return f"""(
  SELECT {key}, w, pos FROM (
    SELECT {key}, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS pos FROM (
      SELECT {key}, regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM {source}))
  WHERE regexp_matches(w, '^[a-z]+$') AND length(w) >= {min_len}
    AND NOT list_contains({sql_str_list(stop_words)}, w))"""


# ---- the fixture chunk table of ``plans.fixtures.search_chunks`` in SQL ----
def importance_sql(nk_expr: str) -> str:
    return f"""least(greatest(0.5
    + (1.0 - CAST(chunk_index AS DOUBLE) / greatest(CAST(total_chunks AS DOUBLE), 1.0)) * 0.2
    + greatest(0.0, 1.0 - abs(CAST(chunk_length AS DOUBLE) - 500.0) / 500.0) * 0.2
    + least(least({nk_expr}, 5) / 5.0, 1.0) * 0.1, 0.0), 1.0)"""


def search_chunks_ctes(with_vectors: bool = True) -> str:
    """CTEs ``sc`` (chunks + attributes) and ``ck`` (chunk keyword rows)."""
    from ..functions import lexicons as L
    src = ("(SELECT d.doc_id, d.text, d.lang, d.source FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
           if with_vectors else "documents")
    from .text import _quality_sql  # noqa: WPS433 (shared formula text)
    return f"""
ch AS {window_chunks_sql(extra=', lang, source', source=src)},
kwr AS {keyword_rows_sql('ch', 'chunk_id', 'chunk_text', L.STOP_WORDS, L.KEYWORD_MIN_LEN)},
kwg AS (SELECT chunk_id, w, count(*) AS cnt, min(pos) AS fp FROM kwr GROUP BY chunk_id, w),
kwo AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY cnt DESC, fp) AS rn FROM kwg),
ck AS (SELECT chunk_id, w, rn FROM kwo WHERE rn <= 10),
nk AS (SELECT chunk_id, count(*) AS nkw FROM ck GROUP BY chunk_id),
sc AS (SELECT ch.*, coalesce(nk.nkw, 0) AS nkw,
              {importance_sql('coalesce(nk.nkw, 0)')} AS importance_score,
              round(CAST({_quality_sql('chunk_text')} AS DOUBLE), 6) AS quality_score
       FROM ch LEFT JOIN nk ON nk.chunk_id = ch.chunk_id)"""


def cosine_sql(a: str, b: str) -> str:
    c = f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    return f"round(CASE WHEN isnan({c}) THEN 0.0 ELSE {c} END, 9)"


_DEC = __import__("re").compile(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])")


def dbl(sql: str) -> str:
    """Type every decimal literal of an oracle as DOUBLE (DuckDB would
    otherwise compute in DECIMAL, while Spark's literals are doubles)."""
    return _DEC.sub(r"CAST(\1 AS DOUBLE)", sql)
