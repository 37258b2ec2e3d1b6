"""Retrieval evaluation on the fixture search results.

Results: semantic top-5 (cosine > 0.3) of every query vector over the
window chunks of documents that have a vector. Relevance classes are the
``label`` of the vectors: a query expects its own label; a result is of the
label of its document's vector. Categories are the query document's type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import evaluate as EV
from ..operators import stats as A
from ..operators import vector_search as VS
from ..plans import fixtures as FX
from ..plans import retrieval
from .common import (cosine_sql, register, sql_classify, sql_contains_any, sql_count_present,
                     sql_str_list, window_chunks_sql)

HIGH, MEDIUM = ["that", "with"], ["this", "from", "tion"]
TERMS = ["that", "with", "this", "from"]

EVAL_CTE = f"""
WITH ch AS {window_chunks_sql(extra=', lang, source', source="(SELECT d.doc_id, d.text, d.lang, d.source FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")},
s AS (SELECT q.vec_id AS query_id, ch.doc_id, ch.chunk_id, ch.chunk_text, ch.lang, ch.source,
             CAST(ce.label AS VARCHAR) AS clabel, {cosine_sql('ce.embedding', 'q.embedding')} AS score
      FROM embeddings q CROSS JOIN ch JOIN embeddings ce ON ce.vec_id = ch.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.3),
res AS (SELECT * FROM r WHERE rank <= 5),
qd AS (SELECT e.vec_id AS query_id, CAST(e.label AS VARCHAR) AS qlabel, d.lang AS qlang
       FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
got AS (SELECT query_id, list(DISTINCT clabel) AS retrieved, list(clabel) AS retrieved_rows FROM res GROUP BY query_id),
pq AS (SELECT qd.query_id, qd.qlang,
              coalesce(len(list_filter(coalesce(got.retrieved, []), lambda x: x = qd.qlabel)), 0) AS hit,
              coalesce(len(got.retrieved), 0) AS nr,
              coalesce(len(list_filter(coalesce(got.retrieved_rows, []), lambda x: x = qd.qlabel)), 0) AS rel_rows,
              coalesce(len(got.retrieved_rows), 0) AS nrows
       FROM qd LEFT JOIN got ON got.query_id = qd.query_id),
prf AS (SELECT query_id, qlang,
               CASE WHEN nr = 0 THEN 0.0 ELSE hit / CAST(nr AS DOUBLE) END AS precision,
               CASE WHEN nr = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) END AS recall FROM pq),
prf1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM prf)"""


def _results(t, k=5):
    """Top-k results with the retrieved chunk's text, type, facility and
    label. The result table (queries x k rows) is the broadcast side; the
    chunk table is only scanned."""
    from ..operators import chunking
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False)
    res = retrieval.semantic_search(chunks, retrieval.query_vectors(t.embeddings), k=k)
    ch = chunking.chunk_window(t.documents.select("doc_id", "text", "lang", "source"), keep=("lang", "source"))
    lab = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("clabel"))
    attrs = ch.select("doc_id", "chunk_id", "chunk_text", "lang", "source").join(res,
                                                                                 ["doc_id", "chunk_id"])
    return attrs.join(lab, "doc_id")


def _expected(t):
    d = t.documents.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("qlang"))
    return t.embeddings.select(F.col("vec_id").alias("query_id"),
                               F.array(F.col("label").cast("string")).alias("expected")).join(d, "query_id", "left")


def _per_query(t):
    return EV.per_query_prf(_results(t), "clabel", _expected(t), by=("qlang",))


def _r6(c):
    return F.round(c, 6).alias(c)


@register("precision_recall_f1", EVAL_CTE + """
SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf1""")
def precision_recall_f1(t):
    """Set P/R/F1 of retrieved labels vs the query's label."""
    return _per_query(t).select("query_id", _r6("precision"), _r6("recall"), _r6("f1"))


@register("prf_by_category", EVAL_CTE + """
SELECT qlang, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
       CAST(count(*) AS BIGINT) AS query_count FROM prf1 GROUP BY qlang""")
def prf_by_category(t):
    """Mean P/R/F1 per query category."""
    r = EV.prf_by_category(_per_query(t), "qlang")
    return r.select("qlang", _r6("precision"), _r6("recall"), _r6("f1"), "query_count")


@register("prf_overall", EVAL_CTE + """
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
       round(coalesce(stddev_samp(precision), 0), 6) AS std_precision,
       round(coalesce(stddev_samp(recall), 0), 6) AS std_recall, round(coalesce(stddev_samp(f1), 0), 6) AS std_f1,
       CAST(count(*) AS BIGINT) AS total_queries_tested FROM prf1""")
def prf_overall(t):
    """Overall means and sample stdevs."""
    r = EV.prf_overall(_per_query(t))
    return r.select(*[_r6(c) for c in ("precision", "recall", "f1", "std_precision", "std_recall", "std_f1")],
                    "total_queries_tested")


@register("prf_rows", EVAL_CTE + """
, pr AS (SELECT query_id, CASE WHEN nrows > 0 THEN rel_rows / CAST(nrows AS DOUBLE) ELSE 0.0 END AS p,
                least(rel_rows / 1.0, 1.0) AS rc FROM pq)
SELECT query_id, round(p, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1 FROM pr""")
def prf_rows(t):
    """Row-count precision/recall (recall capped at 1)."""
    got = _results(t).groupBy("query_id").agg(F.collect_list("clabel").alias("retrieved"))
    j = _expected(t).join(got, "query_id", "left")
    m = EV.prf_rows("retrieved", "expected")
    return j.select("query_id", F.round(m["precision"], 6).alias("precision"),
                    F.round(m["recall"], 6).alias("recall"), F.round(m["f1"], 6).alias("f1"))


CR_SQL = (f"least(({sql_count_present('lower(chunk_text)', HIGH)} * 0.8 + {sql_count_present('lower(chunk_text)', MEDIUM)} * 0.4)"
          f" / {len(HIGH) + len(MEDIUM) * 0.5}, 1.0)")


@register("content_relevance", EVAL_CTE + f"""
SELECT query_id, round({CR_SQL}, 6) AS content_relevance FROM res WHERE rank = 1""")
def content_relevance(t):
    """E4 on each query's top result."""
    r = _results(t).where(F.col("rank") == 1)
    return r.select("query_id", F.round(EV.content_relevance("chunk_text", HIGH, MEDIUM), 6).alias("content_relevance"))


@register("relevance_expectation", EVAL_CTE + f"""
SELECT round(avg(score), 6) AS average_similarity_score, round(avg({CR_SQL}), 6) AS average_content_relevance,
       round(avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS expectation_met_rate,
       CAST(count(*) AS BIGINT) AS queries FROM res WHERE rank = 1""")
def relevance_expectation(t):
    """E5: top-result expectation (min score 0.9) and averages."""
    top = _results(t).where(F.col("rank") == 1) \
                     .withColumn("rel", EV.content_relevance("chunk_text", HIGH, MEDIUM))
    r = EV.relevance_expectation(top, "score", "rel", 0.9)
    return r.select(_r6("average_similarity_score"), _r6("average_content_relevance"),
                    _r6("expectation_met_rate"), "queries")


@register("term_coverage", EVAL_CTE + f"""
SELECT round(avg({sql_count_present('lower(chunk_text)', TERMS)} / {float(len(TERMS))}), 6) AS average_term_coverage,
       round(avg(score), 6) AS average_similarity_score FROM res WHERE rank = 1""")
def term_coverage(t):
    """Share of expected terms in the top result, averaged."""
    top = _results(t).where(F.col("rank") == 1)
    return top.agg(F.round(F.avg(EV.term_coverage("chunk_text", TERMS)), 6).alias("average_term_coverage"),
                   F.round(F.avg("score"), 6).alias("average_similarity_score"))


SAFETY_SQL = sql_classify("lower(chunk_text)", L.SAFETY_CLASSES, L.SAFETY_DEFAULT)


@register("safety_prioritization", EVAL_CTE + f"""
, lv AS (SELECT *, {SAFETY_SQL} AS safety_level FROM res)
SELECT query_id, CAST(sum(CASE WHEN safety_level = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_safety_results,
       CAST(sum(CASE WHEN safety_level = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS medium_safety_results,
       CAST(max(CASE WHEN rank = 1 THEN {sql_count_present('lower(chunk_text)', L.SAFETY_RESULT_KEYWORDS)} END) AS BIGINT)
         AS safety_keyword_count,
       round((sum(CASE WHEN safety_level = 'high' THEN 1 ELSE 0 END) * 1.0
              + sum(CASE WHEN safety_level = 'medium' THEN 1 ELSE 0 END) * 0.5) / count(*), 6) AS safety_prioritization_score
FROM lv GROUP BY query_id""")
def safety_prioritization(t):
    """E7."""
    res = _results(t).withColumn("safety_level", X.classify_ordered("chunk_text", L.SAFETY_CLASSES, L.SAFETY_DEFAULT))
    r = EV.safety_prioritization(res)
    return r.select("query_id", F.col("high_safety_results").cast("long").alias("high_safety_results"),
                    F.col("medium_safety_results").cast("long").alias("medium_safety_results"),
                    F.col("safety_keyword_count").cast("long").alias("safety_keyword_count"),
                    _r6("safety_prioritization_score"))


@register("multimodal_score", EVAL_CTE + f"""
SELECT query_id, round((CAST({sql_contains_any('lower(chunk_text)', L.DIAGRAM_INDICATORS)} AS INTEGER)
       + least({sql_count_present('lower(chunk_text)', L.MULTIMODAL_TEXT_INDICATORS)}, 3)) / 6.0, 6) AS multimodal_score
FROM res WHERE rank = 1""")
def multimodal_score(t):
    """E8 on the top result (no tables/images columns in the fixture -> 0)."""
    top = _results(t).where(F.col("rank") == 1)
    s = EV.multimodal_score(F.lit(False), F.lit(False), X.has_any("chunk_text"), "chunk_text")
    return top.select("query_id", F.round(s, 6).alias("multimodal_score"))


@register("facility_diversity", EVAL_CTE + """
SELECT query_id, CAST(count(DISTINCT source) AS BIGINT) AS unique_facilities_covered,
       CAST(count(*) AS BIGINT) AS total_results,
       CAST(sum((length(lower(chunk_text)) - length(replace(lower(chunk_text), 'facility', ''))) // 8
              + (length(lower(chunk_text)) - length(replace(lower(chunk_text), 'site', ''))) // 4) AS BIGINT)
         AS facility_references,
       round(count(DISTINCT source) / CAST(count(*) AS DOUBLE), 6) AS facility_diversity_ratio
FROM res GROUP BY query_id""")
def facility_diversity(t):
    """E9."""
    r = EV.facility_diversity(_results(t), facility="source")
    return r.select("query_id", F.col("unique_facilities_covered").cast("long").alias("unique_facilities_covered"),
                    "total_results", F.col("facility_references").cast("long").alias("facility_references"),
                    _r6("facility_diversity_ratio"))


KR_SQL = (f"(({sql_count_present('lower(chunk_text)', TERMS[:3])} / 3.0) "
          f"+ CASE WHEN length(chunk_text) > 500 THEN 1.0 ELSE 0.0 END) / 2")


@register("keyword_relevance", EVAL_CTE + f"""
, q AS (SELECT query_id, avg({KR_SQL}) AS avg_relevance_score FROM res GROUP BY query_id)
SELECT round(avg(avg_relevance_score), 6) AS avg_relevance, round(quantile_cont(avg_relevance_score, 0.95), 6) AS p95_relevance,
       CAST(sum(CASE WHEN round(avg_relevance_score, 9) > 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS queries_above_0_7,
       CAST(count(*) AS BIGINT) AS queries FROM q""")
def keyword_relevance(t):
    """(keyword share + custom check) / 2 per result, per query mean,
    then mean, p95 and count above 0.7."""
    res = _results(t).withColumn("kr", EV.keyword_relevance("chunk_text", TERMS[:3], F.length("chunk_text") > 500))
    q = res.groupBy("query_id").agg(F.avg("kr").alias("s"))
    r = A.grouped(q, [], "s", {"p95_relevance": 0.95}, F.avg("s").alias("avg_relevance"),
                  F.sum(F.when(F.round("s", 9) > 0.7, 1).otherwise(0)).cast("long").alias("queries_above_0_7"),
                  F.count(F.lit(1)).alias("queries"))
    return r.select(*[F.round(c, 6).alias(c) for c in ("avg_relevance", "p95_relevance")], "queries_above_0_7", "queries")


SD_SQL = (f"CASE WHEN {sql_contains_any('lower(chunk_text)', L.SAFETY_DENSITY_MARKERS)} "
          f"THEN least({sql_count_present('lower(chunk_text)', L.SAFETY_DENSITY_INDICATORS)} / 13.0, 1.0) * 1.2 "
          f"ELSE least({sql_count_present('lower(chunk_text)', L.SAFETY_DENSITY_INDICATORS)} / 13.0, 1.0) END")


@register("safety_density", EVAL_CTE + f"""
SELECT query_id, round(avg({SD_SQL}), 6) AS safety_density FROM res GROUP BY query_id""")
def safety_density(t):
    """Mean safety-indicator density of each query's results."""
    r = _results(t).groupBy("query_id").agg(F.avg(EV.safety_density("chunk_text")).alias("d"))
    return r.select("query_id", F.round("d", 6).alias("safety_density"))


def _current_metrics(t):
    """Long (metric, value) table measured from the log and the evaluation."""
    ev = t.events
    lat = A.grouped(ev, [], "value", {"p95_latency_ms": 0.95}, F.avg("value").alias("avg_latency_ms"),
                    F.max("value").alias("max_latency_ms"),
                    F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"))
    acc = EV.prf_overall(_per_query(t)).select(F.col("f1").alias("f1_score"), "precision", "recall")
    one = lat.crossJoin(acc)
    names = ["avg_latency_ms", "p95_latency_ms", "max_latency_ms", "error_rate", "f1_score", "precision", "recall"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                          for n in names])).alias("m")).select("m.*")


METRICS_SQL = EVAL_CTE + """,
lat AS (SELECT avg(value) AS avg_latency_ms, quantile_cont(value, 0.95) AS p95_latency_ms, max(value) AS max_latency_ms,
               avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate FROM events),
acc AS (SELECT avg(f1) AS f1_score, avg(precision) AS precision, avg(recall) AS recall FROM prf1),
mt AS (SELECT * FROM (SELECT * FROM lat, acc) UNPIVOT (value FOR metric IN
       (avg_latency_ms, p95_latency_ms, max_latency_ms, error_rate, f1_score, precision, recall)))"""

RULES_VALUES = ", ".join(f"('{m}', '{o}', {v}, '{msg}')" for m, o, v, msg in L.TARGET_RULES)


@register("threshold_rules", METRICS_SQL + f""",
rules AS (SELECT * FROM (VALUES {RULES_VALUES}) AS r(metric, op, threshold, message))
SELECT mt.metric, round(CAST(mt.value AS DOUBLE), 6) AS value, op, CAST(threshold AS DOUBLE) AS threshold, message
FROM mt JOIN rules ON rules.metric = mt.metric
WHERE (op = '>' AND mt.value > threshold) OR (op = '<' AND mt.value < threshold)""")
def threshold_rules(t):
    """Measured metrics against the target/alert rule table."""
    rules = t.spark.createDataFrame(L.TARGET_RULES, "metric string, op string, threshold double, message string")
    r = EV.threshold_rules(_current_metrics(t), rules)
    return r.select("metric", F.round("value", 6).alias("value"), "op", "threshold", "message")


@register("metric_improvement", METRICS_SQL + f""",
cur AS (SELECT 'avg_query_latency_ms' AS metric, value FROM mt WHERE metric = 'avg_latency_ms'
        UNION ALL SELECT 'p95_query_latency_ms', value FROM mt WHERE metric = 'p95_latency_ms'
        UNION ALL SELECT 'accuracy_f1_score', value FROM mt WHERE metric = 'f1_score'
        UNION ALL SELECT 'throughput_qps', count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) FROM events),
base AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {v})" for m, v in L.BASELINE_METRICS)}) AS b(metric, value)),
imp AS (SELECT base.metric, CAST(base.value AS DOUBLE) AS baseline_value, CAST(cur.value AS DOUBLE) AS current_value,
               CASE WHEN contains(base.metric, 'cost') OR contains(base.metric, 'latency')
                    THEN (base.value - cur.value) / base.value ELSE (cur.value - base.value) / base.value END * 100 AS ip
        FROM base JOIN cur ON cur.metric = base.metric)
SELECT metric, baseline_value, round(current_value, 6) AS current_value, round(ip, 6) AS improvement_percentage,
       ip > 0 AS better FROM imp""")
def metric_improvement(t):
    """Measured metrics vs the baseline table (lower is better for
    latency and cost)."""
    cur = _current_metrics(t)
    ren = {"avg_latency_ms": "avg_query_latency_ms", "p95_latency_ms": "p95_query_latency_ms",
           "f1_score": "accuracy_f1_score"}
    m = F.create_map(*[x for k, v in ren.items() for x in (F.lit(k), F.lit(v))])
    cur = cur.where(F.col("metric").isin(list(ren))).select(m[F.col("metric")].alias("metric"), "value")
    tput = A.throughput(t.events.withColumn("_all", F.lit(1)), ["_all"]).select(
        F.lit("throughput_qps").alias("metric"), F.col("qps").alias("value"))
    base = t.spark.createDataFrame(L.BASELINE_METRICS, "metric string, value double")
    r = EV.metric_improvement(base, cur.unionByName(tput))
    return r.select("metric", "baseline_value", F.round("current_value", 6).alias("current_value"),
                    F.round("improvement_percentage", 6).alias("improvement_percentage"), "better")


@register("grade", METRICS_SQL + """,
d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS ms FROM events GROUP BY 1),
sc AS (SELECT day, (acc.f1_score * 100 + greatest(0.0, 100 - ms / 10) + least(100.0, greatest(0.0, 91.4))) / 3.0 AS score
       FROM d, acc)
SELECT day, round(score, 6) AS score,
       CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'B+' WHEN score >= 75 THEN 'B'
            WHEN score >= 70 THEN 'C+' WHEN score >= 65 THEN 'C' ELSE 'D' END AS overall_grade,
       CASE WHEN score - 50 >= 50 THEN 'A+' WHEN score - 50 >= 30 THEN 'A' WHEN score - 50 >= 20 THEN 'B+'
            WHEN score - 50 >= 10 THEN 'B' WHEN score - 50 >= 0 THEN 'C' ELSE 'D' END AS improvement_grade
FROM sc""")
def grade(t):
    """Overall score per log day (F1, latency, 91.4 % savings) and both
    grade ladders (the improvement ladder applied to score - 50)."""
    f1 = EV.prf_overall(_per_query(t)).select(F.col("f1").alias("f1_score"))
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("ms")).crossJoin(f1)
    s = d.withColumn("score", EV.overall_score("f1_score", "ms", F.lit(91.4)))
    return s.select("day", F.round("score", 6).alias("score"), EV.grade("score", L.SCORE_GRADES).alias("overall_grade"),
                    EV.grade(F.col("score") - 50, L.IMPROVEMENT_GRADES).alias("improvement_grade"))


@register("answer_coverage", f"""
SELECT conv_id, turn, round(((CAST({sql_contains_any('lower(text)', ['daily'])} AS DOUBLE))
  + CAST({sql_contains_any('lower(text)', ['weekly'])} AS DOUBLE)
  + CAST({sql_contains_any('lower(text)', ['monthly'])} AS DOUBLE)
  + CAST({sql_contains_any('lower(text)', ['vacuum', 'temperature', 'particle', 'calibrat'])} AS DOUBLE)) / 4.0, 6)
  AS quality_score, CAST(length(text) AS BIGINT) AS answer_length
FROM conversations WHERE role = 'assistant'""")
def answer_coverage(t):
    """E15 on every assistant turn."""
    a = t.conversations.where(F.col("role") == "assistant")
    return a.select("conv_id", "turn", F.round(EV.answer_coverage("text"), 6).alias("quality_score"),
                    F.length("text").cast("long").alias("answer_length"))


@register("key_metrics", METRICS_SQL + """
SELECT round(max(CASE WHEN metric = 'avg_latency_ms' THEN value END), 3) AS avg_latency_ms,
       round(max(CASE WHEN metric = 'p95_latency_ms' THEN value END), 3) AS p95_latency_ms,
       round(max(CASE WHEN metric = 'f1_score' THEN value END), 3) AS f1_score,
       round(max(CASE WHEN metric = 'error_rate' THEN value END), 3) AS error_rate FROM mt""")
def key_metrics(t):
    """Headline metrics picked from the long table into one row."""
    return EV.key_metrics(_current_metrics(t), ["avg_latency_ms", "p95_latency_ms", "f1_score", "error_rate"])


SWEEP = [round(0.1 * i, 1) for i in range(1, 10)]


@register("threshold_sweep", f"""
WITH ch AS {window_chunks_sql(source="(SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")},
s AS (SELECT q.vec_id AS query_id, {cosine_sql('ce.embedding', 'q.embedding')} AS score,
             CASE WHEN q.label = ce.label THEN 1 ELSE 0 END AS same
      FROM embeddings q CROSS JOIN ch JOIN embeddings ce ON ce.vec_id = ch.doc_id),
th AS (SELECT CAST(unnest({SWEEP}) AS DOUBLE) AS threshold),
g AS (SELECT query_id, threshold, count(*) FILTER (score >= threshold) AS n, sum(score) FILTER (score >= threshold) AS total,
             count(*) FILTER (score >= threshold AND same = 1) AS hits, sum(same) AS relevant
      FROM s CROSS JOIN th GROUP BY query_id, threshold),
m AS (SELECT threshold, CAST(sum(n) AS BIGINT) AS results, CAST(count(*) FILTER (n > 0) AS BIGINT) AS queries_with_results,
             sum(total) / nullif(sum(n), 0) AS avg_score, sum(hits) / CAST(nullif(sum(n), 0) AS DOUBLE) AS p,
             sum(hits) / CAST(nullif(sum(relevant), 0) AS DOUBLE) AS r,
             avg(CASE WHEN n > 0 THEN hits / CAST(n AS DOUBLE) END) AS qp
      FROM g GROUP BY threshold)
SELECT threshold, results, queries_with_results, round(avg_score, 6) AS avg_score, round(p, 6) AS precision,
       round(r, 6) AS recall, round(qp, 6) AS avg_query_precision,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0.0 END, 6) AS f1
FROM m""")
def threshold_sweep(t):
    """Results and quality (label agreement) at thresholds 0.1 .. 0.9, counted inside one scan."""
    chunks = retrieval.chunk_vectors(t.documents, t.embeddings, with_text=False)
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    scores = VS.sweep_scores(chunks.select("doc_id", "embedding").join(labels, "doc_id"), FX.vector_queries(t), SWEEP)
    r = EV.threshold_sweep(scores)
    return r.select("threshold", "results", "queries_with_results", *[
        F.round(c, 6).alias(c) for c in ("avg_score", "precision", "recall", "avg_query_precision", "f1")])


def sqlq(x):
    return "'" + x.replace("'", "''") + "'"


def _labelled_sql() -> str:
    vals = ", ".join(
        f"({i}, {sqlq(c)}, {sqlq(q)}, {sql_str_list([L.TYPE_ALIASES.get(x, x) for x in exp])})"
        for i, (c, q, exp, _, _) in enumerate(L.LABELLED_QUERIES))
    tok = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    terms = ["maintenance", "safety", "quality", "process"]
    return f"""
WITH ch AS {window_chunks_sql()},
ct AS (SELECT chunk_id, chunk_text, {sql_classify('lower(chunk_text)', L.DOCUMENT_TYPE_CLASSES, 'general')} AS document_type FROM ch),
q AS (SELECT * FROM (VALUES {vals}) v(query_id, category, query_text, expected)),
tk AS (SELECT 'c' AS side, chunk_id AS id, unnest({tok.format('chunk_text')}) AS tok FROM ct
       UNION ALL SELECT 'q', CAST(query_id AS VARCHAR), unnest({tok.format('query_text')}) FROM q),
b AS (SELECT side, id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS dim,
             CASE WHEN (CAST(('0x' || substr(md5(tok), 9, 1)) AS BIGINT) & 1) = 1 THEN 1.0 ELSE -1.0 END AS sgn FROM tk),
v AS (SELECT side, id, dim, sum(sgn) AS val FROM b GROUP BY side, id, dim),
nv AS (SELECT side, id, sqrt(sum(val * val)) AS nrm FROM v GROUP BY side, id),
vn AS (SELECT v.side, v.id, v.dim, v.val / nv.nrm AS x FROM v JOIN nv ON nv.side = v.side AND nv.id = v.id WHERE nv.nrm > 0),
cs AS (SELECT CAST(qv.id AS BIGINT) AS query_id, cv.id AS chunk_id, round(sum(qv.x * cv.x), 9) AS score
       FROM (SELECT * FROM vn WHERE side = 'q') qv JOIN (SELECT * FROM vn WHERE side = 'c') cv ON qv.dim = cv.dim
       GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs WHERE score > 0.1),
top AS (SELECT r.query_id, r.rank, ct.document_type, ct.chunk_text FROM r JOIN ct ON ct.chunk_id = r.chunk_id WHERE r.rank <= 5),
got AS (SELECT query_id, list(DISTINCT document_type) AS retrieved, max(CASE WHEN rank = 1 THEN chunk_text END) AS top_text
        FROM top GROUP BY query_id),
pq AS (SELECT q.category, got.top_text,
              coalesce(len(list_filter(coalesce(got.retrieved, []), lambda x: list_contains(q.expected, x))), 0) AS hit,
              coalesce(len(got.retrieved), 0) AS nr, len(list_distinct(q.expected)) AS ne
       FROM q LEFT JOIN got ON got.query_id = q.query_id),
m AS (SELECT category,
             CASE WHEN nr = 0 AND ne = 0 THEN 1.0 WHEN nr = 0 OR ne = 0 THEN 0.0 ELSE hit / CAST(nr AS DOUBLE) END AS p,
             CASE WHEN nr = 0 AND ne = 0 THEN 1.0 WHEN nr = 0 THEN 0.0 WHEN ne = 0 THEN 1.0 ELSE hit / CAST(ne AS DOUBLE) END AS rc,
             CASE WHEN top_text IS NOT NULL THEN {sql_count_present('lower(top_text)', terms)} / 4.0 END AS tc FROM pq),
m2 AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f1 FROM m)
SELECT category, round(avg(p), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f1), 6) AS f1,
       round(avg(tc), 6) AS term_coverage, CAST(count(*) AS BIGINT) AS query_count FROM m2 GROUP BY category"""


@register("labelled_eval", _labelled_sql())
def labelled_eval(t):
    """E1 + E2 + E4 + E6 end to end with the labelled query set: every
    document is window-chunked, typed (P12) and hash-embedded (V5); the 12
    labelled queries are embedded the same way and answered by the exact
    top-5 search (cosine > 0.1); retrieved types are scored against the
    expected ones through the alias table."""
    from ..operators import chunking
    from ..operators import embed as EM
    spark = t.spark
    plain = chunking.chunk_window(t.documents).withColumn(
        "document_type", X.classify_ordered("chunk_text", L.DOCUMENT_TYPE_CLASSES, "general"))
    ch = EM.embed_batches(plain, "chunk_text")
    rows = [(i, c, q, [L.TYPE_ALIASES.get(x, x) for x in exp], kw)
            for i, (c, q, exp, _, kw) in enumerate(L.LABELLED_QUERIES)]
    qs = spark.createDataFrame(rows, "query_id long, category string, query_text string, "
                                     "expected array<string>, expected_keywords array<string>")
    qv = EM.embed_batches(qs, "query_text")
    res = retrieval.top_k_by_vector(ch, qv, k=5, threshold=0.1, key_cols=("chunk_id",))
    # Types and texts come from the chunks before embedding: the corpus is embedded once.
    res = res.join(plain.select("chunk_id", "document_type", "chunk_text"), "chunk_id")
    got = res.groupBy("query_id").agg(F.collect_list("document_type").alias("retrieved"),
                                      F.max(F.when(F.col("rank") == 1, F.col("chunk_text"))).alias("top_text"))
    j = qs.join(got, "query_id", "left")
    m = EV.prf("retrieved", "expected")
    per_q = j.select("category", m["precision"].alias("precision"), m["recall"].alias("recall"), m["f1"].alias("f1"),
                     F.when(F.col("top_text").isNotNull(),
                            EV.term_coverage("top_text", ["maintenance", "safety", "quality", "process"]))
                      .alias("term_coverage"))
    return per_q.groupBy("category").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                                         F.round(F.avg("term_coverage"), 6).alias("term_coverage"),
                                         F.count(F.lit(1)).alias("query_count"))


@register("labelled_retrieval", _labelled_sql().split("\ntop AS", 1)[0] + """
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def labelled_retrieval(t):
    """V5 + R1 with the labelled queries: hash-embedded chunks of every
    document, top-5 per labelled query (cosine > 0.1) -- the retrieval step
    of ``labelled_eval``."""
    from ..operators import chunking
    from ..operators import embed as EM
    spark = t.spark
    ch = EM.embed_batches(chunking.chunk_window(t.documents), "chunk_text")
    qs = spark.createDataFrame([(i, q) for i, (_, q, _, _, _) in enumerate(L.LABELLED_QUERIES)],
                               "query_id long, query_text string")
    res = retrieval.top_k_by_vector(ch, EM.embed_batches(qs, "query_text"), k=5, threshold=0.1, key_cols=("chunk_id",))
    return res.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
