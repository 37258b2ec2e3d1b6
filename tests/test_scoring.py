"""Keywords, scores and retrieval against brute-force Python."""

import math
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import lexicons as L
from ragloom.functions import text as X
from ragloom.functions import vectors as V
from ragloom.functions import vectors as FV
from ragloom.operators import evaluate as EV
from ragloom.operators import ivf as IVF
from ragloom.operators import search as S
from ragloom.operators import vector_search as VS


def py_keywords(text, k):
    words = [w for w in re.findall(r"\b[a-z]+\b", text.lower())
             if w not in set(L.STOP_WORDS) and len(w) > 3]
    return [w for w, _ in Counter(words).most_common(k)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["alpha", "beta", "gamma", "with", "délta", "ab", " ", ". ", "x1"]),
                         max_size=40).map("".join), min_size=1, max_size=4))
def test_keywords_match_counter(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r.kw for r in X.with_keywords(df, "text", "kw", 3).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_keywords(t, 3)


def test_keywords_ties_and_accents(spark):
    df = spark.createDataFrame([(0, "zeta alpha zeta alpha beta réseau réseau réseau")], "i long, text string")
    kw = X.with_keywords(df, "text", "kw", 10).first().kw
    assert kw == ["zeta", "alpha", "beta"]       # tie by first occurrence; accented word dropped whole


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0]),
                                ([1.0, 2.0], [1.0]), ([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine_similarity("a", "b").alias("c")).collect()]
    assert got[:4] == [1.0, 0.0, 0.0, 0.0]
    assert math.isclose(got[4], 0.8)


def _brute_topk(chunks, queries, k, thr):
    out = {}
    for qid, qv in queries:
        q = np.asarray(qv, float)
        sc = []
        for cid, cv in chunks:
            c = np.asarray(cv, float)
            s = 0.0 if not (np.any(c) and np.any(q)) else float(c @ q / (np.linalg.norm(c) * np.linalg.norm(q)))
            s = round(s, 9)
            if s > thr:
                sc.append((-s, cid))
        out[qid] = [cid for _, cid in sorted(sc)[:k]]
    return out


def test_topk_exact_with_ties_and_blocks(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 8))
    chunks = [(f"c{i:03d}", base[i % 10].tolist()) for i in range(30)]      # triplets of identical vectors
    chunks.append(("zero", [0.0] * 8))
    queries = [(j, rng.normal(size=8).tolist()) for j in range(12)] + [(99, base[3].tolist())]
    cdf = spark.createDataFrame(chunks, "chunk_id string, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = _brute_topk(chunks, queries, 4, 0.1)
    for block, group in ((1 << 20, 1 << 20), (300, 1 << 20), (300, 700)):   # one block; several; several groups too
        got = VS.top_k_by_vector(cdf, qdf, k=4, threshold=0.1, block_bytes=block, group_bytes=group)
        res = {}
        for r in got.orderBy("query_id", "rank").collect():
            res.setdefault(r.query_id, []).append(r.chunk_id)
        assert res == {q: v for q, v in want.items() if v}
    assert VS.top_k_by_vector(cdf, qdf.limit(0)).collect() == [] == VS.top_k_by_vector(cdf.limit(0), qdf).collect()
    assert VS.top_k_by_vector(cdf.limit(0), qdf, block_bytes=300).collect() == []
    assert res[99][:3] == ["c003", "c013", "c023"]          # self-similarity ties broken by id


def test_hybrid_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["pump", "valve", "seal", "motor", "belt"]
    chunks = [(i, f"k{i}", rng.normal(size=4).tolist(), [words[i % 5], words[(i + 1) % 5]], float(i % 3) / 3)
              for i in range(20)]
    queries = [(0, rng.normal(size=4).tolist(), ["pump", "belt"]), (1, rng.normal(size=4).tolist(), ["seal"])]
    cdf = spark.createDataFrame(chunks, "doc_id long, chunk_id string, embedding array<double>, keywords array<string>, "
                                        "importance_score double")
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>, keywords array<string>")
    got = S.hybrid_search(cdf, qdf, k=5).orderBy("query_id", "rank").collect()
    for qid, qv, qk in queries:
        q = np.asarray(qv)
        rows = []
        for _, cid, cv, kws, imp in chunks:
            c = np.asarray(cv)
            sem = round(float(c @ q / (np.linalg.norm(c) * np.linalg.norm(q))), 9)
            kw = len(set(kws) & set(qk)) / len(kws)
            if sem > 0.3 or kw > 0:
                rows.append((-round(0.7 * sem + (1 - 0.7) * 0.5 * kw + imp * 0.2, 9), cid))
        want = [cid for _, cid in sorted(rows)[:5]]
        assert [r.chunk_id for r in got if r.query_id == qid] == want


def test_bm25_matches_brute_force(spark):
    docs = ["the pump seal leaks", "seal seal valve", "motor belt", "pump pump pump motor", ""]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(docs)], "doc_id long, chunk_id string, chunk_text string")
    queries = spark.createDataFrame([("q1", "pump seal"), ("q2", "belt")], "query_id string, query_text string")
    got = S.bm25_search(chunks, queries, k=3).orderBy("query_id", "rank").collect()
    toks = [t.split() for t in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    for qid, qt in [("q1", "pump seal"), ("q2", "belt")]:
        sc = []
        for i, tl in enumerate(toks):
            s = 0.0
            for term in set(qt.split()):
                tf = tl.count(term)
                if tf:
                    df = sum(term in x for x in toks)
                    s += (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(tl) / avgdl)) * math.log((n - df + 0.5) / (df + 0.5) + 1)
            if round(s, 9) > 0:
                sc.append((-round(s, 9), f"c{i}"))
        assert [r.chunk_id for r in got if r.query_id == qid] == [c for _, c in sorted(sc)[:3]]


def test_prf_edge_cases(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["a"])],
                               "r array<string>, e array<string>")
    got = [tuple(r.m) for r in df.select(EV.prf("r", "e").alias("m")).collect()]
    assert got[:3] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    assert got[3][0] == 0.5 and got[3][1] == 1.0


def test_rerank_is_stable(spark):
    res = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 13)], "query_id long, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, "c3", 0.9), (1, "c5", 0.9), (1, "c12", 1.0)],
                                   "query_id long, chunk_id string, rerank_score double")
    got = [r.chunk_id for r in S.rerank(res, scores, top_k=4).orderBy("rank").collect()]
    assert got == ["c12", "c3", "c5", "c1"]
    got = [r.chunk_id for r in S.rerank(res, scores, top_k=4, scored=10).orderBy("rank").collect()]
    assert got == ["c3", "c5", "c1", "c2"]          # c12 is beyond the first 10 -> 0


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("h1", 2, 0, "b"), ("h1", 1, 5, "a"), ("h2", 3, 0, "c")],
                               "chunk_hash string, doc_id long, chunk_index long, chunk_id string")
    got = {r.chunk_hash: r.chunk_id for r in S.dedup_chunks(df).collect()}
    assert got == {"h1": "a", "h2": "c"}


def test_dedup_hot_hash(spark):
    rows = [("hot" if i % 3 == 0 else f"h{i}", i // 7, i % 7, f"c{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "chunk_hash string, doc_id long, chunk_index long, chunk_id string").repartition(8)
    got = {r.chunk_hash: (r.doc_id, r.chunk_index) for r in S.dedup_chunks(df).collect()}
    assert len(got) == 1 + 2000 and got["hot"] == (0, 0)


def test_hybrid_empty_keywords_and_null_vector(spark):
    cdf = spark.createDataFrame([(1, "a", [1.0, 0.0], [], 0.5), (2, "b", None, ["pump"], 0.1)],
                                "doc_id long, chunk_id string, embedding array<double>, keywords array<string>, "
                                "importance_score double")
    qdf = spark.createDataFrame([(0, [1.0, 0.0], ["pump"])], "query_id long, embedding array<double>, keywords array<string>")
    got = {r.chunk_id: (r.semantic_score, r.keyword_score) for r in S.hybrid_search(cdf, qdf, k=5).collect()}
    assert got == {"a": (1.0, 0.0), "b": (0.0, 1.0)}


def test_multi_block_hybrid_and_bm25_equal_single_block(spark):
    rng = np.random.default_rng(5)
    words = ["pump", "valve", "seal", "motor", "belt", "gear"]
    chunks = spark.createDataFrame(
        [(i, f"k{i:02d}", rng.normal(size=4).tolist(), [words[i % 6], words[(i + 2) % 6]], float(i % 4) / 4,
          f"{words[i % 6]} {words[(i + 1) % 6]} {words[i % 6]}") for i in range(30)],
        "doc_id long, chunk_id string, embedding array<double>, keywords array<string>, importance_score double, "
        "chunk_text string")
    qv = spark.createDataFrame([(j, rng.normal(size=4).tolist(), [words[j % 6]]) for j in range(9)],
                               "query_id long, embedding array<double>, keywords array<string>")
    qt = spark.createDataFrame([(f"q{j}", f"{words[j % 6]} {words[(j + 3) % 6]}") for j in range(9)],
                               "query_id string, query_text string")

    def rows(df):
        return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "rank").collect())

    assert rows(S.hybrid_search(chunks, qv, k=3)) == rows(S.hybrid_search(chunks, qv, k=3, block_bytes=150, group_bytes=400))
    assert rows(S.bm25_search(chunks, qt, k=3)) == rows(S.bm25_search(chunks, qt, k=3, block_bytes=150, group_bytes=400))
    index = S.term_counts(chunks, ["doc_id", "chunk_id"])
    assert rows(S.bm25_search(chunks, qt, k=3)) == rows(S.bm25_search(chunks, qt, k=3, index=index))


def _vectors(spark, n, seed, dim=6, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim)) * 2
    rows = [(i, f"c{i:04d}", (centres[i % kinds] + rng.normal(size=dim)).tolist(), f"l{i % kinds}" if i % 7 else None,
             float(i % 5) / 5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, chunk_id string, embedding array<double>, label string, "
                                             "importance_score double").repartition(5)


def test_sweep_counts_and_quality(spark):
    rows, df = _vectors(spark, 200, 3)
    q = df.where("id % 9 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    steps = [0.1, 0.5, 0.9, 0.99999]
    want = {}
    for r in rows[::9]:
        for th in steps:
            got = [x for x in rows if round(float(unit[x[0]] @ unit[r[0]]), 9) >= th]
            same = sum(x[3] == r[3] and r[3] is not None for x in got)
            want[r[0], th] = (len(got), same, sum(x[3] == r[3] and r[3] is not None for x in rows))
    for block, group in ((1 << 20, 1 << 20), (400, 900)):
        scores = VS.sweep_scores(df, q, steps, block_bytes=block, group_bytes=group)
        assert {(r.query_id, r.threshold): (r.results, r.hits, r.relevant) for r in scores.collect()} == want
    r = {x.threshold: x for x in EV.threshold_sweep(scores).collect()}
    total = [want[k] for k in want if k[1] == 0.5]
    assert r[0.5].precision == pytest.approx(sum(t[1] for t in total) / sum(t[0] for t in total))
    assert r[0.5].recall == pytest.approx(sum(t[1] for t in total) / sum(t[2] for t in total))
    assert r[0.99999].results == r[0.99999].queries_with_results == len(rows[::9])


def test_ivf_rounds_are_exact(spark):
    for seed, kinds, spread in ((1, 4, 1.0), (2, 40, 1.0)):
        rows, df = _vectors(spark, 400, seed, kinds=kinds)
        q = df.where("id % 11 = 0").select(F.col("id").alias("query_id"), "embedding")
        cents, assigned = IVF.ivf_build(df.select("chunk_id", "embedding"), n_lists=8, seed=3)
        want = {q_: v for q_, v in _brute_topk([(r[1], r[2]) for r in rows], [(r[0], r[2]) for r in rows[::11]], 5, 0.3).items()}
        for block in (1 << 20, 400):
            res = {}
            for r in IVF.ivf_search(assigned, q, cents, k=5, nprobe=1, block_bytes=block).orderBy("query_id", "rank").collect():
                res.setdefault(r.query_id, []).append(r.chunk_id)
            assert res == {k: v for k, v in want.items() if v}
        first = IVF.ivf_search(assigned, q, cents, k=5, nprobe=1, exact=False)
        exact = VS.top_k_by_vector(df, q, k=5, threshold=0.3)
        assert IVF.recall_at_k(first, exact).agg(F.avg("recall")).first()[0] < 1


def test_hybrid_join_needs_k_candidates_a_query(spark):
    rng = np.random.default_rng(4)
    rows, df = _vectors(spark, 150, 6)
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    kw = [(int(i), f"c{int(j):04d}", float(s)) for i in range(0, 150, 10) for j, s in
          zip(rng.choice(150, 6, replace=False), rng.choice([0.0, 0.3, 1.0], 6))]
    kws = spark.createDataFrame(kw, "query_id long, chunk_id string, keyword_score double")
    every = (df.crossJoin(q.select("query_id", F.col("embedding").alias("qv"))).select(
        "query_id", "chunk_id", "importance_score",
        F.round(FV.cosine_similarity("embedding", "qv"), 9).alias("semantic_score")))

    def ranks(pairs):
        return sorted((r.query_id, r["rank"], r.chunk_id) for r in S.hybrid_left_join(pairs, kws, k=5).collect())
    few = S.hybrid_candidates(df, q, kws, k=5)
    assert ranks(few) == ranks(every) and few.count() <= 15 * (5 + 6)


def test_dealt_queries_keep_k_rows_whatever_the_copies(spark, monkeypatch):
    seen = []
    finish = VS.finish_topk
    monkeypatch.setattr(VS, "finish_topk", lambda cand, k, order: seen.append(cand) or finish(cand, k, order))
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4, 6))
    chunks = [(f"c{i:04d}", base[i % 4 if i > 600 else 0].tolist(), float(i % 3)) for i in range(900)]
    queries = [(j % 38 if j else None, (base[j % 4] + rng.normal(size=6) * 0.05).tolist()) for j in range(40)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, embedding array<double>, quality double").repartition(4)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")

    def got(block, group):
        r = VS.top_k_by_vector(cdf, qdf, k=3, secondary="quality", block_bytes=block, group_bytes=group)
        return sorted((-1 if x.query_id is None else x.query_id, x["rank"], x.chunk_id, x.score) for x in r.collect())
    whole = got(1 << 20, 1 << 20)
    assert got(500, 900) == whole and len(whole) == 39 * 3      # two ids are asked for twice
    parts = spark.sparkContext.defaultParallelism
    assert seen[-1].count() <= 40 * 3 * parts                   # not one row for each of 600 equal scores


def test_unit_vectors_take_the_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([2.0, None],)], "v array<double>")
    assert [r.u for r in df.select(V.l2_normalize("v").alias("u")).collect()] == [[0.6, 0.8], None, None, [1.0, None]]
    many = spark.createDataFrame([([float(i) for i in range(1, 3001)],)] * 8, "v array<double>").repartition(1)
    t = time.time()
    many.select(F.sum(F.aggregate(V.l2_normalize("v"), F.lit(0.0), lambda a, x: a + x))).collect()
    assert time.time() - t < 10                                 # a norm for each number: 3000 times the work


def test_sweep_scores_equal_chunks_once(spark, monkeypatch):
    seen = []
    scan = VS.scan
    monkeypatch.setattr(VS, "scan", lambda chunks, *a, **b: seen.append(chunks) or scan(chunks, *a, **b))
    rows = [(i, [1.0, float(i % 3)], "a" if i % 2 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label string")
    q = df.where("id < 4").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    small = {tuple(r) for r in VS.sweep_scores(df, q, [0.2, 0.9]).collect()}
    assert seen[-1].count() == 6
    assert {(r[0], r[1], r[2], r[4], r[5]) for r in small} == {
        (r[0], r[1], r[2], r[4], r[5]) for r in VS.sweep_scores(df, q, [0.2, 0.9], block_bytes=60, group_bytes=100).collect()}
    assert {(r[0], r[1], r[2], r[4], r[5]) for r in small} >= {(1, 0.2, 120, 60, 60), (0, 0.9, 40, 0, 0)}


def test_common_terms_score_as_rare_ones(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"k{i:02d}", f"pump w{i % 7} seal w{i % 5}") for i in range(40)],
                                   "doc_id long, chunk_id string, chunk_text string")
    qt = spark.createDataFrame([(f"q{j}", f"pump seal w{j % 9}") for j in range(60)], "query_id string, query_text string")

    def got(**sizes):
        r = S.bm25_search(chunks, qt, k=4, **sizes).collect()
        return sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 8)) for x in r)
    dense = got(), got(block_bytes=300, group_bytes=1 << 20)
    monkeypatch.setattr(S, "OFTEN_TERMS", 0)
    assert dense == (got(),) * 2 and len(dense[0]) == 240


def test_hybrid_finder_gives_what_the_scorer_gives_above_the_floor(spark, monkeypatch):
    held = {}
    scan = S.scan_topk
    monkeypatch.setattr(S, "scan_topk", lambda *a, **b: held.update(payload=a[4], scorer=a[5], **b) or scan(*a, **b))
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]

    def some(n):
        return [rng.choice(words, n, replace=False).tolist() for _ in range(60)]
    vec, kw, imp = rng.normal(size=(60, 6)).round(1).tolist(), some(3), rng.random(60).round(2).tolist()
    vec[3], vec[4], kw[5], kw[6], imp[7] = None, [0.0] * 6, [], None, None
    qv, qk = rng.normal(size=(800, 6)).round(1).tolist(), [x for _ in range(14) for x in some(2)][:800]
    qv[8], qk[9], qv[10] = None, None, vec[0]
    cdf = spark.createDataFrame([(i, f"c{i:02d}", *x) for i, x in enumerate(zip(vec, kw, imp))],
                                "doc_id long, chunk_id string, embedding array<double>, keywords array<string>, importance_score double")
    qdf = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(qv, qk))],
                                "query_id long, embedding array<double>, keywords array<string>")

    def rows(**limits):
        return sorted(map(tuple, S.hybrid_search(cdf, qdf, k=4, **limits).collect()))
    whole = rows()
    assert rows(block_bytes=2000, group_bytes=1 << 20) == whole and len(whole) > 800 * 3

    ready = held["payload"](pd.DataFrame({"qv": qv, "qk": qk}), 6)
    part = pd.DataFrame({"_v": vec, "_kw": kw, "_imp": imp})
    rank, keep, extra = held["scorer"](part, ready)
    floor = np.sort(np.where(keep, rank, -np.inf), axis=0)[-4]
    r, c = np.nonzero(keep & (rank >= floor))
    got = held["finder"](part, ready, floor)
    assert set(zip(*got[:2])) == set(zip(r, c)) and len(got[0]) == len(r)
    for name in extra:
        assert np.array_equal(got[3][name], extra[name][got[0], got[1]])
    assert np.array_equal(got[2], rank[got[0], got[1]])
    assert held["finder"](part, ready, np.full(800, -np.inf)) is None    # most cells pass: the scorer's


def test_hybrid_candidates_of_many_queries(spark):
    rows, df = _vectors(spark, 120, 8)
    q = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    kws = spark.createDataFrame([(0, "c0007", 0.5), (5, "c0011", 0.2)], "query_id long, chunk_id string, keyword_score double")

    def got(**sizes):
        cands = S.hybrid_candidates(df, q, kws, k=5, **sizes)
        return sorted(tuple(r) for r in S.hybrid_left_join(cands, kws, k=5).drop("semantic_score", "hybrid_score").collect())
    assert got(block_bytes=400, group_bytes=900) == got() and len(got()) > 90


def test_quality_score_of_texts_without_sentences(spark):
    from ragloom.operators import enrich as E
    texts = ["", "  ", "...", " . ", "word " * 10 + ".", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    got = {r.i: r.q for r in df.select("i", F.round(E.quality_score("text"), 6).alias("q")).collect()}
    assert got == {0: 0.6, 1: 0.6, 2: 0.6, 3: 0.6, 4: 0.7, 5: 1.7}


def test_screen_misses_nothing_at_the_floor():
    rng = np.random.default_rng(9)
    rows, queries = rng.normal(size=(300, 24)), rng.normal(size=(400, 24))
    worth, product = rng.random(300), rows @ queries.T
    floor = np.sort(product + worth[:, None], axis=0)[-3]      # exactly the third best
    floor[7], floor[8] = np.inf, -np.inf
    r, c = VS.Screen(queries).hits(rows, worth, floor)
    found = set(zip(r.tolist(), c.tolist()))
    assert found >= set(zip(*np.nonzero(product + worth[:, None] >= floor))) and len(found) < 400 * 3 + 300 + 20
    assert VS.Screen(queries).hits(rows, worth, np.full(400, -np.inf)) is None      # most entries: left to the scorer


def _finder_against_scorer(held, part, ready, k):
    rank, keep, extra = held["scorer"](part, ready)
    floor = np.sort(np.where(keep, rank, -np.inf), axis=0)[-k]
    r, c = np.nonzero(keep & (rank >= floor))
    got = held["finder"](part, ready, floor)
    assert set(zip(*got[:2])) == set(zip(r, c)) and len(got[0]) == len(r) > 0
    for name in extra:
        assert np.allclose(got[3][name], extra[name][got[0], got[1]], atol=2e-9)


def test_bm25_finder_gives_what_the_scorer_gives_above_the_floor(spark, monkeypatch):
    held = {}
    scan = S.scan_topk
    monkeypatch.setattr(S, "scan_topk", lambda *a, **b: held.update(payload=a[4], scorer=a[5], **b) or scan(*a, **b))
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join(["pump", "seal"][:1 + n % 2] + rng.choice(words, n % 9).tolist())
    chunks = [(i, f"k{i:03d}", text(int(rng.integers(1, 60)))) for i in range(150)] + [(999, "none", None)]
    asked = [(f"q{j}", text(j)) for j in range(900)] + [("rare", "w3"), ("nothing", "zzz"), ("empty", ""), ("null", None)]
    cdf = spark.createDataFrame(chunks, "doc_id long, chunk_id string, chunk_text string")
    qdf = spark.createDataFrame(asked, "query_id string, query_text string")

    def rows(**sizes):
        return sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 8)) for x in S.bm25_search(cdf, qdf, k=2, **sizes).collect())
    whole = rows()
    monkeypatch.setattr(VS, "SCREEN_CELLS", 20 * 900)           # several slices, so that floors are used
    monkeypatch.setattr(VS, "SLICE_CELLS", 20 * 900)
    assert rows(block_bytes=3000, group_bytes=1 << 20) == whole and len(whole) > 1700

    index = S.term_counts(cdf, ["doc_id", "chunk_id"]).toPandas()
    weights = S.query_weights(S.term_counts(cdf, ["doc_id", "chunk_id"]), qdf, 151).toPandas()
    _finder_against_scorer(held, index, held["payload"](weights, 0), 2)


def test_vector_and_ivf_finders_give_what_the_scorers_give_above_the_floor(spark, monkeypatch):
    held = []
    for module in (VS, IVF):
        scan = module.scan_topk
        monkeypatch.setattr(module, "scan_topk", lambda *a, _scan=scan, **b: held.append(dict(payload=a[4], scorer=a[5], **b)) or _scan(*a, **b))
    rows, df = _vectors(spark, 300, 13)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    exact = VS.top_k_by_vector(df, q, k=4)
    cents, lists = IVF.ivf_build(df.select("chunk_id", "embedding"), n_lists=5, seed=3)
    IVF.ivf_search(lists, q, cents, k=4, nprobe=2).count()
    part = lists.select(F.col("embedding").alias("_v"), "ivf_list").orderBy("ivf_list").toPandas()
    asked = pd.DataFrame({"query_id": range(300), "qv": [r[2] for r in rows], "least": 0.9})
    for use in held:
        _finder_against_scorer(use, part, use["payload"](asked, 6), 1 if len(held) and use is held[-1] else 3)
    assert len(held) == 3 and exact.count() > 1000


def test_query_keywords_only_of_documents_that_ask(spark, monkeypatch):
    from types import SimpleNamespace

    from ragloom.plans import fixtures as FX
    seen = []
    take = X.with_keywords
    monkeypatch.setattr(X, "with_keywords", lambda df, *a, **b: seen.append(df) or take(df, *a, **b))
    docs = spark.createDataFrame([(1, "pump valve pump"), (2, "seal"), (2, "motor motor"), (None, "belt"), (5, None)],
                                 "doc_id long, text string")
    vectors = spark.createDataFrame([(2, [1.0], "a"), (2, [2.0], "a"), (3, [1.0], "b"), (None, [1.0], "c"), (5, [1.0], None)],
                                    "vec_id long, embedding array<double>, label string")
    got = FX.vector_queries(SimpleNamespace(documents=docs, embeddings=vectors), with_keywords=True)
    assert seen[0].count() == 3
    assert sorted((r.query_id or 0, r.keywords) for r in got.collect()) == [
        (0, []), (2, ["motor"]), (2, ["motor"]), (2, ["seal"]), (2, ["seal"]), (3, []), (5, [])]
