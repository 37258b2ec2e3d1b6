import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from ragloom.llm import periodic_runs, queries
from ragloom.llm.periodic_runs import Settings, runs_of


def brute_runs(words, least=6, exponent=4):
    """Every stretch of equal words a period apart, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.setdefault((i, j + q - i), q)
            i = j
    # The smallest period of a stretch was met first.
    return sorted((s, size, q) for (s, size), q in found.items() if size >= max(least, exponent * q)
                  and not any((s2 <= s and s + size <= s2 + z2 and q % q2 == 0 and q2 < q)
                              for (s2, z2), q2 in found.items()))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = set()
    for s, size, q in runs:
        dropped.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("letters,exponent", [(2, 4), (2, 2), (3, 3), (1, 4), (6, 2)])
def test_runs_of_random_words(letters, exponent):
    rng = random.Random(letters * 10 + exponent)
    for _ in range(150):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and words:
            words = words[:rng.randint(1, len(words))] * rng.randint(2, 6) + words[:5]
        assert runs_of(np.array(words, np.int64), Settings(exponent=exponent)) == brute_runs(words, 6, exponent)


def test_candidates_hold_every_run():
    rng = random.Random(8)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while rng.random() < 0.8:
                words += [rng.randrange(40) for _ in range(rng.randint(0, 12))]
                words += [rng.randrange(40) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
            texts.append(words)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = np.array([w for t in texts for w in t], np.int64)
        got = [[] for _ in texts]
        for a, b in periodic_runs._candidates(flat, bounds, Settings()).tolist():
            row = int(np.searchsorted(bounds, a, side="right")) - 1
            assert b <= bounds[row + 1]
            got[row] += [(a + s - bounds[row], z, q) for s, z, q in runs_of(flat[a:b])]
        assert [sorted(g) for g in got] == [brute_runs(t) for t in texts]


def test_query_against_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))]
        if i % 4 == 0:
            words += words[:3] * rng.randint(1, 9)
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words) + rng.choice(["", " "])))
    rows += [(1001, "\x1c a\x1d b \x85 c d " * 5), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def got(docs):
        return sorted((tuple(r[n] for n in names) for r in
                       queries.run_digests(queries.planted_repeats(docs)).collect()), key=str)
    assert got(df) == sorted((expected(*r) for r in rows), key=str)
    edge = [(r["doc_id"], r["text"]) for r in edge_docs.collect() if len(r["text"] or "") < 2000]
    from pyspark.sql import functions as F
    small = edge_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 2000).withColumnRenamed("kept", "runs")
    assert got(small) == sorted((expected(*r) for r in edge), key=str)
    assert got(no_docs) == []


def test_long_texts_take_time_in_proportion(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    times = []
    for repeats in (10, 40):
        words = np.unique(base * repeats, return_inverse=True)[1]
        began = time.process_time()
        assert runs_of(words) == [(0, 4000 * repeats, 4000)]
        times.append(time.process_time() - began)
    assert times[1] < 6 * times[0] + 0.5
    megabytes = " ".join(base * 100)
    row = periodic_runs.periodic_runs(spark.createDataFrame([(2, megabytes), (3, "a" * 3_000_000)],
                                                            "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in row[0]["runs"]] == [(0, 400_000, 4000)] and row[0]["collapsed"] == " ".join(base)
    assert row[1]["runs"] == [] and row[1]["n_words"] == 1
