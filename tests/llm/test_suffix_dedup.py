import hashlib
import random

import pytest

from ragloom.llm import queries, suffix_dedup
from ragloom.llm.suffix_dedup import Settings


def brute(rows, length=50):
    """Removed byte flags of every (id, text) by a dictionary of all strings."""
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for s in range(len(data) - length + 1):
                w = data[s:s + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for s in range(len(data) - length + 1):
                if least[data[s:s + length]] < i:
                    gone[s:s + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    from pyspark.sql import functions as F
    return [tuple(r) for r in queries.repeat_digests(df).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def made_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(80)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        if i % 3 == 0:
            cut = rng.randint(0, len(text))
            part = passage[rng.randint(0, 40):rng.randint(60, len(passage))]
            text = text[:cut] + part + text[cut:]
        if i % 5 == 0 and rows:
            other = rows[rng.randrange(len(rows))][1] or ""
            k = rng.randint(0, max(0, len(other) - 1))
            text = other[:k] + "X" + other[k:]
        rows.append((rng.randint(0, 200), text))
    rows += [(7, "ab" * 200), (8, "ab" * 300), (9, "a" * 700), (10, "a" * 49), (3, "a" * 50), (11, None), (12, ""),
             (None, rows[0][1]), rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("settings", [Settings(), Settings(slice_bytes=200, cut=1), Settings(hot=1, cut=4)])
def test_equal_to_all_strings(spark, settings):
    rows = made_texts(settings.cut)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in queries.repeat_digests(df, settings).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted(result(edge_docs), key=str) == sorted(brute(rows), key=str)
    clash = edge_docs.withColumnRenamed("kept", "removed").withColumnRenamed("id", "key")
    assert len(result(clash)) == len(rows)
    assert result(no_docs) == []


def test_megabytes_and_spans(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    df = spark.createDataFrame([(1, long), (2, "xx" + long[1_999_000:2_200_000] + "yy")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1]["removed"] == [] and len(got[1]["kept"]) == 3_000_000
    assert [tuple(x) for x in got[2]["removed"]] == [(2, 2 + 201_000)]
    assert bytes(got[2]["kept"]) == b"xxyy"


def test_ranks_by_names():
    import numpy as np
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (500, 50)).astype(np.uint8)
    rows[250:, :40] = rows[:250, :40]
    order, common = suffix_dedup._ranks(rows)
    texts = [bytes(rows[i]) for i in order]
    assert texts == sorted(texts)
    for a, b, c in zip(texts, texts[1:], common[1:]):
        assert a[:c] == b[:c] and (c == 50 or a[c] != b[c])
