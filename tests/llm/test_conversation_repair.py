import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import conversation_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def brute(rows, convs):
    """Cheapest and least edits by plain recursion over whole strings."""
    result = {}
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, roles, inserted):
            """(cost, audit) of rows i.. after a grammar state shown by the last role."""
            options = []
            if i == len(own) and roles in ("", "a"):
                options.append((0, ""))
            put = "a" if roles == "u" else "u"
            if inserted < 2:
                c, s = best(i, put, inserted + 1)
                options.append((c + 2, "I" + s))
            if i < len(own):
                c, s = best(i + 1, roles, 0)
                options.append((c + 3, "D" + s))
                if faults[i] not in ("blank", "duplicate"):
                    extra = faults[i] == "truncated"
                    c, s = best(i + 1, put, 0)
                    options.append((c + 2 + extra, "R" + s))
                    initial = own[i][2][:1]
                    if initial == put or (initial == "s" and roles == ""):
                        c, s = best(i + 1, initial, 0)
                        options.append((c + extra, "K" + s))
            return min(options) if options else (10 ** 9, "")

        cost, audit = best(0, "", 0)
        at, state, out = 0, "", []
        for letter in audit:
            role, text = own[at][2:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            out.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                        faults.count("duplicate"), faults.count("truncated"),
                        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                        hashlib.sha256("\n".join(out).encode()).hexdigest())
    return result


def rows_of(seed, n=120):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Hello there.", "What now?", "no end", " ", None, "", "tail . ", "Yes!\n", "a.", "b.", "c.", "é?"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), rows[0], rows[0]]
    return rows


def collected(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in got}


@pytest.mark.parametrize("segment", [1024, 2])
def test_equal_to_plain_recursion(spark, segment):
    rows = rows_of(segment)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tie", F.lit(1)).withColumn("fault", F.lit("x")).repartition(4)
    got = collected(conversation_repair.repair(queries.damaged(df), conversations=df, segment=segment))
    assert got == brute(damage(rows), {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = damage(rows_of(9, 40))
    turns = spark.createDataFrame(rows, SCHEMA)
    expected = collected(conversation_repair.repair(turns))
    whole = {}
    for r in sorted(conversation_repair.repaired_turns(turns).collect(), key=lambda r: r["place"]):
        whole.setdefault(r["conv_id"], []).append(r)
    for conv, found in expected.items():
        got = whole.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in got))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in got)
        assert hashlib.sha256(text.encode()).hexdigest() == found[-1]
        assert "".join(r["edit"] for r in got) == found[-2].replace("D", "")


def test_one_conversation_of_many_thousand_turns(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i % 900}" + rng.choice([".", ""])) for i in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    long = collected(conversation_repair.repair(df, segment=64))
    assert long == collected(conversation_repair.repair(df, segment=4096))
    assert long[1][2] > 20_000 and len(long[1][6]) >= 30_000


def test_ranks_and_edges(spark):
    # A row that may stay after nothing: assistant first is inserted before or deleted.
    kinds = np.array([3, 2, 3])
    letters, out, ends, total = conversation_repair.least_audits(
        kinds, np.array([0, 3]), conversation_repair.Costs().closing()[None], conversation_repair.Costs())
    first = bytes(letters[out[0]:out[1]]).decode()
    assert (first, ends[0], total[0]) == ("IKKK", 3, 2)
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(none).collect() == []
    assert conversation_repair.repaired_turns(none).collect() == []
    only = spark.createDataFrame([(5, 1, "user", "gone")], SCHEMA)
    got = collected(conversation_repair.repair(only.limit(0), conversations=only))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
