"""Packing documents into fixed windows by minimum bin slack.

A document longer than the window gives full windows and one rest. Of the
rests only the *histogram of lengths* matters for packing, and it has fewer than
``capacity`` entries however many documents there are: Spark counts it, the
planner opens each window with the longest length left and lets a subset-sum
program over a bitset pick the multiset of remaining lengths that comes closest
to the room left. A pattern is used as often as the counts allow, so the plan
stays small (bounded by the window size, not by the documents), and every piece
finds its window from its length and its running number within that length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import frozen, per_process, text_of, vocabulary
from .segments import BYTE_LEVEL, chunks, split

CAPACITY = 2048
END_OF_DOCUMENT = 1
#: Ordinals of one length stay under this; length * ORDINALS + ordinal is one sort key.
ORDINALS = 1 << 48


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths from ``counts`` whose total is closest to ``room`` from below.

    Bit t of ``reach`` says that total t can be made. Counts are added by binary
    splitting; the stored states let the totals be traced back to counts.
    Longer lengths come first, so that short ones are left for later windows.
    """
    mask, reach, states = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        states.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(states):
        while not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: count}) patterns that use up the histogram."""
    left, patterns = dict(histogram), []
    while left:
        seed = max(left)
        others = dict(left)
        others[seed] -= 1
        if not others[seed]:
            del others[seed]
        pattern = fill(others, capacity - seed) if seed < capacity else {}
        pattern[seed] = pattern.get(seed, 0) + 1
        copies = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= copies * k
            if not left[n]:
                del left[n]
        patterns.append((copies, pattern))
    return patterns


def _placement(patterns) -> pd.DataFrame:
    """One row per (length, pattern): which ordinals of the length go where."""
    rows, used, window = [], {}, 0
    for copies, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            count, first = pattern[length], used.get(length, 0)
            rows.append((length * ORDINALS + first, first, count, window, offset, length))
            used[length] = first + copies * count
            offset += count * length
        window += copies
    return pd.DataFrame(rows, columns=["key", "first", "count", "window", "offset", "length"]).sort_values("key")


class _JsonIds:
    """Ids as the json tokenizer gives them, for whole batches.

    The json vocabulary and the rank file are one vocabulary (a test holds the
    two libraries together); tiktoken, the faster one, encodes the distinct
    segments of a batch as one text whose lines they are. Texts with the
    special string, one id wherever it stands, go to the json tokenizer.
    """

    def __init__(self, folder: str | None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.json = Tokenizer.from_file(vocabulary("byte_bpe_50k.json", folder))
        with open(vocabulary("byte_bpe_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.line_end = ranks[b"\n"]

    def _lines(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for forms without white space at their ends: in a
        joined text each line end stands between two words, so it is an id of its own."""
        ids = self.ordinary.encode_to_numpy("\n".join(forms), disallowed_special=())
        line = np.cumsum([f.count("\n") + 1 for f in forms])  # of line ends up to a form's own
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != line[-1] - 1:
            raise ValueError("line ends merged with a neighbour")
        stop = np.append(ends, len(ids))[line - 1]
        start = np.concatenate([[0], stop[:-1] + 1])
        keep = np.ones(len(ids), dtype=bool)
        keep[stop[:-1]] = False
        return ids[keep], stop - start

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            found = [np.array(self.json.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                     if s else self(pa.array([t]))[0] for t, s in zip(texts.to_pylist(), special)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        parts = split(texts, BYTE_LEVEL)
        plain, odd = parts.forms[:parts.plain], parts.forms[parts.plain:]
        found = [self._lines(plain[i:i + 50_000]) for i in range(0, len(plain), 50_000)]
        found += [(ids, np.array([len(ids)])) for ids in
                  (self.ordinary.encode_to_numpy(f, disallowed_special=()) for f in odd)]
        if not found:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        return parts.gather(*(np.concatenate(x) for x in zip(*found)))


def json_ids(folder: str | None = None) -> _JsonIds:
    return per_process(("json ids", folder), lambda: _JsonIds(folder))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Pieces of each document: full windows and a rest, cut every ``capacity`` ids.

    ``part`` and ``nth`` number the pieces of one length within their task.
    """
    def cut(batches):
        from pyspark import TaskContext
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                ids, bounds = json_ids(folder)(texts)
                rows = []
                for i in range(len(texts)):
                    own = np.append(ids[bounds[i]:bounds[i + 1]], END_OF_DOCUMENT).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start:start + capacity]
                        nth = seen.get(len(piece), 0)
                        seen[len(piece)] = nth + 1
                        rows.append((first + i, start, len(piece), zlib.crc32(piece.tobytes()), len(own), nth))
                at, *rest = (pa.array(c, pa.int64()) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), *rest, pa.array([part] * len(at), pa.int32())],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, "
                                  "doc_tokens long, nth long, part int")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Pack every document into windows of ``capacity`` tokens.

    Returns one row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset (gapless from 0 in each sequence). Null and empty
    texts are a single end id; repeated rows are packed as often as they occur;
    an empty table gives no rows; other columns of the input are not looked at.
    """
    pieces = frozen(token_pieces(docs, id_col, text_col, capacity, folder))
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    # Distinct lengths and tasks bound both tables; neither holds documents.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.pieces for r in
                 per_task.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    place = _placement(plan_windows(histogram, capacity))
    keys, firsts, counts, windows, offsets = (place[c].to_numpy() for c in
                                              ("key", "first", "count", "window", "offset"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * ORDINALS + ordinal.to_numpy(), side="right") - 1
        ahead = ordinal.to_numpy() - firsts[at]
        return pd.DataFrame({"sequence_id": windows[at] + ahead // counts[at],
                             "offset": offsets[at] + ahead % counts[at] * length.to_numpy()})

    numbered = pieces.join(starts, ["part", "length"])
    return numbered.withColumn("at", placed("length", F.col("base") + F.col("nth"))).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
