"""Periodic runs of words, by a suffix automaton with link-cut access.

The last end of every factor is kept as a colour of the automaton's link tree:
after word i the path from the root to the state of the first i words gets colour
i. Link-cut access walks that path by its segments of one old colour j; the longest
factor of a segment, of length L, ended at j before, so with i - j <= L there is
a square of period i - j that ends at i. The distance is the least, as j is the
last end, hence the period is the smallest. A square is extended to its run both ways.

Only words near a close repeat are appended: a run of period q and exponent k
repeats each of its 3-grams, but those of the first period, at a distance of at most
q, so it shows as a stretch of such places of at least (k - 1) q - 2 words. Stretches
too short for their distances cannot hold a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import text_of
from .segments import chunks

_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """A run has at least ``length`` words (6 or more) and ``exponent`` periods (2 or more)."""
    length: int = 6
    exponent: int = 4

    def __post_init__(self):
        if self.length < 6 or self.exponent < 2:
            raise ValueError("runs need a length of 6 and an exponent of 2 at least")


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of longest factors, and the state of each prefix.

    Most states have one transition, kept in two lists; further ones in dictionaries.
    """
    link, length, word, to = [-1], [0], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    states, last = [], 0
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(0)
        p = last
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            others = more.get(p)
            if others is not None and c in others:
                q = others[c]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            elif others is None:
                more[p] = {c: new}
            else:
                others[c] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = clone
                    else:
                        others = more.get(p)
                        if others is None or others.get(c) != q:
                            break
                        others[c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        states.append(new)
        last = new
    return link, length, states


class _Paths:
    """Link-cut paths over a fixed tree: splay trees by depth, one colour each (at its root)."""

    def __init__(self, parent: list[int]):
        self.up = list(parent)
        self.shallow = [-1] * len(parent)
        self.deep = [-1] * len(parent)
        self.colour = [0] * len(parent)

    def splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while True:
            p = up[x]
            if p < 0:
                return
            if shallow[p] == x:
                x_first = True
            elif deep[p] == x:
                x_first = False
            else:
                return
            g = up[p]
            inner = g >= 0 and (shallow[g] == p or deep[g] == p)
            if not inner:
                self.colour[x] = self.colour[p]
                self._rotate(x, p, g, x_first, 0)
                return
            p_first = shallow[g] == p
            above = up[g]
            side = 0 if above < 0 else 1 if shallow[above] == g else 2 if deep[above] == g else 0
            if not side:
                self.colour[x] = self.colour[g]
            if p_first == x_first:
                self._rotate(p, g, above, p_first, side)
                self._rotate(x, p, above, x_first, side)
            else:
                self._rotate(x, p, g, x_first, 1 if p_first else 2)
                self._rotate(x, g, above, p_first, side)

    def _rotate(self, x: int, p: int, above: int, first: bool, side: int) -> None:
        """x takes the place of its parent p; side: p is no, the first or the second child of above."""
        up, shallow, deep = self.up, self.shallow, self.deep
        if first:
            inner, deep[x] = deep[x], p
            shallow[p] = inner
        else:
            inner, shallow[x] = shallow[x], p
            deep[p] = inner
        if inner >= 0:
            up[inner] = p
        up[p], up[x] = x, above
        if side == 1:
            shallow[above] = x
        elif side == 2:
            deep[above] = x

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colours the path from the root to ``node``; returns its old segments as
        (colour, deepest node)."""
        found, below, x = [], -1, node
        up, deep, colours = self.up, self.deep, self.colour
        while x >= 0:
            self.splay(x)
            old = colours[x]
            if old:
                found.append((old, x))
            cut = deep[x]
            if cut >= 0:
                colours[cut] = old
            deep[x] = below
            below, x = x, up[x]
        self.splay(node)
        colours[node] = colour
        return found


def _agree(words: np.ndarray, at: int, period: int, step: int) -> int:
    """The first place from ``at`` in direction ``step`` where words a period apart differ."""
    size = 64
    while True:
        lo, hi = (at, min(at + size, len(words) - period)) if step > 0 else (max(0, at + 1 - size), at + 1)
        if lo >= hi:
            return at
        differ = np.flatnonzero(words[lo:hi] != words[lo + period:hi + period])
        if len(differ):
            return lo + int(differ[0 if step > 0 else -1])
        at = hi if step > 0 else lo - 1
        size *= 2


def runs_of(words: np.ndarray, settings: Settings = Settings()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence of numbers, by start and period."""
    link, length, states = _automaton(words.tolist())
    paths = _Paths(link)
    known: dict[int, int] = {}
    found = []
    for i, state in enumerate(states, 1):
        for last, node in paths.access(state, i):
            period = i - last
            if period > length[node] or known.get(period, 0) >= i:
                continue
            end = _agree(words, i - period, period, 1) + period
            start = _agree(words, i - period - 1, period, -1) + 1
            known[period] = end
            if end - start >= max(settings.length, settings.exponent * period):
                found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _candidates(words: np.ndarray, bounds: np.ndarray, settings: Settings):
    """(from, to) of the parts of texts that can hold runs; they do not overlap."""
    n = len(words)
    if n < 3:
        return np.empty((0, 2), np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = words.astype(np.uint64)
    gram = ((text[2:].astype(np.uint64) * _M ^ x[2:]) * _M + x[1:-1]) * _M
    gram = ((gram ^ (gram >> np.uint64(31))) + x[:-2]) * _M
    gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    distance = np.full(n, n, np.int64)
    distance[order[1:][again] + 2] = (order[1:] - order[:-1])[again]
    inside = np.zeros(n, dtype=bool)
    inside[2:] = text[2:] == text[:-2]
    flagged = inside & (distance < n)
    while True:
        edge = np.flatnonzero(np.diff(flagged.astype(np.int8), prepend=0, append=0))
        # A stretch ends with its text, too: the first two words of one are never flagged.
        first, last = edge[::2], edge[1::2]
        size = last - first
        reach = (size + 2) // (settings.exponent - 1)
        limit = np.zeros(n, np.int64)
        limit[flagged] = np.repeat(reach, size)
        kept = flagged & (distance <= limit)
        if kept.sum() == flagged.sum():
            break
        flagged = kept
    if not len(first):
        return np.empty((0, 2), np.int64)
    begin = np.maximum(first - 2 - reach, bounds[text[first]])
    order = np.argsort(begin, kind="stable")
    begin, last = begin[order], np.maximum.accumulate(last[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] >= last[:-1]) | (text[begin[1:]] != text[begin[:-1]])
    head = np.flatnonzero(new)
    return np.stack([begin[head], last[np.append(head[1:], len(begin)) - 1]], axis=1)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words of all texts, the words, and where each text's begin."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    coded = pc.filter(flat, real).dictionary_encode()
    size = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary,
            size[np.concatenate([[0], ends])].astype(np.int64))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  settings: Settings = Settings()) -> DataFrame:
    """The id, n_words, ``runs`` (start, length, period, by start and period) and
    ``collapsed`` text of every row.

    Words are separated by ASCII white space and compared byte by byte. A run is as
    long as its smallest period allows. ``collapsed`` keeps the words that no run has
    after its first period, joined by spaces. Null and empty texts have no words, no runs
    and an empty collapsed text. Repeated rows are treated alike; other columns are not
    looked at; an empty table gives no rows. The words of a text have to fit into a
    task; only parts that can hold runs are indexed.
    """
    def find(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                words, names, bounds = _words(texts)
                runs: list[list[dict]] = [[] for _ in range(len(texts))]
                keep = np.ones(len(words), dtype=bool)
                for a, b in _candidates(words, bounds, settings).tolist():
                    row = int(np.searchsorted(bounds, a, side="right")) - 1
                    for start, length, period in runs_of(words[a:b], settings):
                        runs[row].append({"start": a + start - int(bounds[row]), "length": length, "period": period})
                        keep[a + start + period:a + start + length] = False
                left = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(left), names.take(pa.array(words[keep])))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pa.array(np.diff(bounds)),
                    pa.array(runs, pa.list_(_RUN)), pc.binary_join(kept, " ")],
                    ["id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,"
                                   "period:bigint>>, collapsed string").withColumnRenamed("id", id_col)
