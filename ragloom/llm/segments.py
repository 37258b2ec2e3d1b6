"""Splitting whole batches of texts into distinct short segments.

Tokenizers split a text at the space between two words in any case, so the ids
of a text are those of its space-separated segments one after another. A batch
has far fewer distinct segments than segments: Arrow splits and
dictionary-encodes them, an encoder sees each distinct one once, and numpy
gathers the results back into texts. Memory is bounded by ``CHUNK_BYTES`` of
text (or by the longest single text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The White_Space characters of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK_BYTES = 8 << 20


@dataclass(frozen=True)
class Border:
    """Where a tokenizer splits.

    ``irregular`` finds texts in which a space is not simply a border between
    two words; those are cut by ``segment`` instead.
    """
    irregular: str
    segment: re.Pattern


#: For ``public_tokenizers.PATTERN``: runs of white space have rules of their own.
BYTE_LEVEL = Border(
    f"[{SPACE}][{SPACE}]|^[{SPACE}]|[{SPACE}]$",
    re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"))
#: For sentence pieces: a piece never has a space after another character.
PIECES = Border("  |^ | $", re.compile(" +[^ ]*|[^ ]+"))


@dataclass
class Segments:
    """Text i is ``forms[entry[bounds[i]:bounds[i + 1]]]`` joined; forms up to ``plain``
    have no white space at either end but one space that may lead."""
    forms: list[str]
    entry: np.ndarray
    bounds: np.ndarray
    plain: int

    def gather(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values per form (``flat``, ``sizes`` each) -> values and bounds per text."""
        starts = np.cumsum(sizes) - sizes
        size = sizes[self.entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        values = flat[np.repeat(starts[self.entry] - (ends - size), size) + np.arange(total)]
        return values, np.concatenate([[0], ends])[self.bounds]


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) slices of about CHUNK_BYTES each."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // CHUNK_BYTES
    first = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(first, [*first[1:], len(texts)]):
        yield int(a), texts.slice(a, b - a)


def split(texts: pa.Array, border: Border) -> Segments:
    """Distinct segments of ``texts`` (no nulls) and where they stand."""
    odd = np.asarray(pc.match_substring_regex(texts, border.irregular).to_pylist(), dtype=bool)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain = ~odd & ~empty
    lists = pc.split_pattern(pc.filter(texts, pa.array(plain)), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    count = np.zeros(len(texts), dtype=np.int64)
    count[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    forms = [" " + w for w in words]
    entry_plain = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.cumsum(count[plain]) - count[plain]
    first_words = entry_plain[heads]
    entry_plain[heads] = len(forms) + np.arange(len(heads))
    forms += [words[w] for w in first_words]
    n_plain = len(forms)
    # Irregular texts: their segments are found one text at a time.
    known: dict[str, int] = {}
    at = np.flatnonzero(odd)
    parts = [border.segment.findall(t) for t in pc.filter(texts, pa.array(odd)).to_pylist()]
    entry_odd = np.fromiter((known.setdefault(s, n_plain + len(known)) for p in parts for s in p), dtype=np.int64)
    count[at] = [len(p) for p in parts]
    bounds = np.concatenate([[0], np.cumsum(count)])
    entry = np.empty(bounds[-1], dtype=np.int64)
    is_odd = np.repeat(odd, count)
    entry[~is_odd] = entry_plain
    entry[is_odd] = entry_odd
    return Segments(forms + list(known), entry, bounds, n_plain)


class Memo:
    """Bounded memory of results per form: when the young half is full it becomes
    the old half, so forms in use survive."""

    def __init__(self, compute, entries: int = 300_000, longest: int = 48):
        self.compute, self.entries, self.longest = compute, entries, longest
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, form):
        found = self.young.get(form)
        if found is None:
            found = self.old.get(form)
            if found is None:
                found = self.compute(form)
            if len(form) <= self.longest:
                if len(self.young) >= self.entries // 2:
                    self.old, self.young = self.young, {}
                self.young[form] = found
        return found
