"""Exact token counts at every prefix, by dynamic programming.

For a vocabulary whose pieces merge in rank order, the encoding of a text's
prefix that ends at place i ends with the one piece that is compatible with the
last piece of the prefix before it. ``last[i]`` and ``count[i]`` follow from
earlier places, so one pass gives the token count of *every* prefix, and
"how far do 4096 tokens reach" needs no second encoding.

Spaces become a visible mark, a text starts with one, and no piece has a mark
after another character; so words are programs of their own and are remembered.
Characters without a piece fall back to one token per UTF-8 byte.
"""

from __future__ import annotations

from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import per_process, text_of, vocabulary
from .segments import PIECES, Memo, chunks, split

MARK = "▁"


class PrefixCounter:
    """Counts for one sentencepiece model of the BPE kind."""

    def __init__(self, folder: str | None = None, name: str = "piece_bpe_32k.model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name, folder))
        ordinary = [i for i in range(model.get_piece_size())
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.trie = ahocorasick.Automaton()
        self.runs = 0  # longest piece of marks alone
        for piece in self.score:
            if not piece.strip(MARK):
                self.runs = max(self.runs, len(piece))
            if len(piece) > 1 and piece.strip(MARK) and self.merge(piece) == [piece]:
                self.trie.add_word(piece, piece)
        self.trie.make_automaton()
        self.word = Memo(self.word_counts, longest=64)

    def merge(self, text: str) -> list[str]:
        """The definition: merge the pair of highest score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.score), default=None)
            if best is None:
                break
            at = -best[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def run_count(self, marks: int) -> int:
        """Tokens of a run of marks: equal scores merge from the left, so the longest
        run piece fills up first and the rest merges alone."""
        whole, rest = divmod(marks, self.runs or 1)
        return whole + (len(self.merge(MARK * rest)) if rest else 0)

    def word_counts(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Token counts after each character of a word with at most one mark, in front; and
        whether the first token of that prefix is its first character alone."""
        size = len(word)
        count = [0] * (size + 1)
        last = [""] * (size + 1)
        alone = [True] * (size + 1)
        ending: list[list[str]] = [[] for _ in range(size)]
        for end, piece in self.trie.iter(word):
            ending[end].append(piece)
        for i, char in enumerate(word):
            for piece in ending[i]:
                start = i + 1 - len(piece)
                if not last[start] or self.compatible(last[start], piece):
                    last[i + 1], count[i + 1] = piece, count[start] + 1
                    alone[i + 1] = alone[start] and start > 0
                    break
            else:
                last[i + 1] = char
                count[i + 1] = count[i] + (1 if char in self.score else len(char.encode()))
                alone[i + 1] = alone[i]
        return np.array(count[1:], dtype=np.int32), np.array(alone[1:], dtype=bool)

    def segment_counts(self, segment: str) -> np.ndarray:
        """Token counts after each character of marks followed by a word."""
        word = segment.lstrip(MARK)
        marks = len(segment) - len(word)
        if marks < 2 and word:
            return self.word(segment)[0]
        alone = np.array([self.run_count(n) for n in range(1, marks + 1)], dtype=np.int32)
        if not word:
            return alone
        # The last mark joins the word if the word's first token takes it in, else it
        # stays in the run.
        inner, free = self.word(MARK + word)
        rest = np.where(free, self.run_count(marks) + inner - 1, self.run_count(marks - 1) + inner)
        return np.concatenate([alone, rest[1:]]).astype(np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Element i: the tokens of the text's first i characters."""
        if not text:
            return np.zeros(1, dtype=np.int64)
        counts, total = [np.zeros(1, dtype=np.int64)], 0
        for i, segment in enumerate(PIECES.segment.findall(" " + text.replace(MARK, " "))):
            found = self.segment_counts(segment.replace(" ", MARK))
            counts.append(total + found[1:] if i == 0 else total + found)
            total += int(found[-1])
        return np.concatenate(counts)


class BatchCounter:
    """Counts for whole batches by their distinct segments."""

    def __init__(self, folder: str | None = None):
        self.prefix = PrefixCounter(folder)
        self.last = Memo(lambda form: int(self.prefix.segment_counts(form)[-1]))

    def __call__(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, characters of its longest prefix within the budget)."""
        # The mark in front makes every first word a spaced one.
        spaced = pc.replace_substring(texts, MARK, " ")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = split(spaced, PIECES)
        firsts = np.zeros(len(parts.entry), dtype=bool)
        firsts[parts.bounds[:-1][~empty]] = True
        shown = [f.replace(" ", MARK) for f in parts.forms]
        plain = np.fromiter((self.last(f) for f in shown), dtype=np.int64, count=len(shown))
        size = plain[parts.entry]
        for at in np.flatnonzero(firsts):
            size[at] = self.last(MARK + shown[parts.entry[at]])
        ends = np.concatenate([[0], np.cumsum(size)])
        tokens = ends[parts.bounds[1:]] - ends[parts.bounds[:-1]]
        reach = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.flatnonzero(tokens > budget):
            a, b = parts.bounds[i], parts.bounds[i + 1]
            # Words before the one in which the budget ends, then places inside it.
            whole = int(np.searchsorted(ends[a + 1:b + 1] - ends[a], budget, side="right"))
            forms = [shown[e] for e in parts.entry[a:a + whole + 1]]
            left = budget - int(ends[a + whole] - ends[a])
            inner = self.prefix.segment_counts((MARK if not whole else "") + forms[-1])[0 if whole else 1:]
            fits = np.flatnonzero(inner <= left)
            reach[i] = sum(map(len, forms[:-1])) + (int(fits[-1]) + 1 if len(fits) else 0)
        return tokens, reach


def counter(folder: str | None = None) -> BatchCounter:
    return per_process(("prefix counts", folder), lambda: BatchCounter(folder))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 folder: str | None = None) -> DataFrame:
    """n_bytes, n_tokens, over_limit and fit_chars of every whole text.

    ``fit_chars`` is the length of the longest prefix of whole words, and of
    characters within the next word, that stays within ``limit`` tokens.
    Null and empty texts have 0 tokens. Repeated rows are counted alike; other
    columns are not looked at; an empty table gives no rows.
    """
    def count(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                tokens, reach = counter(folder)(texts, limit)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pc.cast(pc.binary_length(texts), pa.int64()),
                    pa.array(tokens), pa.array(tokens > limit), pa.array(reach)],
                    ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
                             ).withColumnRenamed("id", id_col)
