"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the BPE encoding of its text exactly if every two
neighbours are compatible: their joined bytes encode to those two tokens again.
So an encoder need not merge step by step. It takes the longest token at each
place (an Aho-Corasick automaton over the vocabulary, bytes mapped to Latin-1
characters), shortens it to the next shorter token that is a prefix of it while
it is incompatible with its predecessor, and drops the predecessor when nothing
shorter is left. Each place is given up at most once, so the time is linear.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import per_process, text_of, vocabulary
from .segments import BYTE_LEVEL, Memo, chunks, split


class BacktrackBpe:
    """Exact merges for one vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pair_entries: int = 1_000_000):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pair_entries = pair_entries
        self.shorter: dict[bytes, bytes | None] = {}
        self.longest = max(map(len, ranks))
        self.trie = ahocorasick.Automaton()
        for token in ranks:
            # A token that merging never yields takes no part in matching.
            if len(token) == 1 or self.merge(token) == [token]:
                self.trie.add_word(token.decode("latin-1"), token)
        self.trie.make_automaton()
        self.known_word = Memo(lambda piece: self.word(piece.encode()))

    def merge(self, word: bytes) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank until none can be."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.ranks)), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.pair_entries:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def shorten(self, token: bytes) -> bytes | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1)
                                        if self.trie.exists(token[:n].decode("latin-1"))), None)
        return self.shorter[token]

    def word(self, data: bytes) -> list[int]:
        """Ids of one piece of text that the pattern does not split."""
        if data in self.ranks and self.trie.exists(data.decode("latin-1")):
            return [self.ranks[data]]
        chars, size = data.decode("latin-1"), len(data)
        dead = bytearray(size + 1)  # places at which no encoding can go on
        taken: list[bytes] = []
        at, token = 0, self._longest(chars, 0)
        while at < size:
            while token is not None and (dead[at + len(token)]
                                         or taken and not self.compatible(taken[-1], token)):
                token = self.shorten(token)
            if token is not None:
                taken.append(token)
                at += len(token)
                token = self._longest(chars, at) if at < size else None
            else:
                dead[at] = 1
                token = taken.pop()
                at -= len(token)
        return [self.ranks[t] for t in taken]

    def _longest(self, chars: str, at: int) -> bytes:
        # Every single byte is a token, so the first match starts at ``at``; no match is
        # longer than the longest token, and the automaton is given no more than that.
        return next(self.trie.iter_long(chars[at:at + self.longest]))[1]

    def packed(self, text: str) -> bytes:
        return np.array([i for piece in self.pieces.findall(text) for i in self.known_word(piece)],
                        dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class BatchEncoder:
    """Encodes and decodes whole batches by their distinct segments."""

    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        with open(vocabulary(name, folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = BacktrackBpe(ranks, public_tokenizers.PATTERN)
        self.segment = Memo(self.bpe.packed)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's."""
        parts = split(texts, BYTE_LEVEL)
        found = [self.segment(f) for f in parts.forms]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return parts.gather(np.frombuffer(b"".join(found), dtype="<u4"), sizes)


def encoder(folder: str | None = None) -> BatchEncoder:
    return per_process(("bpe", folder), lambda: BatchEncoder(folder))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     folder: str | None = None) -> DataFrame:
    """(id, ids array) of every whole text; null and empty texts have no ids.

    Ties, repeated rows and other columns do not matter: a row is encoded by its
    text alone. An empty table gives no rows.
    """
    def encode(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                ids, bounds = encoder(folder)(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), lists], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
                     folder: str | None = None) -> DataFrame:
    """(id, decoded binary) of arrays of ids; a null array decodes to no bytes."""
    def decode(batches):
        for batch in batches:
            data = [encoder(folder).bpe.decode(np.asarray(x.as_py() or [], dtype=np.int64))
                    for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(decode, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     folder: str | None = None) -> DataFrame:
    """Round trip in one pass: n_tokens, ids_sha256 and decoded_sha256 of every text.

    Null and empty texts have no tokens and the digests of nothing. A row is encoded by
    its text alone, so ties, repeated rows and other columns have no effect; an empty
    table gives no rows. Time grows with the text, however long a run without a split is.
    """
    def digest(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                bpe = encoder(folder).bpe
                ids, bounds = encoder(folder)(texts)
                packed = ids.astype("<u4")
                own = [packed[a:b] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own])],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                             ).withColumnRenamed("id", id_col)
