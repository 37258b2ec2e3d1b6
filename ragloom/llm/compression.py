"""Quality rules from compression: texts must compress neither too well nor too little.

Repetitive text compresses far better than prose of its length, random text far
worse. How well prose compresses depends on its length, so the limits are a
band over the length, read between knots on a logarithmic scale. The band holds
for the whole document and for fixed chunks of it, each by its own length. Its
upper side is where repetition starts, well above prose. Noise made of symbols
between words can compress like prose; a second band tells it, the text's compression
with and without its symbols. Random symbols cost compressed bytes of their own,
regular ones make the text more regular than its words are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_process, text_of

#: (bytes, lowest, highest ratio). Lowest from the labelled good documents, with a margin; highest
#: above licences, manuals and code in prose (up to 4.0) and below repeated or shouted words.
KNOTS = (
    (64, 0.70, 2.00), (128, 0.90, 2.30), (256, 1.05, 2.60), (512, 1.20, 2.90), (1024, 1.45, 3.20),
    (2048, 1.62, 3.50), (4096, 1.80, 3.80), (8192, 1.95, 4.00), (16384, 2.08, 4.20),
    (32768, 2.18, 4.40), (65536, 2.25, 4.60), (262144, 2.25, 5.00), (1048576, 2.25, 5.40), (4194304, 2.25, 5.60),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """``chunk`` bytes per chunk; a document may have ``bad_chunks`` of its chunks outside.
    ``symbols`` is the most that symbols may change the compressed size, or the ratio, of a
    document or chunk (manuals with code in prose: 1.077)."""
    knots: tuple = KNOTS
    chunk: int = 4096
    bad_chunks: float = 0.25
    symbols: float = 1.1
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        at, low, high = zip(*self.knots)
        place = np.log2(max(size, 1))
        return float(np.interp(place, np.log2(at), low)), float(np.interp(place, np.log2(at), high))


def ratio(data: bytes, level: int) -> float:
    packed = per_process(("zstd", level), lambda: zstandard.ZstdCompressor(level=level)).compress(data)
    return len(data) / len(packed)


def symbol_share(data: bytes, level: int) -> float:
    """Factor by which the symbols of a text change its compressed size or its ratio, the
    larger one; 1 without symbols, infinite for nothing else."""
    words = data.translate(None, SYMBOLS)
    if len(words) == len(data):
        return 1.0
    if not words:
        return float("inf")
    size, bare = len(data) / ratio(data, level), len(words) / ratio(words, level)
    return max(size / bare, ratio(data, level) / ratio(words, level))


def one_byte_letters(data: bytes) -> tuple[bytes, bool]:
    """Text of an alphabet beyond Latin with a byte a letter, as Latin has; and whether limits below hold.

    Letters of the most used 128 code points become one byte each. Scripts that use many
    more letters (ideographs, syllables) stay as they are, and no lower limit is known for them.
    """
    if data.isascii():
        return data, True
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    beyond = points[points >= 0x250]
    if 3 * len(beyond) < np.count_nonzero(points > 0x20):
        return data, True
    pages, counts = np.unique(beyond >> 7, return_counts=True)
    if 2 * counts.max() < len(beyond):
        return data, False
    page = pages[counts.argmax()]
    inside = (points >> 7) == page
    if len(points) == np.count_nonzero(inside | (points < 0x80)):
        return np.where(inside, 0x80 | points & 0x7F, points).astype(np.uint8).tobytes(), True
    # Runs of other letters keep their UTF-8 form.
    other = ~inside & (points >= 0x80)
    pieces = [bytes([0x80 | x & 0x7F]) if own else chr(x).encode("utf-8", "replace") if far else bytes([x])
              for x, own, far in zip(points.tolist(), inside.tolist(), other.tolist())]
    return b"".join(pieces), True


def judge(data: bytes, bands: Bands) -> tuple[float, int, int, float, bool]:
    """(whole ratio of the UTF-8 text, chunks, chunks outside a band, symbol share, accepted).

    Limits and chunks are of the text with a byte a letter.
    """
    if not data:
        return 0.0, 0, 0, 1.0, False
    encoded = whole = ratio(data, bands.level)
    data, bounded = one_byte_letters(given := data)
    if data is not given:
        whole = ratio(data, bands.level)

    def inside(part: bytes, own: float) -> bool:
        low, high = bands.limits(len(part))
        return (low if bounded else 0.0) <= own <= high and symbol_share(part, bands.level) <= bands.symbols

    accepted = inside(data, whole)
    # The tail joins the last full chunk, so that no chunk is too short to tell.
    cuts = list(range(0, max(len(data) // bands.chunk, 1) * bands.chunk, bands.chunk))
    chunks = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
    outside = (int(not accepted) if len(chunks) == 1 else
               sum(not inside(part, ratio(part, bands.level)) for part in chunks))
    return (encoded, len(chunks), outside, symbol_share(data, bands.level),
            accepted and outside <= bands.bad_chunks * len(chunks))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows are compared exactly: ranks of words become ranks of pairs of
    neighbours, of fours and so on, which take memory in proportion to the text.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = rank[:-step] * len(words) + rank[step:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span += step
    starts = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, n_chunks long, n_chunks_outside long, symbol_share double, kept boolean")


def quality(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of the rules' figures and the verdict ``kept`` for a text column."""
    @F.pandas_udf(f"struct<{FIELDS}>")
    def rules(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            data = (text or "").encode()
            words = data.split()
            repeats = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
            whole, chunks, outside, symbols, accepted = judge(data, bands)
            rows.append((len(words), len(data.translate(None, BLANK).decode()),
                         len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(data), repeats,
                         failed, whole, chunks, outside, symbols, accepted and not failed))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return rules(text)


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        bands: Bands = Bands()) -> DataFrame:
    """One row per document: its figures, base_failed, the ratios and kept.

    ``kept`` is the verdict of the bands for documents that pass the base rules. A null
    text has no words and is not kept, like an empty one. Rows are judged alone, so ties,
    repeated rows and other columns have no effect; an empty table gives no rows. Long
    texts are compressed whole and chunk by chunk; a text has to fit into a task.
    """
    return docs.select(F.col(id_col), quality(text_of(text_col), bands).alias("rules")).select(id_col, "rules.*")


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty."""
    return docs.filter(quality(text_of(text_col), bands)["kept"])
