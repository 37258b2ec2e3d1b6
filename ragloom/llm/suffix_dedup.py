"""Removing byte strings that an earlier document holds too, by sorted sampled suffixes.

The difference-cover scheme: sort the suffixes at sampled places by triples of
symbols, recurse on the names of the triples, merge the remaining suffixes by
the bytes up to the next sampled place and its rank, compare neighbours.

*The cover.* Any two equal strings of ``length`` bytes have to hold a sampled place
at the same distance from their start. Two residues mod three do that with two
places in three; here the text decides: the place with the least hash of its
next 24 bytes among those inside the string. Equal strings choose alike, and one
place in fifteen is sampled. (Residue classes were given up for their volume:
two thirds of all places times several sorts are many times the input.)

*Triples* are three 8-byte symbols. Suffixes of equal triples are dealt to one task
and named; the names with the next triple are named again, and once more with the
rest of ``length``. Every suffix between two samples is the bytes in front of a
sample and that sample's rank: two are equal exactly if both their neighbours'
common prefixes reach far enough.

*Only what can match is sorted.* A triple that one text alone holds has no match:
hashes of the samples of all texts are counted first (4 bytes each, in buckets
whose number grows with the input). The stretches left are cut where the text
says so and equal pieces are sorted once, under the smallest document.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

TRIPLE = 24
_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)
_PRIME, _FACTOR = 2147483647, 48271
FILTER_BITS = 1 << 24
_BLOCK = 1 << 15


@dataclass(frozen=True)
class Settings:
    """``length`` bytes make a match. ``bucket_bytes``: text whose samples one bucket
    counts. ``slice_bytes``: text hashed at once. ``cut``: one sample in so many ends a
    piece. ``hot``: a triple in more texts is compared string by string."""
    length: int = 50
    bucket_bytes: int = 32 << 20
    slice_bytes: int = 2 << 20
    cut: int = 8
    hot: int = 65536

    @property
    def reach(self) -> int:
        """Sampled places are up to so many bytes after the start of a string."""
        return self.length - TRIPLE


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIPLE bytes at every place, by doubling: 1, 2, 4, 8, 16, 24 bytes."""
    h, size = data.astype(np.uint64) * _M, 1
    while size < TRIPLE:
        step = min(size, TRIPLE - size)
        h = h[:-step] * _C + (h[step:] ^ (h[step:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= _M
        size += step
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def _least_at(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, the first of equals, of every ``width`` neighbours."""
    at, size = np.arange(len(h), dtype=np.int64), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        size += step
    return at


def _slices(texts: list[bytes], s: Settings):
    """(row, offset in its text, start, data) of texts put together; long texts in
    slices that overlap, so that every string of ``length`` bytes is in one."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if len(text) < s.length:
            continue
        for at in range(0, len(text) - s.length + 1, s.slice_bytes):
            part = text[at:at + s.slice_bytes + s.length - 1]
            if size and size + len(part) > s.slice_bytes:
                yield _joined(rows, offsets, parts)
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield _joined(rows, offsets, parts)


def _joined(rows, offsets, parts):
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.array(rows), np.array(offsets), np.cumsum(sizes) - sizes, b"".join(parts)


def _stretches(value: np.ndarray, starts: np.ndarray, total: int, s: Settings):
    """Runs of window starts of one text with equal ``value``: (part, from, to)."""
    part = np.repeat(np.arange(len(starts)), np.diff(starts, append=total))
    n = total - s.length + 1
    inside = part[:n] == part[s.length - 1:]
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = inside[1:] & inside[:-1] & (value[1:] == value[:-1])
    first = np.flatnonzero(inside & ~same[:n])
    last = np.flatnonzero(inside & ~same[1:])
    return part[first], first, last + 1


def _sampled(rows, starts, data: bytes, s: Settings):
    """(text, from, to, sample hash) of every stretch of windows with one sample hash."""
    text = np.frombuffer(data, np.uint8)
    least = np.empty(len(text) - s.length + 1, np.uint64)
    for at in range(0, len(least), _BLOCK):  # blocks stay in the processor's cache
        block = text[at:at + _BLOCK + s.length - 1]
        least[at:at + _BLOCK] = _least(_hashes(block), s.reach + 1)
    part, first, last = _stretches(least, starts, len(data), s)
    return part, first, last, _mixed(least[first])


def _deal(ids: np.ndarray, parts: int) -> np.ndarray:
    return ids % _PRIME * _FACTOR % _PRIME % parts


def _dealt(id_col: Column, parts: int) -> Column:
    return F.pmod(F.pmod(F.pmod(id_col, F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME)), F.lit(parts))


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.cast(column, pa.binary()).to_pylist()


def _runs(values: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else \
        np.zeros(1, np.int64)


_COUNTED = "part long, low binary, ids binary, multi binary, counts binary"


def _count_samples(parts: int, s: Settings):
    """Sample hashes by bucket: those of one text with its id, those of more with their
    number; the texts of the latter get their answer (part >= parts) at once."""
    def count(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            out = []
            for rows, _, starts, data in _slices(_bytes(batch.column("text")), s):
                part, _, _, key = _sampled(rows, starts, data, s)
                row = rows[part]
                bucket = (key >> np.uint64(32)) % np.uint64(parts)
                key = (bucket << np.uint64(32)) | (key & _LOW)
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, row = key[new], row[new]
                edge = _runs(key)
                times = np.diff(edge)
                one = np.repeat(times == 1, times)
                heads = edge[:-1]
                single, several = key[one], key[heads[times > 1]]
                owner, many = ids[row[one]], times[times > 1].astype(np.uint32)
                for b in np.unique(key >> np.uint64(32)):
                    lo, hi = b << np.uint64(32), (b + np.uint64(1)) << np.uint64(32)
                    i, j = np.searchsorted(single, [lo, hi])
                    k, m = np.searchsorted(several, [lo, hi])
                    # Ids in the order of their texts differ little, which compresses.
                    turn = np.argsort(owner[i:j], kind="stable")
                    out.append((int(b), single[i:j][turn].astype(np.uint32).tobytes(),
                                np.diff(owner[i:j][turn], prepend=0).tobytes(),
                                several[k:m].astype(np.uint32).tobytes(), many[k:m].tobytes()))
                out += _answers(ids[row[~one]], key[~one], parts)
            yield _packed(out)
    return count


def _answers(ids: np.ndarray, keys: np.ndarray, parts: int) -> list[tuple]:
    """Rows that tell texts which of their samples are shared."""
    dealt = _deal(ids, parts)
    order = np.lexsort((ids, dealt))
    dealt, ids, keys = dealt[order], ids[order], keys[order]
    edge = _runs(dealt)
    return [(parts + int(dealt[i]), _halves(keys[i:j]), np.diff(ids[i:j], prepend=0).tobytes(), b"", b"")
            for i, j in zip(edge[:-1], edge[1:])]


def _halves(keys: np.ndarray) -> bytes:
    """Low halves, then high ones: the latter (buckets) compress."""
    return keys.astype(np.uint32).tobytes() + (keys >> np.uint64(32)).astype(np.uint32).tobytes()


def _whole_keys(blob: bytes) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint32).reshape(2, -1).astype(np.uint64)
    return high << np.uint64(32) | low


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())] + [
        pa.array(c, pa.binary()) for c in columns[1:]], ["part", "low", "ids", "multi", "counts"])


def _share_samples(parts: int, hot: int):
    """Per bucket: the texts of samples that occur twice, and samples in over ``hot`` texts."""
    def bucket(number: int, held: list[tuple]):
        single = np.concatenate([np.frombuffer(h[1], np.uint32) for h in held])
        owner = np.concatenate([np.cumsum(np.frombuffer(h[2], np.int64)) for h in held])
        several = np.concatenate([np.frombuffer(h[3], np.uint32) for h in held])
        counts = np.concatenate([np.frombuffer(h[4], np.uint32) for h in held]).astype(np.int64)
        values, inverse = np.unique(np.concatenate([single, several]), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([np.ones(len(single)), counts]), len(values))
        shared = times[inverse[:len(single)]] > 1
        top = np.uint64(number << 32)
        rows = _answers(owner[shared], single[shared].astype(np.uint64) | top, parts)
        if (times > hot).any():
            rows.append((-1, (values[times > hot].astype(np.uint64) | top).tobytes(), b"", b"", b""))
        return rows

    def share(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] >= parts:
                    out.append(row)
                    continue
                if row[0] != now and held:
                    out += bucket(now, held)
                    held = []
                now = row[0]
                held.append(row)
            yield _packed(out)
        if held:
            yield _packed(bucket(now, held))
    return share


_PIECES = "n0 long, n1 long, piece binary, id long, h long, at long, size int"


def _cut_pieces(parts: int, s: Settings):
    """Stretches of texts whose samples are shared, cut into pieces by their content."""
    def pieces(ids, hs, texts, known):
        out: list[tuple] = []
        for rows, offsets, starts, data in _slices(texts, s):
            part, first, last, key = _sampled(rows, starts, data, s)
            bucket = (key >> np.uint64(32)) % np.uint64(parts)
            key = (bucket << np.uint64(32)) | (key & _LOW)
            row = rows[part]
            own = _mixed(ids[row].astype(np.uint64)) ^ key
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            some = known[place] == own
            head = some.copy()
            head[1:] &= ~some[:-1] | (part[1:] != part[:-1]) | (key[1:] % np.uint64(s.cut) == 0)
            tail = some.copy()
            tail[:-1] &= ~some[1:] | head[1:]
            for r, p, i, j in zip(row[head].tolist(), part[head].tolist(), first[head].tolist(), last[tail].tolist()):
                piece = data[i:j + s.length - 1]
                out.append((*_name(piece), piece, int(ids[r]), int(hs[r]), int(offsets[p] + i - starts[p]), j - i))
        return out

    def cut(batches):
        for kind, blobs, known in _dealt_rows(batches):
            if kind == 0:
                known.setdefault("new", []).append(blobs[:2])
                continue
            if "new" in known:
                known["keys"] = np.unique(np.concatenate([
                    _mixed(np.cumsum(np.frombuffer(i, np.int64)).astype(np.uint64)) ^ _whole_keys(k)
                    for k, i in known.pop("new")]))
            if len(known.get("keys", ())):
                ids, hs, texts = _unpacked(blobs)
                found = pieces(ids, hs, texts, known["keys"])
                if found:
                    yield _records(found, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
                                           pa.int32()), ("n0", "n1", "piece", "id", "h", "at", "size"))
    return cut


_DEALT = "part long, kind int, a binary, b binary, c binary, d binary"


def _dealt_rows(batches):
    """(kind, blobs, memory) of rows sorted by part and kind; the memory is one part's."""
    now, memory = None, {}
    for batch in batches:
        for part, kind, *blobs in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if part != now:
                now, memory = part, {}
            yield kind, blobs, memory


def _pack_texts(parts: int):
    """Rows (id, h, text) dealt by id, compressed together."""
    def pack(batches):
        for batch in batches:
            ids, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h"))
            texts = _bytes(batch.column("text"))
            dealt = _deal(ids, parts)
            rows = []
            for p in np.unique(dealt).tolist():
                here = np.flatnonzero(dealt == p)
                own = [texts[i] for i in here]
                rows.append((p, 1, zstandard.compress(b"".join(own), 3), ids[here].tobytes(), hs[here].tobytes(),
                             np.array([len(x) for x in own], np.int64).tobytes()))
            if rows:
                yield _dealt_batch(rows)
    return pack


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _records(rows, (pa.int64(), pa.int32(), *[pa.binary()] * 4), ("part", "kind", "a", "b", "c", "d"))


def _unpacked(blobs) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = zstandard.decompress(blobs[0])
    ids, hs, sizes = (np.frombuffer(b, np.int64) for b in blobs[1:])
    ends = np.cumsum(sizes).tolist()
    return ids, hs, [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _name(piece: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(piece, digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _records(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def _suffix_type(s: Settings) -> np.dtype:
    """A sampled suffix: what follows, what stands before (backwards), the distances of the
    strings that chose it, the place in its piece, the piece and its smallest document. Within
    that document 64 bits of the piece's name tell it from others."""
    return np.dtype([("right", np.uint8, (s.length,)), ("left", np.uint8, (s.reach,)), ("lo", np.uint8),
                     ("hi", np.uint8), ("at", np.int32), ("n0", np.int64), ("first", np.int64)])


def _sample_pieces(batch, s: Settings):
    """(hash, sampled suffix records) of distinct pieces, slice by slice."""
    n0, first_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n0", "first"))
    for rows, offsets, starts, data in _slices(batch.column("piece").to_pylist(), s):
        h = _hashes(np.frombuffer(data, np.uint8))
        place = _least_at(h, s.reach + 1)
        part, first, last = _stretches(place, starts, len(data), s)
        at = place[first]
        found = np.zeros(len(at), _suffix_type(s))
        padded = np.frombuffer(bytes(s.reach) + data + bytes(s.length), np.uint8)
        found["right"] = padded[(at + s.reach)[:, None] + np.arange(s.length)]
        found["left"] = padded[(at + s.reach - 1)[:, None] - np.arange(s.reach)]
        found["lo"], found["hi"] = at - last + 1, at - first
        # What no string of the record reaches says nothing and compresses best as zeros.
        found["right"][np.arange(s.length) >= s.length - found["lo"][:, None].astype(np.int64)] = 0
        found["left"][np.arange(s.reach) >= found["hi"][:, None]] = 0
        found["at"] = offsets[part] + first - starts[part]
        row = rows[part]
        found["n0"], found["first"] = n0[row], first_id[row]
        yield _mixed(h[at]), found


def _suffixes(hot: np.ndarray, parts: int, s: Settings):
    def emit(batches):
        for batch in batches:
            for key, found in _sample_pieces(batch, s):
                cold = ~_is_hot(key, hot, parts)
                key, found = key[cold], found[cold]
                size = found.dtype.itemsize
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint32).view(np.int32)), pa.Array.from_buffers(
                    pa.binary(), len(found), [None, pa.py_buffer(np.arange(0, size * len(found) + 1, size, np.int32)),
                                              pa.py_buffer(found.tobytes())])], ["key", "suffix"])
    return emit


def _is_hot(key: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    bucket = (key >> np.uint64(32)) % np.uint64(parts)
    return np.isin((bucket << np.uint64(32)) | (key & _LOW), hot)


def _hot_strings(hot: np.ndarray, parts: int, s: Settings):
    """The strings of hot triples one by one, to be grouped by Spark with partial minima."""
    def emit(batches):
        for batch in batches:
            for key, found in _sample_pieces(batch, s):
                out = []
                for f in found[_is_hot(key, hot, parts)]:
                    context = f["left"][::-1].tobytes() + f["right"].tobytes()
                    out += [(context[s.reach - d:s.reach - d + s.length], int(f["n0"]),
                             int(f["at"]) + int(f["hi"]) - d, int(f["first"]))
                            for d in range(int(f["lo"]), int(f["hi"]) + 1)]
                if out:
                    yield _records(out, (pa.binary(), pa.int64(), pa.int32(), pa.int64()),
                                   ("string", "n0", "at", "first"))
    return emit


def _symbols(matrix: np.ndarray) -> list[np.ndarray]:
    """Columns of 8 bytes as numbers in byte order."""
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    wide[:, :matrix.shape[1]] = matrix
    return list(wide.view(">u8").T.astype(np.uint64))


def _ranks(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and the common prefix of each with the one before.

    Triples of symbols are sorted and named, the names sorted with the next triple.
    """
    symbols = _symbols(matrix)
    name = np.zeros(len(matrix), np.int64)
    for i in range(0, len(symbols), 3):
        keys = symbols[i:i + 3]
        order = np.lexsort((*keys[::-1], name))
        new = np.zeros(len(order), dtype=np.int64)
        for column in (name, *keys):
            sorted_ = column[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        name[order] = np.cumsum(new)
    order = np.argsort(name, kind="stable")
    common = np.zeros(len(order), np.int64)
    differs = matrix[order[1:]] != matrix[order[:-1]]
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), matrix.shape[1])
    return order, common


def _earlier(found: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(record, distance, smallest document) of the strings that a smaller document holds."""
    right, right_common = _ranks(found["right"])
    left, left_common = _ranks(found["left"])
    records, distances, sources = [], [], []
    for d in range(s.reach + 1):
        here = np.flatnonzero((found["lo"] <= d) & (found["hi"] >= d))
        if len(here) < 2:
            continue
        # Merge: suffixes d bytes before a sample are equal if the bytes before it and
        # its first length - d bytes are; both are runs of neighbours in rank order.
        behind, before = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        behind[right] = np.cumsum(right_common < s.length - d)
        before[left] = np.cumsum(left_common < d)
        name = (behind[here] << 32) | before[here]
        order = np.lexsort((found["first"][here], name))
        edge = _runs(name[order])
        least = np.repeat(found["first"][here[order[edge[:-1]]]], np.diff(edge))
        hit = least < found["first"][here[order]]
        records.append(here[order[hit]])
        distances.append(np.full(int(hit.sum()), d))
        sources.append(least[hit])
    if not records:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(records), np.concatenate(distances), np.concatenate(sources)


def _compare(s: Settings, at_once: int = 100_000):
    """Pieces' strings that a smaller document holds, as spans of their starts."""
    kind = _suffix_type(s)

    def matched(found: np.ndarray) -> pa.RecordBatch:
        record, distance, _ = _earlier(found, s)
        start = found["at"][record] + found["hi"][record] - distance
        order = np.lexsort((start, record))
        record, start = record[order], start[order]
        new = np.ones(len(record), dtype=bool)
        new[1:] = (record[1:] != record[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(head, append=len(record))
        own = found[record[head]]
        return pa.RecordBatch.from_arrays([
            pa.array(own["n0"]), pa.array(own["first"]), pa.array(start[head].astype(np.int64)),
            pa.array(size.astype(np.int32))], ["n0", "id", "start", "n"])

    def compare(batches):
        keys, held, count = [], [], 0
        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            held.append(np.frombuffer(b"".join(batch.column("suffix").to_pylist()), kind))
            count += len(batch)
            if count >= at_once:
                key, found = np.concatenate(keys), np.concatenate(held)
                whole = int(np.searchsorted(key, key[-1]))  # the last triple may go on
                if whole:
                    yield matched(found[:whole])
                keys, held, count = [key[whole:]], [found[whole:]], len(key) - whole
        if count:
            yield matched(np.concatenate(held))
    return compare


def _pack_spans(parts: int):
    def pack(batches):
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "h", "start", "n")]
            dealt = _deal(columns[0], parts)
            order = np.lexsort((columns[2], columns[0], dealt))
            dealt, columns = dealt[order], [c[order] for c in columns]
            edge = _runs(dealt)
            rows = [(int(dealt[i]), 0, *(c[i:j].tobytes() for c in columns)) for i, j in zip(edge[:-1], edge[1:])]
            if rows:
                yield _dealt_batch(rows)
    return pack


_REMOVED = "id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"


def _remove(s: Settings):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        for sort, blobs, known in _dealt_rows(batches):
            if sort == 0:
                known.setdefault("new", []).append([np.frombuffer(b, np.int64) for b in blobs])
                continue
            if "new" in known:
                spans = [np.concatenate(c) for c in zip(*known.pop("new"))]
                order = np.lexsort((spans[2], spans[1], spans[0]))
                known["spans"] = [c[order] for c in spans]
                edge = _runs_of_two(*known["spans"][:2])
                names = zip(*(c[edge[:-1]].tolist() for c in known["spans"][:2]))
                known["where"] = dict(zip(names, zip(edge[:-1].tolist(), edge[1:].tolist())))
            out = []
            for i, h, data in zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in _unpacked(blobs))):
                a, b = known.get("where", {}).get((i, h), (0, 0))
                merged: list[list[int]] = []
                if a < b:
                    for start, n in zip(known["spans"][2][a:b].tolist(), known["spans"][3][a:b].tolist()):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(start + n + s.length - 1, merged[-1][1])
                        else:
                            merged.append([start, start + n + s.length - 1])
                edge = [0, *(x for ab in merged for x in ab), len(data)]
                out.append((i, len(data), [{"start": a, "end": b} for a, b in merged],
                            b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2]))))
            yield _records(out, (pa.int64(), pa.int64(), kind, pa.binary()), ("id", "n_bytes", "removed", "kept"))
    return remove


def _runs_of_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal pairs."""
    return np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(x)]])


def _marked(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``may``: whether a row (id, h) may have spans. A broadcast bit table of FILTER_BITS
    bits (at most 4 MB) tells, so texts without any stay where they are."""
    bit = F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS))
    words = (spans.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("mask")))
    tested = rows.withColumn("bit", bit).join(F.broadcast(words), F.shiftright("bit", 6) == F.col("word"), "left")
    may = F.coalesce(F.expr("(shiftrightunsigned(mask, cast(bit % 64 AS int)) & 1L) = 1"), F.lit(False))
    return tested.withColumn("may", may & F.col("id").isNotNull()).drop("bit", "word", "mask")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _parts(texts: DataFrame, s: Settings) -> tuple[int, int]:
    """Number of buckets and bytes of all texts."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-total // s.bucket_bytes)), total


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   settings: Settings = Settings()) -> DataFrame:
    """(id, h, start, n): strings of ``length`` bytes that start in a text with a smaller id
    too start at n places of this text from start.

    ``h`` is the xxhash64 of the text: rows that share an id but not the text are
    told apart. Rows without an id take no part, nor do texts shorter than ``length``.
    """
    from ragloom.session import scratch_path
    s, spark = settings, docs.sparkSession
    source = _texts(docs, id_col, text_col).filter(F.col("id").isNotNull()).filter(F.octet_length("text") >= s.length)
    parts, total = _parts(source, s)
    # Of n samples at most n / hot are hot, so their list has a bound.
    hot_from = max(s.hot, total // 15 >> 20)
    folder = scratch_path(spark, f"suffixes-{uuid.uuid4().hex}")

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    own = F.pmod(F.col("part"), F.lit(parts)).cast("int")
    shared = staged(source.select("id", "text").mapInArrow(_count_samples(parts, s), _COUNTED).repartitionById(parts, own)
                    .sortWithinPartitions("part").mapInArrow(_share_samples(parts, hot_from), _COUNTED), "shared")
    lists = [np.frombuffer(r["low"], np.uint64) for r in shared.filter("part = -1").select("low").toLocalIterator()]
    hot = np.concatenate([np.empty(0, np.uint64), *lists])
    none = F.lit(b"")
    answers = shared.filter(F.col("part") >= parts).select(
        (F.col("part") - parts).alias("part"), F.lit(0).alias("kind"), F.col("low").alias("a"), F.col("ids").alias("b"),
        none.alias("c"), none.alias("d"))
    pieces = staged(answers.unionByName(source.mapInArrow(_pack_texts(parts), _DEALT)).repartitionById(parts, own)
                    .sortWithinPartitions("part", "kind").mapInArrow(_cut_pieces(parts, s), _PIECES), "pieces")
    distinct = pieces.groupBy("n0", "n1", "piece").agg(F.min("id").alias("first"))
    spans = (distinct.mapInArrow(_suffixes(hot, parts, s), "key int, suffix binary").repartition("key")
             .sortWithinPartitions("key").mapInArrow(_compare(s), "n0 long, id long, start long, n int"))
    if len(hot):
        strings = distinct.mapInArrow(_hot_strings(hot, parts, s), "string binary, n0 long, at int, first long")
        least = strings.groupBy("string").agg(F.min("first").alias("source"))
        spans = spans.unionByName(strings.join(least, "string").filter("source < first").select(
            "n0", F.col("first").alias("id"), F.col("at").cast("long").alias("start"), F.lit(1).alias("n")))
    places = pieces.select("n0", "n1", "id", "h", "at", "size")
    # A piece goes as a whole where a smaller document holds all of it.
    whole = places.join(places.groupBy("n0", "n1").agg(F.min("id").alias("first")), ["n0", "n1"]).filter(
        "first < id").select("id", "h", F.col("at").alias("start"), F.col("size").alias("n"))
    inner = places.join(spans, ["n0", "id"]).select("id", "h", (F.col("at") + F.col("start")).alias("start"), "n")
    return staged(whole.unionByName(inner), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   settings: Settings = Settings()) -> DataFrame:
    """The id, n_bytes, ``removed`` (array of start, end in bytes of UTF-8, maximal, in
    order) and ``kept`` (the remaining bytes) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller id; strings are those of the input. Null texts are
    empty. Rows without an id neither lose bytes nor are looked at; rows with one id
    do not count as earlier than each other, so repeated rows lose the same bytes.
    Ids have to be integers. Other columns are not looked at; an empty table gives no
    rows. Long texts are hashed slice by slice; a text and its spans have to fit
    into a task.
    """
    s = settings
    spans = repeated_spans(docs, id_col, text_col, s)
    rows = _texts(docs, id_col, text_col)
    parts, _ = _parts(rows, s)
    tested = _marked(rows, spans)
    own = F.col("part").cast("int")
    lost = (spans.mapInArrow(_pack_spans(parts), _DEALT)
            .unionByName(tested.filter("may").drop("may").mapInArrow(_pack_texts(parts), _DEALT))
            .repartitionById(parts, own).sortWithinPartitions("part", "kind").mapInArrow(_remove(s), _REMOVED))
    whole = tested.filter("not may").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.encode("text", "UTF-8").alias("kept"))
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType
    return lost.unionByName(whole).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
