"""Scoring a batch of queries against a large chunk table, exactly, without
a pair table (J1, and the retrieval cores of R1/R2/R4/R5, V4, V7 and E17).

Queries are packed into blocks (Arrow, measured in bytes). What fits one block
(``block_bytes``) is broadcast: the chunk table is scanned once, column-pruned, and
neither shuffled nor joined. A task scores its Arrow batches with numpy (cache-sized
slices) and emits, per query, only the rows that pass the filter and can still be
in that query's top-k -- every tie at the k-th score is kept, so the final cut is exact.

A larger query table never passes through the driver. For a top-k (``dealt_topk``) it is
dealt into groups of ``group_bytes``, and every group is streamed the whole chunk table, in
as many parts as keep the cores busy: a task holds its queries and the k best rows of each
so far, so what it holds and emits follows from its queries alone, whatever the number of chunks, matches or ties. Ties are settled there by the chunk's
place in the tie order. Without a k (``scan``) chunk batches are packed and dealt
into groups of ``group_bytes``, every group is sent all query blocks, and a task holds
its group and one block at a time.

One ``row_number() <= k`` window per query finishes the job; Spark plans a
partial ``WindowGroupLimit`` before that shuffle.

Scores are rounded to ``digits`` decimals (1e-9) before ranking so equal
inputs tie exactly whatever the summation order; ties go to the caller's
tie columns.
"""

from __future__ import annotations

import uuid
from itertools import chain, groupby
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_BYTES = 1024 * 1024            # payload bytes per query block
DEFAULT_GROUP_BYTES = 16 * 1024 * 1024       # bytes a task holds: of chunks beside a block, or of queries
CARRIED_BYTES = 256 * 1024                   # chunk rows that go to a group of queries as one
SLICE_CELLS = 1_000_000                      # score cells per numpy slice
SCREEN_CELLS = 4_000_000                     # cells of a screened slice, in single precision
EMIT_ROWS = 1_000_000                        # found rows a task gathers before it emits them
UNBOUNDED = 1 << 62

_PACKED = "number long, n long, bytes long, width long, blob binary"


def packed(df: DataFrame, limit: int) -> DataFrame:
    """Rows of ``df`` as Arrow blobs of at most ``limit`` bytes (or one row), numbered;
    ``width`` is the length of the longest array of a blob."""
    def pack(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            step = max(1, int(len(batch) * limit / max(batch.nbytes, 1)))
            for a in range(0, len(batch), step):
                part = batch.slice(a, min(step, len(batch) - a))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                width = max([pc.max(pc.list_value_length(c)).as_py() or 0 for c in part.columns
                             if pa.types.is_list(c.type)] or [0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([len(part)]), pa.array([part.nbytes]), pa.array([width]),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    ["number", "n", "bytes", "width", "blob"])
                number += 1
    return df.mapInArrow(pack, _PACKED)


def unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def query_blocks(queries: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """The queries packed (computed once), their bytes and their longest array."""
    blocks = packed(queries, block_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    size = blocks.agg(F.sum("bytes").alias("bytes"), F.max("width").alias("width")).first()
    return blocks, int(size["bytes"] or 0), int(size["width"] or 0)


def scan(chunks: DataFrame, queries: DataFrame, payload: Callable[[pd.DataFrame, int], object],
         per_block: Callable[[Iterable[pd.DataFrame], object], Iterator[pd.DataFrame]], schema: T.StructType,
         pruned: Callable[[object], Column] | None = None, block_bytes: int = DEFAULT_BLOCK_BYTES,
         group_bytes: int = DEFAULT_GROUP_BYTES, ready_blocks: tuple | None = None) -> DataFrame:
    """Every batch of ``chunks`` against every query, block by block.

    ``payload(queries, width)`` prepares a block (``width``: the longest array of all
    queries), ``per_block(batches, payload)`` yields rows of ``schema``. ``pruned``
    may turn the payload of a broadcast block into a filter of the chunk table. The
    queries are computed once; two small numbers of them are fetched to choose the way.
    """
    spark = chunks.sparkSession
    blocks, total, width = ready_blocks or query_blocks(queries, block_bytes)
    if total <= block_bytes:
        rows = [unpacked(r["blob"]) for r in blocks.orderBy("number").select("blob").collect()]
        blocks.unpersist()
        if not rows:
            return spark.createDataFrame([], schema)
        ready = payload(pd.concat(rows, ignore_index=True), width)
        held = spark.sparkContext.broadcast(ready)
        src = chunks if pruned is None else chunks.where(pruned(ready))
        return src.mapInPandas(lambda batches: per_block(batches, held.value), schema)

    from ..session import scratch_path
    folder = scratch_path(spark, f"dealt-{uuid.uuid4().hex}")
    blocks.write.parquet(f"{folder}/blocks")
    blocks.unpersist()
    packed(chunks, min(group_bytes, 8 << 20)).write.parquet(f"{folder}/chunks")
    blocks, batches_ = (spark.read.parquet(f"{folder}/{x}") for x in ("blocks", "chunks"))
    groups = max(1, -(-int(batches_.agg(F.sum("bytes")).first()[0] or 0) // group_bytes))
    own = batches_.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("g"),
                          F.lit(0).alias("kind"), "blob")
    everywhere = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
                               F.lit(1).alias("kind"), "blob")
    dealt = own.unionByName(everywhere).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind")

    def run(batches):
        now, held = None, []
        for pdf in batches:
            for g, kind, blob in zip(pdf["g"], pdf["kind"], pdf["blob"]):
                if g != now:
                    now, held = g, []
                if kind == 0:
                    held.append(unpacked(blob))
                else:
                    yield from per_block(held, payload(unpacked(blob), width))
    return dealt.mapInPandas(run, schema)


def vector_matrix(values, dim: int) -> np.ndarray:
    """Rows -> L2-normalised float64 matrix; NULL, wrong-length, zero and
    non-finite vectors become zero rows (their cosine with anything is 0)."""
    m = np.zeros((len(values), dim), dtype=np.float64)
    for i, v in enumerate(values):
        if v is not None and len(v) == dim:
            m[i] = v
    m[~np.isfinite(m).all(axis=1)] = 0
    nrm = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = nrm > 0
    m[ok] /= nrm[ok][:, None]
    return m


def pair_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``."""
    out = np.empty(len(i))
    for x in range(0, len(i), 50_000):
        out[x:x + 50_000] = np.einsum("ij,ij->i", a[i[x:x + 50_000]], b[j[x:x + 50_000]])
    return out


class Screen:
    """Tells which (row, query) entries of a product can reach the queries' floors.

    The product is taken in single precision, with what a row is worth besides and the floor
    as two more columns. Floors are lowered by a bound of the rounding error, so no
    entry at or above its floor is missed; those found have to be computed exactly."""

    def __init__(self, queries: np.ndarray):
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.held = np.ones((len(queries), queries.shape[1] + 2), dtype=np.float32)
        self.held[:, :-2] = queries

    def hits(self, rows: np.ndarray, worth, floor: np.ndarray, part: float = 0.25,
             reach: np.ndarray | None = None, further: Callable | None = None):
        """(row, query) where product + worth >= floor, in row order; None if they are more than
        ``part`` of all entries. ``reach``: the largest sum of absolute terms that matters for a
        query (default by the norms); ``further(matrix, first, last)`` adds to rows of the product."""
        worth = np.broadcast_to(np.asarray(worth, dtype=np.float64), len(rows))
        if len(rows) == 0 or len(self.held) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not np.abs(worth).max() < 1e6:
            return None
        most = np.sqrt(np.einsum("ij,ij->i", rows, rows).max()) * self.norms + np.abs(worth).max()
        floor = np.clip(floor, -2 * most - 1, 2 * most + 1) if reach is None else floor
        reach = most + np.abs(floor) if reach is None else reach
        self.held[:, -1] = reach * (rows.shape[1] + 256) * 2.0 ** -23 - floor
        left = np.ones((len(rows), rows.shape[1] + 2), dtype=np.float32)
        left[:, :-2] = rows
        left[:, -2] = worth
        step, found, count = max(1, SCREEN_CELLS // len(self.held)), [], 0
        for a in range(0, len(rows), step):
            near = left[a:a + step] @ self.held.T
            if further:
                further(near, a, a + len(near))
            hit = np.flatnonzero(near >= 0)
            count += len(hit)
            if count > part * len(rows) * len(self.held):
                return None
            found.append(hit + a * len(self.held))
        return np.divmod(np.concatenate(found), len(self.held))


def equal_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal rows."""
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return first, np.diff(np.r_[first, len(rows)])


def run_hits(screen: Screen, rows: np.ndarray, upper: np.ndarray, factor: float, floor: np.ndarray, held: np.ndarray):
    """(row, query, product) of the entries where factor * product + upper can reach the floor;
    a stretch of equal rows is multiplied once. None if they are many."""
    first, size = equal_runs(rows)
    hit = screen.hits(factor * rows[first], np.maximum.reduceat(upper, first), floor)
    if hit is None:
        return None
    u, c = hit
    times = size[u]
    if times.sum() * 4 > len(rows) * len(held):
        return None
    r = np.repeat(first[u], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    product = np.repeat(pair_products(rows, first[u], held, c), times)
    return r, np.repeat(c, times), product


def vocab_index(term_lists) -> tuple[dict, np.ndarray, np.ndarray]:
    """Inverted index of query terms: vocab id -> the queries holding it.

    Returns (vocab, indptr, query_idx) in CSR form over distinct terms.
    """
    vocab: dict = {}
    pairs = []
    for qi, terms in enumerate(term_lists):
        for t in set(() if terms is None else terms):
            pairs.append((vocab.setdefault(t, len(vocab)), qi))
    pairs.sort()
    indptr = np.zeros(len(vocab) + 1, dtype=np.int64)
    qidx = np.array([p[1] for p in pairs], dtype=np.int64)
    if pairs:
        np.add.at(indptr, np.array([p[0] for p in pairs]) + 1, 1)
        indptr = np.cumsum(indptr)
    return vocab, indptr, qidx


EXPAND_CELLS = 1_000_000                     # (row, query) increments per numpy step


def expand_matches(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                   indptr: np.ndarray, qidx: np.ndarray, n: int, nq: int) -> np.ndarray:
    """Dense (n x nq) sum of ``weights`` over the (row, term) entries,
    spread to every query holding the term (a sparse product in numpy:
    flat ``bincount`` over pieces of at most EXPAND_CELLS increments, so
    memory stays bounded however common a term is)."""
    out = np.zeros(n * nq, dtype=np.float64)
    if len(rows) == 0:
        return out.reshape(n, nq)
    cnt = indptr[terms + 1] - indptr[terms]
    cum = np.cumsum(cnt)
    lo = 0
    while lo < len(rows):
        base = cum[lo - 1] if lo > 0 else 0
        hi = int(np.searchsorted(cum, base + EXPAND_CELLS, side="right"))
        hi = max(hi, lo + 1)
        c = cnt[lo:hi]
        rr = np.repeat(rows[lo:hi], c)
        ww = np.repeat(weights[lo:hi], c)
        starts = np.repeat(indptr[terms[lo:hi]], c)
        offs = np.arange(len(rr)) - np.repeat(np.cumsum(c) - c, c)
        qq = qidx[starts + offs]
        out += np.bincount(rr * nq + qq, weights=ww, minlength=n * nq)
        lo = hi
    return out.reshape(n, nq)


def scan_topk(chunks: DataFrame, queries: DataFrame, key_cols: Sequence[str], in_cols: Sequence[str],
              payload: Callable, scorer: Callable, out_cols: Sequence[tuple[str, T.DataType]],
              k: int | None = None, order: Sequence = (), pruned: Callable | None = None,
              block_bytes: int = DEFAULT_BLOCK_BYTES, group_bytes: int = DEFAULT_GROUP_BYTES,
              fold: bool = False, finder: Callable | None = None, near: Sequence[str] = ()) -> DataFrame:
    """Top-k (all passing rows without ``k``) of every query over ``chunks``.

    ``queries`` has ``query_id`` and what ``payload(queries, width)`` needs;
    ``scorer(pdf_slice, payload)`` returns ``(rank_matrix, keep_mask, {out_name: matrix})``
    of shape (rows x queries); rows above the k-th ``rank_matrix`` value per query
    (ties kept) that pass ``keep_mask`` are emitted with their key columns and the
    named output matrices. ``order`` starts with that value, descending. ``fold``: many
    rows may have the same ``in_cols``, which can be grouped by.
    ``finder(pdf_slice, payload, floor)`` may find the same entries for many queries with
    less work: ``(row, query, rank_value, {out_name: value})`` of the passing entries, of
    which those under a query's ``floor`` may be missing; None leaves the slice to ``scorer``.
    Rows go to it ordered by ``near``.
    """
    fields = {f.name: f for f in chunks.schema.fields}
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType)]
                          + [fields[c] for c in key_cols] + [T.StructField(n, t) for n, t in out_cols])
    keys, outs, most = list(key_cols), [n for n, _ in out_cols], k or UNBOUNDED

    def prepared(rows: pd.DataFrame, width: int):
        return rows["query_id"].to_numpy(dtype=object), payload(rows, width)

    def emitted(pdf, q_ids, rr, cc, vv, ex):
        r, c, v = np.concatenate(rr), np.concatenate(cc), np.concatenate(vv)
        sel = np.arange(len(r))
        if len(rr) > 1 and len(r):             # k-th best per query across the slices
            o = np.lexsort((-v, c))
            cs, vs = c[o], v[o]
            starts = np.r_[0, np.flatnonzero(np.diff(cs)) + 1]
            counts = np.diff(np.r_[starts, len(cs)])
            kth = vs[starts + np.minimum(counts, most) - 1]
            sel = o[vs >= np.repeat(kth, counts)]
        res = {"query_id": q_ids[c[sel]]}
        for kc in keys:
            res[kc] = pdf[kc].values[r[sel]]
        for name in outs:
            res[name] = np.concatenate(ex[name])[sel]
        return pd.DataFrame(res, columns=["query_id"] + keys + outs)

    def per_block(batches, ready):
        q_ids, pay = ready
        nq = len(q_ids)
        for pdf in batches:
            n = len(pdf)
            if n == 0 or nq == 0:
                continue
            step = max(1, SLICE_CELLS // max(nq, 1))
            rr, cc, vv, ex = [], [], [], {name: [] for name in outs}
            for r0 in range(0, n, step):
                rank, keep, extra = scorer(pdf.iloc[r0:r0 + step], pay)
                m = rank.shape[0]
                if m > most:                   # slice top-k per query, ties kept
                    masked = np.where(keep, rank, -np.inf)
                    kth = np.partition(masked, m - most, axis=0)[m - most]
                    keep = keep & (rank >= kth[None, :])
                r, c = np.nonzero(keep)
                rr.append(r + r0)
                cc.append(c)
                vv.append(rank[r, c])
                for name in outs:
                    ex[name].append(extra[name][r, c])
                if r0 + step >= n or sum(map(len, rr)) >= EMIT_ROWS:
                    found = emitted(pdf, q_ids, rr, cc, vv, ex)
                    rr, cc, vv, ex = [], [], [], {name: [] for name in outs}
                    if len(found):
                        yield found

    src = chunks.select(*dict.fromkeys(list(key_cols) + list(in_cols)))
    blocks, total, width = query_blocks(queries, block_bytes)
    if k and total > block_bytes:
        return finish_topk(dealt_topk(src, blocks, queries.schema, key_cols, in_cols, payload, scorer, out_cols, k,
                                      order, total, width, group_bytes, fold, finder, near), k, order)
    found = scan(src, queries, prepared, per_block, schema,
                 None if pruned is None else (lambda ready: pruned(ready[1])), block_bytes, group_bytes,
                 (blocks, total, width))
    return finish_topk(found, k, order) if k else found


def _best(q: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries of each query (score, then place) and their ranks from 0."""
    o = np.lexsort((place, -score, q))
    qs = q[o]
    starts = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]]) if len(qs) else np.zeros(0, np.int64)
    rank = np.arange(len(qs)) - np.repeat(starts, np.diff(np.r_[starts, len(qs)]))
    return o[rank < k], rank[rank < k]


class Best:
    """The k best rows so far of each of ``n`` queries: scores, places and further numbers."""

    def __init__(self, n: int, k: int, outs: Sequence[str]):
        self.k, self.outs = k, outs
        self.score = np.full((n, k), -np.inf)
        self.place = np.full((n, k), np.iinfo(np.int64).max)
        self.out = {name: np.zeros((n, k)) for name in outs}
        self.waiting: list = []
        self.count = 0

    def add(self, q, score, row, places, outs) -> None:
        """Entries of queries and chunk rows; ``places``: starts, sizes and values of the lists
        of ascending places that the chunk rows stand for."""
        if len(q) == 0:
            return
        start, size, flat = places
        sel, _ = _best(q, score, flat[start[row]], self.k)
        times = np.minimum(size[row[sel]], self.k)
        at = np.repeat(start[row[sel]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = flat[at]
        self.waiting.append((np.repeat(q[sel], times), np.repeat(score[sel], times), at,
                             {name: np.repeat(outs[name][sel], times) for name in self.outs}))
        self.count += len(at)
        if self.count >= max(len(self.score) * 4, 10_000):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        q, score, place = (np.concatenate([w[i] for w in self.waiting]) for i in range(3))
        out = {name: np.concatenate([w[3][name] for w in self.waiting]) for name in self.outs}
        self.waiting, self.count = [], 0
        hit = np.unique(q)
        q = np.r_[q, np.repeat(hit, self.k)]
        score = np.r_[score, self.score[hit].ravel()]
        place = np.r_[place, self.place[hit].ravel()]
        out = {name: np.r_[out[name], self.out[name][hit].ravel()] for name in self.outs}
        sel, rank = _best(q, score, place, self.k)
        self.score[q[sel], rank] = score[sel]
        self.place[q[sel], rank] = place[sel]
        for name in self.outs:
            self.out[name][q[sel], rank] = out[name][sel]

    def batches(self, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.settle()
        step = max(1, 100_000 // self.k)
        for a in range(0, len(self.score), step):
            q, r = np.nonzero(self.score[a:a + step] > -np.inf)
            q = q + a
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(q)).cast(schema.field(0).type), pa.array(self.place[q, r]),
                 *[pa.array(self.out[name][q, r]) for name in self.outs]], schema=schema)


def dealt_topk(chunks: DataFrame, blocks: DataFrame, asking: T.StructType, key_cols: Sequence[str], in_cols: Sequence[str],
               payload: Callable, scorer: Callable, out_cols: Sequence[tuple[str, T.DataType]], k: int,
               order: Sequence, total: int, width: int, group_bytes: int, fold: bool,
               finder: Callable | None = None, near: Sequence[str] = ()) -> DataFrame:
    """Each query row's k best rows of ``chunks`` (of each part of them), for many queries.

    The queries (``blocks`` of rows of the schema ``asking``, ``total`` bytes) are dealt into
    groups of about ``group_bytes``. The chunks are written once, in the order that settles
    ties, and numbered; each group reads the ``in_cols`` of them all, in parts if there are
    fewer groups than cores. With ``fold`` rows equal in these go as one, with
    the first k numbers: they score the same, so no others can be among a query's best.
    """
    from ..session import discard, scratch_path
    spark = chunks.sparkSession
    folder = scratch_path(spark, f"dealt-{uuid.uuid4().hex}")
    chunks.write.parquet(f"{folder}/staged/chunks")
    spark.read.schema(chunks.schema).parquet(f"{folder}/staged/chunks").orderBy(*order[1:]).withColumn(
        "_place", F.monotonically_increasing_id()).write.parquet(f"{folder}/chunks")
    discard(spark, f"{folder}/staged/chunks")
    placed = spark.read.parquet(f"{folder}/chunks")

    ins = list(in_cols)
    rows = placed.select(*ins, "_place")
    if fold:
        w = Window.partitionBy(*ins).orderBy("_place")
        rows = (rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
                .groupBy(*ins).agg(F.sort_array(F.collect_list("_place")).alias("_places")))
    else:
        rows = rows.select(*ins, F.array("_place").alias("_places"))
    if near:
        rows = rows.sortWithinPartitions(*near)

    outs = [n for n, _ in out_cols]
    schema = T.StructType([T.StructField("query_id", asking["query_id"].dataType),
                           T.StructField("_place", T.LongType())] + [T.StructField(n, t) for n, t in out_cols])

    def kept(held, parts, shape):
        ids, ready = held.column("query_id").combine_chunks(), payload(held.to_pandas(), width)
        best = Best(len(ids), k, outs)
        small = max(1, SLICE_CELLS // len(ids))
        step = max(1, SCREEN_CELLS // len(ids)) if finder else small

        def scored(part):
            floor = best.score[:, -1]
            rank, keep, extra = scorer(part, ready)
            r, c = np.nonzero(keep & (rank >= floor))
            return r, c, rank[r, c], {name: extra[name][r, c] for name in outs}
        for pdf in parts:
            size = np.array([len(x) for x in pdf["_places"]], dtype=np.int64)
            places = np.cumsum(size) - size, size, np.concatenate([*pdf["_places"], np.empty(0, np.int64)]).astype(np.int64)
            for r0 in range(0, len(pdf), step):
                part = pdf.iloc[r0:r0 + step]
                found = finder(part, ready, best.score[:, -1].copy()) if finder else None
                pieces = [(0, found)] if found is not None else (
                    (a, scored(part.iloc[a:a + small])) for a in range(0, len(part), small))
                for a, (r, c, rank, extra) in pieces:
                    best.add(c, rank, r + r0 + a, places, extra)
        yield from best.batches(ids, shape)

    return dealt(rows, blocks, asking, kept, schema, total, group_bytes, folder).join(
        placed.select("_place", *key_cols), "_place").select("query_id", *key_cols, *outs)


def dealt(rows: DataFrame, blocks: DataFrame, asking: T.StructType, per_group: Callable, schema: T.StructType,
          total: int, group_bytes: int, folder: str) -> DataFrame:
    """Every row of ``rows`` against every query, the queries held and the rows streamed.

    ``per_group(queries as an Arrow table, batches of rows as pandas, Arrow schema)`` yields
    Arrow batches of ``schema`` for a group of queries and a part of the rows. Rows travel
    packed, some 256 KiB as one."""
    spark = rows.sparkSession
    blocks.write.parquet(f"{folder}/blocks")
    blocks.unpersist()
    queries = spark.read.parquet(f"{folder}/blocks").select("blob").mapInArrow(
        lambda batches: (x for b in batches for blob in b.column(0) for x in pa.ipc.open_stream(blob.as_buffer())), asking)
    groups, cores = -(-total // group_bytes), spark.sparkContext.defaultParallelism
    parts = max(1, cores // groups)            # as many tasks as cores, or a multiple of that
    groups = max(groups, cores // parts) if groups <= cores else -(-groups // cores) * cores
    q_cols = asking.names

    def everywhere(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(everywhere(parts).alias("_part"), *q_cols).select(
        (F.pmod(F.xxhash64(*q_cols), F.lit(groups)).cast("int") * parts + F.col("_part")).alias("_g"),
        F.lit(0).alias("_kind"), *[F.col(c).alias(f"_q_{c}") for c in q_cols])
    packed(rows, CARRIED_BYTES).select("number", "blob").write.parquet(f"{folder}/rows")
    read = spark.read.parquet(f"{folder}/rows").select(everywhere(groups).alias("_group"), "number", "blob").select(
        (F.col("_group") * parts + F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")).alias("_g"),
        F.lit(1).alias("_kind"), F.col("blob").alias("_blob"))
    both = asked.unionByName(read, allowMissingColumns=True).repartitionById(groups * parts, F.col("_g")) \
                .sortWithinPartitions("_g", "_kind")

    def pieces(batches):
        for batch in batches:
            g, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_g", "_kind"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
                if a < z:
                    yield g[a], kind[a], pa.Table.from_batches([batch.slice(a, z - a)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        for _, group in groupby(pieces(batches), lambda x: x[0]):
            held, first = [], []
            for _, kind, part in group:
                if kind:
                    first.append(part)
                    break
                held.append(part.select([f"_q_{c}" for c in q_cols]).rename_columns(q_cols))
            if held:
                yield from per_group(pa.concat_tables(held), (
                    pa.ipc.open_stream(blob.as_buffer()).read_pandas()
                    for part in chain(first, (x[2] for x in group)) for blob in part.column("_blob")), shape)
    return both.mapInArrow(run, schema)


def finish_topk(cand: DataFrame, k: int, order_cols: Sequence) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order_cols)
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_vectors(queries: DataFrame, query_id: str, query_vec: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"))


def top_k_by_vector(chunks: DataFrame, queries: DataFrame, k: int = 5,
                    threshold: float = 0.3, strict: bool = True,
                    key_cols: Sequence[str] = ("chunk_id",), chunk_vec: str = "embedding",
                    query_id: str = "query_id", query_vec: str = "embedding",
                    tie_cols: Sequence[str] | None = None, digits: int = 9,
                    dim: int | None = None, secondary: str | None = None,
                    block_bytes: int = DEFAULT_BLOCK_BYTES, group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """Exact top-k chunks per query by cosine similarity (R1/R2 core).

    ``secondary`` names a chunk column used as the second sort key (e.g.
    quality); it is carried into the output. Vectors have to have ``dim`` numbers
    (default: as many as the longest query vector); others are like nothing. Returns
    (query_id, *key_cols, score[, secondary], rank).
    """
    def payload(rows, width):
        qm = vector_matrix(rows["qv"].values, dim or width)
        return qm, Screen(qm)

    def scorer(pdf, pay):
        qm, _ = pay
        s = np.round(vector_matrix(pdf["_v"].values, qm.shape[1]) @ qm.T, digits)
        return s, (s > threshold if strict else s >= threshold), {"score": s}

    def finder(pdf, pay, floor):
        qm, screen = pay
        rows = vector_matrix(pdf["_v"].values, qm.shape[1])
        hit = screen.hits(rows, 0, np.maximum(floor, threshold) - 10.0 ** -digits)
        if hit is None:
            return None
        r, c = hit
        s = np.round(pair_products(rows, r, qm, c), digits)
        keep = (s > threshold if strict else s >= threshold) & (s >= floor[c])
        return r[keep], c[keep], s[keep], {"score": s[keep]}

    keys = list(dict.fromkeys(list(key_cols) + ([secondary] if secondary else [])))
    order = [F.col("score").desc()]
    if secondary:
        order.append(F.col(secondary).desc())
    order += [F.col(c).asc() for c in (tie_cols or key_cols)]
    src = chunks.withColumn("_v", F.col(chunk_vec)).select(*dict.fromkeys(keys + ["_v"]))
    return scan_topk(src, _query_vectors(queries, query_id, query_vec), keys, ["_v"], payload, scorer,
                     [("score", T.DoubleType())], k, order, block_bytes=block_bytes, group_bytes=group_bytes, fold=True,
                     finder=finder)


def sweep_scores(chunks: DataFrame, queries: DataFrame, thresholds: Sequence[float],
                 chunk_vec: str = "embedding", query_vec: str = "embedding", chunk_label: str = "label",
                 query_label: str = "query_label", digits: int = 9, block_bytes: int = DEFAULT_BLOCK_BYTES,
                 group_bytes: int = DEFAULT_GROUP_BYTES) -> DataFrame:
    """(query_id, threshold, results, score_sum, hits, relevant) of every query and threshold.

    ``results`` chunks score at least the threshold, ``hits`` of them have the query's
    label, which ``relevant`` chunks have in all. Counted inside the scan: rows out are
    queries x thresholds per task, whatever the number of pairs. Chunks of the same vector
    and label are scored once. Null labels match nothing.
    """
    from ..session import scratch_path
    steps = np.array(sorted(thresholds), dtype=np.float64)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("threshold", T.DoubleType()), T.StructField("results", T.LongType()),
                           T.StructField("score_sum", T.DoubleType()), T.StructField("hits", T.LongType()),
                           T.StructField("relevant", T.LongType())])

    def counted(batches, qm, labels):
        nq, ns = len(qm), len(steps)
        known = {x: i for i, x in enumerate(dict.fromkeys(x for x in labels if not pd.isna(x)))}
        label = np.array([-1 if pd.isna(x) else known[x] for x in labels], dtype=np.int64)
        found = np.zeros((3, ns * nq))          # rows, scores and hits by the highest threshold passed
        of_label = np.zeros(len(known) + 1)
        step = max(1, SLICE_CELLS // max(nq, 1))
        for pdf in batches:
            own = np.array([-2 if pd.isna(x) else known.get(x, -2) for x in pdf["_label"].values], dtype=np.int64)
            times = pdf["_times"].to_numpy(dtype=np.float64)
            of_label += np.bincount(np.maximum(own, -1) + 1, times, minlength=len(of_label))
            for r0 in range(0, len(pdf), step):
                s = np.round(vector_matrix(pdf["_v"].values[r0:r0 + step], qm.shape[1]) @ qm.T, digits)
                r, c = np.nonzero(s >= steps[0])
                v, w = s[r, c], times[r + r0]
                at = (np.searchsorted(steps, v, side="right") - 1) * nq + c
                same = own[r + r0] == label[c]
                for i, x in enumerate((w, w * v, w * same)):
                    found[i] += np.bincount(at, x, minlength=ns * nq)
        passed = found.reshape(3, ns, nq)[:, ::-1].cumsum(axis=1)[:, ::-1].reshape(3, ns * nq)
        relevant = np.where(label >= 0, of_label[label + 1], 0)
        return {"threshold": np.repeat(steps, nq), "results": passed[0].astype(np.int64), "score_sum": passed[1],
                "hits": passed[2].astype(np.int64), "relevant": np.tile(relevant, ns).astype(np.int64)}

    def payload(rows, width):
        return (rows["query_id"].to_numpy(dtype=object), vector_matrix(rows["qv"].values, width),
                rows["ql"].to_numpy(dtype=object))

    def per_block(batches, ready):
        yield pd.DataFrame({"query_id": np.tile(ready[0], len(steps)), **counted(batches, *ready[1:])})

    src = chunks.select(F.col(chunk_vec).alias("_v"), F.col(chunk_label).alias("_label")).groupBy("_v", "_label").agg(
        F.count(F.lit(1)).alias("_times"))
    q = queries.select("query_id", F.col(query_vec).alias("qv"), F.col(query_label).alias("ql"))
    blocks, total, width = query_blocks(q, block_bytes)
    if total <= block_bytes:
        found = scan(src, q, payload, per_block, schema, ready_blocks=(blocks, total, width))
    else:
        def per_group(held, parts, shape):
            ids = held.column("query_id").combine_chunks()
            _, qm, labels = payload(held.to_pandas(), width)
            got = counted(parts, qm, labels)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.tile(np.arange(len(ids)), len(steps)))).cast(shape.field(0).type),
                 *[pa.array(got[f.name]) for f in schema.fields[1:]]], schema=shape)
        found = dealt(src, blocks, q.schema, per_group, schema, total, group_bytes,
                      scratch_path(chunks.sparkSession, f"dealt-{uuid.uuid4().hex}"))
    return found.groupBy("query_id", "threshold").agg(*[F.sum(c).alias(c) for c in
                                                        ("results", "score_sum", "hits", "relevant")])
