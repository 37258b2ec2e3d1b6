"""Repairing the turns of conversations by cheapest edits, ties by the least audit.

A repaired conversation has the roles ``(s?(ua)+)?``. Rows are kept, given another
role or deleted, turns are inserted; a cost program over (row, state of that grammar)
finds what each way costs. Of the cheapest ways the one whose string of edit
initials (D, I, K, R) is least is wanted. Arcs on cheapest ways are called optimal;
nodes are ranked by the first 1, 2, 4, ... letters of their least audits, each
rank from two of half the length, and pointers double along. Ranks choose among
optimal arcs; the path is read off the doubled pointers.

Conversations are cut into segments of bounded length, so a conversation may hold
any share of the rows: segments give 4 x 4 cost matrices, a stream of those
(backwards) the costs behind each segment, every segment then its audit for each
state it may be entered in, and a stream (forwards) picks them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import frozen

# States: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after a user or assistant turn is put in, by state before.
_PUT = np.array([_USER, _USER, _ASSISTANT, _USER])
_INITIALS = {"s": 1, "u": 2, "a": 3}
#: State after keeping a row, by its initial (0: any other) and the state before; -1: not possible.
_KEPT = np.array([[-1, -1, -1, -1], [_SYSTEM, -1, -1, -1], [_USER, _USER, -1, _USER], [-1, -1, _ASSISTANT, -1]])
_GONE, _CUT_OFF = 4, 8
_NEVER = 1 << 60
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
_D, _I, _K, _R = range(4)


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1

    def closing(self) -> np.ndarray:
        """Costs from each state to an accepted end: put in what is missing."""
        return np.array([0, 2 * self.insert, self.insert, 0])


def _arcs(kind: np.ndarray, behind: np.ndarray, costs: Costs) -> np.ndarray:
    """Costs of deleting, keeping and reroling rows by state: (3, rows, 4, ...).

    ``behind``: (rows, 4, ...) costs from each state after the row.
    """
    extra = np.where(kind & _CUT_OFF, costs.truncated, 0).reshape((-1,) + (1,) * (behind.ndim - 1))
    gone = ((kind & _GONE) > 0).reshape(extra.shape)
    to = _KEPT[kind & 3]
    kept = np.take_along_axis(behind, np.maximum(to, 0).reshape(to.shape + (1,) * (behind.ndim - 2)), axis=1)
    barred = gone | (to < 0).reshape(to.shape + (1,) * (behind.ndim - 2))
    return np.stack([behind + costs.delete, np.where(barred, _NEVER, kept + extra),
                     np.where(gone, _NEVER, behind[:, _PUT] + extra + costs.rerole)])


def _closed(costs_here: np.ndarray, insert: int) -> np.ndarray:
    """Costs by state if turns may be put in first."""
    u = np.minimum(costs_here[:, _USER], insert + costs_here[:, _ASSISTANT])
    a = np.minimum(costs_here[:, _ASSISTANT], insert + costs_here[:, _USER])
    return np.stack([np.minimum(costs_here[:, _START], insert + u), np.minimum(costs_here[:, _SYSTEM], insert + u),
                     u, a], axis=1)


def _backward(kinds: np.ndarray, bounds: np.ndarray, exits: np.ndarray, costs: Costs, layers: np.ndarray | None = None):
    """Costs before each segment's first row, from those behind its last (``exits``:
    (segments, 4, ...)). ``layers`` takes the costs before every row and at the end:
    row i of segment s is layer bounds[s] + s + i."""
    now = exits.copy()
    size = np.diff(bounds)
    segment = np.arange(len(size))
    if layers is not None:
        layers[bounds[1:] + segment] = now
    for back in range(1, int(size.max(initial=0)) + 1):
        here = np.flatnonzero(size >= back)
        row = bounds[here + 1] - back
        now[here] = _closed(_arcs(kinds[row], now[here], costs).min(axis=0), costs.insert)
        if layers is not None:
            layers[row + here] = now[here]
    return now


def _matrices(kinds: np.ndarray, bounds: np.ndarray, costs: Costs) -> np.ndarray:
    """(segments, entry state, exit state): cheapest costs."""
    one = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    return np.minimum(_backward(kinds, bounds, np.tile(one, (len(bounds) - 1, 1, 1)), costs), _NEVER)


def least_audits(kinds: np.ndarray, bounds: np.ndarray, exits: np.ndarray, costs: Costs):
    """For every segment and state it is entered in: its least optimal audit and exit state.

    Returns (letters, their bounds, exit states, costs), entries in the order segment * 4 + state.
    """
    n, segments = int(bounds[-1]), len(bounds) - 1
    count = n + segments
    layers = np.empty((count, 4), np.int64)
    _backward(kinds, bounds, exits, costs, layers)
    ends = bounds[1:] + np.arange(segments)
    is_row = np.ones(count, dtype=bool)
    is_row[ends] = False
    at = np.flatnonzero(is_row)
    node = np.arange(count * 4).reshape(count, 4)
    # Arcs of a node by letter, so no two of a node share their letter.
    weight = np.full((4, count, 4), _NEVER, np.int64)
    target = np.tile(node, (4, 1, 1))
    arcs = _arcs(kinds, layers[at + 1], costs)
    weight[_D, at], weight[_K, at], weight[_R, at] = arcs
    weight[_I, at] = layers[at][:, _PUT] + costs.insert
    to = _KEPT[kinds & 3]
    target[_D, at] = node[at + 1]
    target[_K, at] = np.take_along_axis(node[at + 1], np.maximum(to, 0), axis=1)
    target[_R, at] = node[at + 1][:, _PUT]
    target[_I, at] = node[at][:, _PUT]
    optimal = weight == layers
    open_node = optimal.any(axis=0)  # the layer at a segment's end has no arcs
    letter = optimal.argmax(axis=0).ravel()
    step = np.take_along_axis(target, letter.reshape(1, count, 4), axis=0)[0].ravel()
    open_node = open_node.ravel()
    step = np.where(open_node, step, np.arange(count * 4))
    # Ranks of the least audits by their first 1, 2, 4, ... letters; an ended one is least.
    rank = np.where(open_node, letter + 1, 0).astype(np.int64)
    length = open_node.astype(np.int64)
    jumps = [step]
    longest = 3 * int(np.diff(bounds).max(initial=0)) + 1
    while (1 << len(jumps)) <= longest:
        jump = jumps[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        jumps.append(jump[jump])
    length = length + length[jumps[-1]]
    # The least arc by letter and then rank of the rest.
    order = np.where(optimal, np.arange(4)[:, None, None] * (rank.max() + 1) + rank[target], _NEVER)
    chosen = order.argmin(axis=0).ravel()
    entry = ((bounds[:-1] + np.arange(segments))[:, None] * 4 + np.arange(4)).ravel()
    size = length[entry]
    out = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(int(out[-1])) - np.repeat(out[:-1], size)

    def after(node_, steps):
        for k, jump in enumerate(jumps):
            node_ = np.where((steps >> k) & 1, jump[node_], node_)
        return node_
    letters = _LETTERS[chosen[after(np.repeat(entry, size), places)]]
    return letters, out, after(entry, size) % 4, layers.ravel()[entry]


_SEGMENT = ("ck string, p int, no int, kinds binary, illegal long, costs binary")


def _segments(size: int, costs: Costs):
    """Sorted rows -> segments of one conversation: a byte a row, and the cost matrix."""
    def make(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, no, open_key, open_kinds = None, 0, None, []

        def emit(done):
            kinds = np.concatenate([k for _, _, ks in done for k in ks])
            bounds = np.concatenate([[0], np.cumsum([sum(map(len, ks)) for _, _, ks in done])]).astype(np.int64)
            costs_ = _matrices(kinds, bounds, costs)
            initial = kinds & 3
            bad = np.ones(len(kinds), np.int64)
            bad[1:] = ~(((initial[1:] == 2) & ((initial[:-1] == 1) | (initial[:-1] == 3))) |
                        ((initial[1:] == 3) & (initial[:-1] == 2)))
            bad[bounds[:-1]] = 0
            total = np.concatenate([[0], np.cumsum(bad)])
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in done]), pa.array([part] * len(done), pa.int32()),
                pa.array([x for _, x, _ in done], pa.int32()),
                pa.array([kinds[a:b].astype(np.uint8).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                pa.array(total[bounds[1:]] - total[bounds[:-1]]),
                pa.array([c.astype(np.int64).tobytes() for c in costs_], pa.binary())],
                ["ck", "p", "no", "kinds", "illegal", "costs"])

        for batch in batches:
            keys = batch.column("ck").to_pylist()
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            done = []
            for a, b in zip(edges[:-1], edges[1:]):
                if open_kinds and keys[a] != open_key:
                    done.append((open_key, no, open_kinds))
                    open_kinds = []
                if keys[a] != open_key:
                    open_key, no = keys[a], 0
                while a < b:
                    room = size - sum(map(len, open_kinds))
                    open_kinds.append(kinds[a:min(b, a + room)])
                    a += room
                    if sum(map(len, open_kinds)) == size:
                        done.append((open_key, no, open_kinds))
                        no, open_kinds = no + 1, []
            if done:
                yield emit(done)
        if open_kinds:
            yield emit([(open_key, no, open_kinds)])
    return make


def _behind(costs: Costs):
    """A stream of segments from each conversation's last to its first -> costs behind each."""
    def scan(batches):
        key, now = None, None
        for batch in batches:
            out = []
            for ck, matrix in zip(batch.column("ck").to_pylist(), batch.column("costs").to_pylist()):
                if ck != key or now is None:
                    key, now = ck, costs.closing()
                out.append(now.astype(np.int64).tobytes())
                now = (np.frombuffer(matrix, np.int64).reshape(4, 4) + now).min(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ck", "p", "no")), pa.array(out, pa.binary())],
                                             ["ck", "p", "no", "behind"])
    return scan


def _audit(costs: Costs, rows_at_once: int = 100_000):
    def audit(batches):
        for batch in batches:
            size = np.array([len(b) for b in batch.column("kinds").to_pylist()], dtype=np.int64)
            group = np.cumsum(size) // rows_at_once
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                yield audited(batch.slice(a, b - a))

    def audited(batch):
        blobs = batch.column("kinds").to_pylist()
        kinds = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        exits = np.stack([np.frombuffer(b, np.int64) for b in batch.column("behind").to_pylist()])
        letters, out, ends, total = least_audits(kinds, bounds, exits, costs)
        text = letters.tobytes().decode()
        audits = [[text[a:b] for a, b in zip(out[i:i + 4], out[i + 1:i + 5])] for i in range(0, 4 * len(blobs), 4)]
        return pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("ck", "p", "no", "illegal")), pa.array(audits, pa.list_(pa.string())),
            pa.array(ends.reshape(-1, 4).tolist(), pa.list_(pa.int64())), pa.array(total[_START::4]),
            pa.array([b[0] & 3 for b in blobs], pa.int32()), pa.array([b[-1] & 3 for b in blobs], pa.int32())],
            ["ck", "p", "no", "illegal", "audits", "ends", "total", "head", "tail"])
    return audit


_AUDITED = "ck string, p int, no int, illegal long, audits array<string>, ends array<bigint>, total long, head int, tail int"
_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _assemble(rows_out: bool):
    """Per conversation its segments, then its rows: the audit, and the repaired turns as a
    stream (``rows_out``) or their hash."""
    def closing(state):
        return {_START: "", _ASSISTANT: "", _USER: "I", _SYSTEM: "II"}[state]

    class Conversation:
        def __init__(self, key):
            self.key, self.state, self.parts, self.illegal, self.tail = key, _START, [], 0, None
            self.letters, self.place, self.hash, self.first, self.turn_state = None, 0, hashlib.sha256(), True, _START
            self.no, self.cost = 0, None

        def segment(self, audits, ends, illegal, total, head, tail):
            if self.cost is None:
                self.cost = total  # from the start over all that follows
            self.parts.append(audits[self.state])
            self.state = ends[self.state]
            self.illegal += illegal + (self.tail is not None and (self.tail, head) not in _LEGAL)
            self.tail = tail

        def seal(self):
            self.letters = "".join(self.parts) + closing(self.state)
            self.parts = []

        def put(self, role, text, edit):
            self.no += 1
            if rows_out:
                return [(self.key, self.no, role, text, edit)]
            self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.first = False
            return []

        def inserted(self):
            out = []
            while self.place < len(self.letters) and self.letters[self.place] == "I":
                out += self.fresh("", "I")
                self.place += 1
            return out

        def fresh(self, text, edit):
            self.turn_state = int(_PUT[self.turn_state])
            return self.put("user" if self.turn_state == _USER else "assistant", text, edit)

        def row(self, role, text):
            if self.letters is None:
                self.seal()
            out = self.inserted()
            edit = self.letters[self.place]
            self.place += 1
            if edit == "K":
                self.turn_state = int(_KEPT[_INITIALS[role[0]], self.turn_state])
                out += self.put(role, text, edit)
            elif edit == "R":
                out += self.fresh(text, edit)
            return out

        def end(self):
            if self.letters is None:
                self.seal()
            out = self.inserted()
            return out if rows_out else [(self.key, self.illegal, self.cost, self.letters, self.hash.hexdigest())]

    def assemble(batches):
        now = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in
                       ("ck", "kind", "audits", "ends", "illegal", "total", "head", "tail", "role", "text")]
            for ck, kind, audits, ends, illegal, total, head, tail, role, text in zip(*columns):
                if now is None or now.key != ck:
                    out += now.end() if now else []
                    now = Conversation(ck)
                if kind == 0:
                    now.segment(audits, ends, illegal, total, head, tail)
                else:
                    out += now.row(role, text)
            yield _batch(out, rows_out)
        if now:
            yield _batch(now.end(), rows_out)
    return assemble


def _batch(rows, rows_out):
    names = ["ck", "place", "role", "text", "edit"] if rows_out else ["ck", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] if rows_out else [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _key(conv: Column) -> Column:
    """A conversation's key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def flagged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows (ck, turn, role, text, tie, fault) with their first fault: blank, duplicate, truncated or null.

    Null roles and texts are one space. Rows of a conversation are ordered by turn (null
    first), role, text; equal rows stand in input order, all but the first are duplicates.
    """
    space = "[\\x20\\x09-\\x0D]"
    rows = turns.select(
        _key(F.col(conv_col)).alias("ck"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie"))
    rows = rows.withColumn("said", F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"),
                                                  "UTF-8")))
    first = rows.groupBy("ck", "said").agg(F.min(F.struct("turn", "tie")).alias("first"))
    bare = F.regexp_replace("text", f"{space}+$", "")
    fault = (F.when(F.length(F.regexp_replace("text", f"{space}+", "")) == 0, "blank")
             .when(~F.struct("turn", "tie").eqNullSafe(F.col("first")), "duplicate")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))
    return rows.join(first, ["ck", "said"]).select("ck", "turn", "role", "text", "tie", fault.alias("fault"))


def _prepared(rows: DataFrame, costs: Costs, segment: int) -> DataFrame:
    """Audited segments and rows of every conversation, dealt and sorted for ``_assemble``."""
    spark = rows.sparkSession
    code = F.coalesce(*[F.when(F.substring("role", 1, 1) == i, n) for i, n in _INITIALS.items()], F.lit(0))
    kind = code + F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(
        F.col("fault") == "truncated", _CUT_OFF).otherwise(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ck", "turn", "role", "text", "tie"]
    cut = frozen(rows.withColumn("kind", kind.cast("long")).repartitionByRange(parts, *order)
                 .sortWithinPartitions(*order).select("ck", "kind").mapInArrow(_segments(segment, costs), _SEGMENT))
    behind = (cut.select("ck", "p", "no", "costs").repartition("ck")
              .sortWithinPartitions("ck", F.desc("p"), F.desc("no"))
              .mapInArrow(_behind(costs), "ck string, p int, no int, behind binary"))
    audited = cut.join(behind, ["ck", "p", "no"]).select("ck", "p", "no", "kinds", "illegal", "behind").mapInArrow(
        _audit(costs), _AUDITED)
    both = audited.withColumn("kind", F.lit(0)).unionByName(rows.select(
        "ck", "turn", "role", "text", "tie", F.lit(1).alias("kind")), allowMissingColumns=True)
    return both.repartition("ck").sortWithinPartitions("ck", "kind", "p", "no", "turn", "role", "text", "tie").select(
        "ck", "kind", "audits", "ends", "illegal", "total", "head", "tail", "role", "text")


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", costs: Costs = Costs(), segment: int = 1024) -> DataFrame:
    """(conv, place, role, text, edit) of the repaired conversations: K kept, R reroled, I inserted."""
    rows = flagged(turns, conv_col, turn_col, role_col, text_col)
    names = turns.select(F.col(conv_col).alias("conv"), _key(F.col(conv_col)).alias("ck")).distinct()
    done = _prepared(rows, costs, segment).mapInArrow(
        _assemble(True), "ck string, place long, role string, text string, edit string")
    return done.join(names, "ck").select(F.col("conv").alias(conv_col), "place", "role", "text", "edit")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", conversations: DataFrame | None = None, costs: Costs = Costs(),
           segment: int = 1024) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost, audit, hash of the result.

    ``conversations`` (a column ``conv_col``) names conversations that count without rows
    too: zeros, an empty audit and the empty string's hash. A null conversation is one
    of its own; null roles and texts are one space; turns without a number come first
    and count for no gap. Repeated rows are duplicates. Other columns are not looked at;
    an empty table gives no rows. Any conversation may be long: only its audit (a byte a
    row) and one hash state are held at once.
    """
    rows = flagged(turns, conv_col, turn_col, role_col, text_col)
    done = _prepared(rows, costs, segment).mapInArrow(
        _assemble(False), "ck string, illegal long, cost long, audit string, repaired_sha256 string")

    def faults(name: str) -> Column:
        return F.count(F.when(F.col("fault") == name, 1)).alias(name)

    counted = rows.groupBy("ck").agg(faults("blank"), faults("duplicate"), faults("truncated"),
                                     F.min("turn").alias("low"), F.max("turn").alias("high"))
    numbers = rows.filter("turn is not null").select("ck", "turn").distinct().groupBy("ck").agg(
        F.count("*").alias("turns"))
    source = turns if conversations is None else conversations
    names = source.select(F.col(conv_col).alias("conv")).distinct().withColumn("ck", _key(F.col("conv")))
    zero = F.lit(0).cast("long")
    found = names.join(done, "ck", "left").join(counted, "ck", "left").join(numbers, "ck", "left")
    return found.select(
        F.col("conv").alias(conv_col),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), zero).alias("gaps"),
        *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
