"""Jaccard self-join on word n-grams by prefixes of token combinations.

With tokens (n-gram hashes) in one global order, two sets of Jaccard at least t
share at least k tokens in their prefixes of length n - ceil(t n) + k. A pair
that shares a *rare* token is found by that token alone. A pair that shares none
shares k *frequent* ones; dealt into fewer classes than that, two of them fall
into one class, so indexing pairs of frequent tokens of equal class finds it.
k grows with the set, which does two things: a set with fewer than k tokens that
anyone else has needs no index entry at all, and the classes stay so small that
a set has about as many combinations as prefix tokens.

Sets that share an entry are not paired with each other. They are gathered
under the smallest of them (the entry's leader), the distinct memberships of a
leader are verified together on whole texts, and only the links that join
clusters are kept. Large gatherings are dealt out in pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import frozen, text_of
from .components import components

_BYTE = np.uint64(0x100000001B3)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    """Links need percent * union <= 100 * intersection of sets of ``words``-word shingles.

    ``extension``: k as a share of the set's size. ``rare``: a token that at most
    so many sets have in their prefixes is indexed alone. ``block`` sets and
    ``block_tokens`` tokens make a block of a large gathering.
    """
    words: int = 3
    percent: int = 90
    extension: float = 0.1
    rare: int = 16
    block: int = 1024
    block_tokens: int = 1_000_000

    def extended(self, size: int) -> int:
        return max(1, math.ceil(round(self.extension * size, 9)))

    def prefix(self, size: int) -> int:
        return min(size, size - self.smallest_partner(size) + self.extended(size))

    def smallest_partner(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def needed(self, size: int) -> int:
        """Prefix tokens that any partner of a set of ``size`` shares with it."""
        return self.extended(self.smallest_partner(size))

    def band(self, size: int) -> int:
        """Partners are at most one band apart."""
        return int(math.log(size) / math.log(100 / self.percent) + 1e-9) if self.percent < 100 else size

    def smallest_in(self, band: int) -> int:
        return max(1, math.ceil((100 / self.percent) ** band - 1e-6)) if self.percent < 100 else band


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a whole text.

    A-Z are lower-cased, words are runs of characters other than ASCII white
    space; with fewer words than an n-gram the whole sequence counts as one.
    """
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # Polynomial hashes of all words at once: differences of running sums.
        power = np.cumprod(np.full(len(data), _BYTE))
        run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        inverse = np.cumprod(np.full(len(data), np.uint64(pow(int(_BYTE), -1, 1 << 64))))
        word = _mixed((run[stop] - run[start]) * inverse[start] + (stop - start).astype(np.uint64) * _MIX[0])
        n = min(words, len(word))
        gram = np.full(len(word) - n + 1, np.uint64(n))
        for i in range(n):
            gram = _mixed(gram * _MIX[0] + word[i:len(word) - n + 1 + i])
    return np.unique(gram)


def _signatures(docs: DataFrame, settings: Settings, prefixes: bool) -> DataFrame:
    """(id, n, digest) of every row, and the prefix in hash order, which is the global order."""
    names = ["id", "n", "digest"] + ["prefix"] * prefixes

    def sign(batches):
        for batch in batches:
            n, digest, prefix = [], [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), settings.words)
                n.append(len(tokens))
                digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                if prefixes:
                    prefix.append(tokens[:settings.prefix(len(tokens))].view(np.int64))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary())]
            if prefixes:
                columns.append(pa.array(prefix, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n long, digest binary" + ", prefix array<long>" * prefixes)


#: Bits of the membership filter; its table has at most a 64th as many rows.
FILTER_BITS = 1 << 24


def _likely_members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids``, and by chance a few others, without moving the rest.

    The broadcast table of 64-bit words has at most FILTER_BITS / 64 rows of two
    longs (4 MB) however many ids there are.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = (ids.select(bit.alias("_bit"))
             .select(F.shiftright("_bit", 6).alias("_word"),
                     F.expr("shiftleft(1L, cast(_bit % 64 AS int))").alias("_mask"))
             .groupBy("_word").agg(F.bit_or("_mask").alias("_mask")))
    tested = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    return (tested.join(F.broadcast(words), "_word")
            .filter("(shiftrightunsigned(_mask, cast(_bit % 64 AS int)) & 1L) = 1").drop("_word", "_bit", "_mask"))


def _index_entries(found: DataFrame, settings: Settings) -> DataFrame:
    """(entry, id, n): rare tokens alone, frequent ones as pairs within a class."""
    def entries(batches):
        for batch in batches:
            keys, rows = [], []
            for row, (size, tokens) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens"))):
                pairs = tokens.as_py()
                own = [("t%d" % p["token"]).encode() for p in pairs if not p["frequent"]]
                frequent = sorted(p["token"] for p in pairs if p["frequent"])
                for band in (settings.band(size), settings.band(size) + 1):
                    # Fewest tokens shared by a pair of which one set is in this band
                    # and the other in it or in the one below.
                    shared = settings.extended(settings.smallest_in(band - 1) if band else 1)
                    if shared < 2:
                        own += [b"s%d" % t for t in frequent]
                        continue
                    classes: dict[int, list[int]] = {}
                    for t in frequent:
                        classes.setdefault(t % (shared - 1), []).append(t)
                    own += [b"%d:%d:%d" % (band, a, b) for c in classes.values() for a, b in combinations(c, 2)]
                own = set(own)
                keys += [int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in own]
                rows += [row] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("id").take(at),
                                              batch.column("n").take(at)], ["entry", "id", "n"])

    kind = found.schema["id"].dataType.simpleString()
    return found.select("id", "n", "tokens").mapInArrow(entries, f"entry long, id {kind}, n long")


def _clusters(linked: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component in a symmetric boolean matrix."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Tokens with the same holders are counted together."""
    count = len(sets)
    common = np.zeros((count, count), dtype=np.float32)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(starts, len(token)))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
        holders = owner[starts[sizes == size][:, None] + np.arange(size)]
        for a, b in combinations(range(size), 2):
            np.add.at(common, (holders[:, a], holders[:, b]), 1)
    wide = np.flatnonzero(sizes > 8)
    common += common.T
    for first in range(0, len(wide), 1024):
        some = wide[first:first + 1024]
        has = np.zeros((count, len(some)), dtype=np.float32)
        for column, i in enumerate(some):
            has[owner[starts[i]:starts[i] + sizes[i]], column] = 1
        common += has @ has.T
    return common


def _verified(settings: Settings):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, settings.words) for t in group["text"]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        common = _intersections(sets)
        linked = 100 * common >= settings.percent * (size[:, None] + size[None, :] - common)
        linked |= group["id"].to_numpy()[:, None] == group["id"].to_numpy()[None, :]
        np.fill_diagonal(linked, True)
        ids = group["id"].to_numpy()
        label = _clusters(linked)
        inner = label != np.arange(len(label))
        return pd.DataFrame({"u": ids[inner], "v": ids[label[inner]]})
    return verify


def _gatherings(entries: DataFrame, settings: Settings) -> DataFrame:
    """(leader, i, j, id): which sets are verified together.

    A gathering within the block limits is one group (i = j = 0). In a larger one
    sets are dealt by size band and hash into blocks, and each pair of blocks that
    can hold partners is a group.
    """
    leaders = entries.groupBy("entry").agg(F.min("id").alias("leader"), F.count("*").alias("sets")).filter("sets > 1")
    member = entries.join(leaders.drop("sets"), "entry").select("leader", "id", "n").distinct()
    log = math.log(100 / settings.percent)
    member = frozen(member.withColumn("band", F.floor(F.log("n") / log + 1e-9)))
    load = member.groupBy("leader", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    over = load.groupBy("leader").agg(F.sum("sets").alias("all_sets"), F.sum("tokens").alias("all_tokens"))
    parts = F.greatest(F.ceil(F.col("sets") / settings.block), F.ceil(F.col("tokens") / settings.block_tokens))
    whole = (F.col("all_sets") <= settings.block) & (F.col("all_tokens") <= 2 * settings.block_tokens)
    load = load.select("leader", "band", parts.alias("parts"))
    near = load.select("leader", "band", "parts",
                       # blocks in the neighbouring bands, by a small window over the bands of one leader
                       F.max(F.struct("band", "parts")).over(_bands(-1, -1)).alias("below"),
                       F.max(F.struct("band", "parts")).over(_bands(1, 1)).alias("above"))

    def count(side):
        return F.coalesce(F.col(f"{side}.parts"), F.lit(0))

    dealt = member.join(near, ["leader", "band"]).join(over, "leader")
    own = F.pmod(F.xxhash64("id"), F.col("parts"))

    def name(band, part):
        return F.concat_ws(".", band.cast("string"), part.cast("string"))

    def all_of(side, band):
        return F.transform(F.sequence(F.lit(1), count(side)), lambda p: name(band, p - 1))

    empty = F.array().cast("array<string>")
    others = F.concat(
        F.transform(F.sequence(F.lit(1), F.col("parts")), lambda p: name(F.col("band"), p - 1)),
        F.when(count("below") > 0, all_of("below", F.col("band") - 1)).otherwise(empty),
        F.when(count("above") > 0, all_of("above", F.col("band") + 1)).otherwise(empty))
    groups = F.when(whole, F.array(F.lit(""))).otherwise(others)
    mine = F.when(whole, F.lit("")).otherwise(name(F.col("band"), own))
    return (dealt.select("leader", "id", mine.alias("mine"), F.explode(groups).alias("other"))
            .select("leader", "id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))


def _bands(first: int, last: int):
    return Window.partitionBy("leader").orderBy("band").rangeBetween(first, last)


def jaccard_links(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(signatures, links) of a table (id, text) without nulls.

    Rows with equal sets share the digest in ``signatures``; ``links`` joins class
    representatives (the smallest ids of their digests) into exactly the components
    that all qualifying pairs would give.
    """
    # Texts are read once more for the prefixes rather than storing those of all rows.
    signed = frozen(_signatures(docs, settings, False))
    classes = (_signatures(docs, settings, True).filter("n > 0").groupBy("digest", "n")
               .agg(F.min("id").alias("id"), F.first("prefix").alias("prefix")))
    tokens = classes.select("id", "n", F.explode("prefix").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1")
    # Conservative for all partners: the fewest tokens that any of them shares.
    least = F.greatest(F.lit(1), F.ceil(F.round(
        settings.extension * F.ceil(settings.percent * F.col("n") / 100), 9)))
    found = (tokens.join(held, "token")
             .groupBy("id", "n")
             .agg(F.collect_list(F.struct("token", (F.col("holders") > settings.rare).alias("frequent"))).alias("tokens"))
             .filter(F.size("tokens") >= least))
    entries = frozen(_index_entries(found, settings))
    groups = frozen(_gatherings(entries, settings))
    kind = docs.schema["id"].dataType.simpleString()
    links = (groups.join(_likely_members(docs, groups.select("id").distinct()), "id").groupBy("leader", "i", "j")
             .applyInPandas(_verified(settings), f"u {kind}, v {kind}"))
    return signed, links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       settings: Settings = Settings()) -> DataFrame:
    """n_shingles and component_id (smallest id reachable by links) of every row.

    Null and empty texts have the empty set and are linked with nothing. Repeated
    rows and equal texts are one class; ties do not arise, as all links count.
    Rows that share an id are one document whose sets all count. A row without an
    id has no component. Other columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = source.filter("id is not null")
    signed, links = jaccard_links(known, settings)
    smallest = signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first"))
    joined = components(links).withColumnRenamed("node", "first")
    of_class = smallest.join(joined, "first", "left").select(
        "digest", F.coalesce("component", "first").alias("component"))
    rows = (signed.select("id", "n", "digest").join(of_class, "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id")))
    nameless = _signatures(source.filter("id is null"), settings, False).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return rows.unionByName(nameless)


def _free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any spelling of case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           settings: Settings = Settings()) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Rows that repeat that document's id and text count as copies of it: one stays.
    Different texts under its id all stay, as do rows without an id. Null and empty texts
    are in no group and stay; columns may have any names; an empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col, settings)
    first_col, digest_col = (_free_name(docs, name) for name in ("first", "digest"))
    first = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(first_col)).distinct()
    chosen = docs.join(first, docs[id_col] == first[first_col], "left_semi")
    digest = F.sha2(F.encode(text_of(text_col), "UTF-8"), 256)
    one = chosen.withColumn(digest_col, digest).dropDuplicates([id_col, digest_col]).drop(digest_col)
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
