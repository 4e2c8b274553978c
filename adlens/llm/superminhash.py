"""Near-duplicates by SuperMinHash signatures, banding, verification and components.

A signature has ``SLOTS`` places. Each shingle walks a random permutation of the places,
one step a level; the value it offers a place is the level it gets there and a random
fraction, and the place keeps the smallest. One shingle thus fills every place at a
different level, which makes the places of a set negatively correlated and the estimate
less variable than with independent hashes. A walk stops at the level above which no place
of its document can change; sets of many shingles stop after one step or two. Levels are
run for many documents at once, as arrays.

``SLOTS / ROWS`` bands of ``ROWS`` places are the keys of the buckets: a pair with
similarity 0.8 shares none of 32 bands with probability 5e-8. Equal sets are one node, so
copies cost nothing. The nodes of a bucket are compared (``components.grouped``)

1. with the one that meets most others, which joins a group of near copies of any size with
   one comparison a member and bucket; then
2. where they still are in several components, those outside the bucket's largest component
   with the nodes of other components, if their signatures agree in ``MIN_AGREE`` places (a
   pair with similarity 0.8 falls below once in 10^9). Such nodes are dealt in blocks, against
   which the bucket's nodes are streamed; only links leave a task.

Each comparison is made on the full shingle sets of the texts.

Defined results: texts without words (or null) have an empty set, link with nothing and are
components of their own; fewer words than a shingle make one shingle; null ids take part
but never are a component's id (which is null without any id); ``kept`` is whether the two
are equal, two nulls included; repeated rows return once each; an empty table gives an
empty result; other columns are not read. Sets are equal if the 64-bit hash of all their
sorted shingle hashes is (a chance of 3 in 10^10 over 10^5 sets that any two collide).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlens.llm.common import column_chunks, written
from adlens.llm.components import grouped

SEED = 42
SLOTS, ROWS = 128, 4
#: Of 128 places, 102 agree on average at similarity 0.8 (standard deviation 4.5); this is six below.
MIN_AGREE = 75
#: Comparisons of one node that a task gets together, and nodes of a key that it holds at once.
SALT_PAIRS = 512
BLOCK_NODES = 512
ELEMENTS = 1 << 16
_FRACTION = np.uint64(56)
_EMPTY = np.uint64(2**64 - 1)


def shingles(text: str | None, shingle: int = 4) -> set[tuple[bytes, ...]]:
    """The distinct word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle))))


def _hashes(own: set) -> np.ndarray:
    import xxhash
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.sort(np.array([digest(join(s), SEED) for s in own], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values per non-empty array of element hashes; the level is in the top 8 bits of a value."""
    out = np.full((len(sets), slots), _EMPTY, np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= ELEMENTS):
            size += len(sets[last])
            last += 1
        _walk(sets[first:last], out[first:last], slots)
        first = last
    return out


def _walk(sets: list[np.ndarray], out: np.ndarray, slots: int) -> None:
    seed, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, walks = out.reshape(-1), None
    for level in range(slots):
        draw = _mixed(seed + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = level + ((_mixed(draw) >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        value = (draw >> np.uint64(8)) | np.uint64(level) << _FRACTION
        if walks is None:
            place = to
        else:
            every = np.arange(len(to))
            place = walks[every, to]
            walks[every, to] = walks[:, level]
        np.minimum.at(flat, doc * slots + place, value)
        if level + 1 == slots:
            return
        go = (out.max(axis=1) >= np.uint64(level + 1) << _FRACTION)[doc]  # documents with a place that may still change
        if not go.any():
            return
        if walks is None:  # the permutations after the first step
            to = to[go]
            walks = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (len(to), 1))
            walks[np.arange(len(to)), to] = 0
        elif not go.all():
            walks = walks[go]
        seed, doc = seed[go], doc[go]


def _bands(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and signature; keys of different bands differ."""
    parts = sigs.reshape(len(sigs), -1, ROWS)
    keys = np.arange(1, parts.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        keys = _mixed(keys ^ parts[:, :, k])
    return keys.view(np.int64)


def _digests(sigs: np.ndarray) -> np.ndarray:
    """The lowest byte of each place, eight to a 64-bit value."""
    return np.ascontiguousarray(sigs.astype(np.uint8)).view(np.int64)


def _list(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.int64()))


def sketched(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text, n_shingles, node (hash of the set), keys (of the bands) and digest of every row; written once."""
    def run(batches):
        for b in batches:
            for at, texts in column_chunks(b.column("text")):
                sets = [_hashes(shingles(t, shingle)) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in full])
                place = np.zeros(len(sets), np.int64)
                place[full] = np.arange(len(full))
                none = pa.array([not len(s) for s in sets])
                take = pa.array(place, mask=none.to_numpy(zero_copy_only=False))
                keys = _list(_bands(sigs)) if full else pa.array([], pa.list_(pa.int64()))
                digest = _list(_digests(sigs)) if full else pa.array([], pa.list_(pa.int64()))
                yield pa.record_batch(
                    [b.column("doc_id").slice(at, len(sets)), b.column("text").slice(at, len(sets)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) for s in sets], pa.int64()),
                     keys.take(take), digest.take(take)],
                    ["doc_id", "text", "n_shingles", "node", "keys", "digest"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = narrow.mapInArrow(run, "doc_id long, text string, n_shingles long, node long, keys array<long>, digest array<long>")
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "superminhash")


def _set_hash(hashes: np.ndarray) -> int | None:
    import xxhash
    if not len(hashes):
        return None
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _texts(wanted: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, keys, digest) of the nodes in ``wanted``; written once."""
    first = wanted.distinct().join(nodes.select("node", "at"), "node")
    return written(rows.select("at", "text", "keys", "digest").join(first, "at").select("node", "text", "keys", "digest"), "texts")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have at least ``percent`` in common; written once."""
    pairs = written(pairs, "candidates")
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), rows, nodes)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).alias("salts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    members = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    heads = (dealt.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
             .select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))

    def rows_of(batches):
        for b in batches:
            heads_, ends = zip(b.column("a").to_pylist(), b.column("salt").to_pylist()), b.column("b").to_pylist()
            for at, texts_ in column_chunks(b.column("text")):
                for k, t in enumerate(texts_):
                    yield next(heads_), ends[at + k], t

    def run(batches):
        found = []
        for (a, _), group in groupby(rows_of(batches), lambda r: r[0]):
            own = set()
            for _, b, text in group:  # the row without b is first
                other = shingles(text, shingle)
                if b is None:
                    own = other
                    continue
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((a, b))
                if len(found) >= 10_000:
                    yield _pairs(found)
                    found = []
        yield _pairs(found)

    together = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(together.mapInArrow(run, "a long, b long"), "verified")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


class Block:
    """Some nodes of one key, with which the key's nodes are compared one at a time."""

    def __init__(self, key: int, percent: int):
        self.key, self.percent = key, percent
        self.nodes, self.roots, self.sets, self.joined = [], [], [], []
        self.keys, self.digests = [], []
        self.arrays = None

    def add(self, node: int, root: int, own: set, keys: np.ndarray, digest: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(own)
        self.joined.append(set())
        self.keys.append(keys)
        self.digests.append(digest)

    def links(self, node: int, root: int, main: int, text: str | None, shingle: int, keys: np.ndarray, digest: np.ndarray):
        """The block's nodes of other components that are similar to a node; one link to a component is enough."""
        if self.arrays is None:
            self.arrays = (np.array(self.nodes, np.int64), np.array(self.roots, np.int64), np.array(self.keys), np.array(self.digests))
        nodes, roots, all_keys, digests = self.arrays
        some = roots != root
        if root != main:  # both outside the main component: once, from the larger node
            some &= nodes < node
        some = np.flatnonzero(some)
        some = some[(digests[some] == digest).sum(axis=1) >= MIN_AGREE]
        if not len(some):
            return
        same = all_keys[some] == keys
        some = some[keys[same.argmax(axis=1)] == self.key]  # a pair is compared in the first key that it shares
        other = None
        for i in some.tolist():
            if root in self.joined[i]:
                continue
            if other is None:
                other = shingles(text, shingle)
            own = self.sets[i]
            both = len(own & other)
            if 100 * both >= self.percent * (len(own) + len(other) - both):
                self.joined[i].add(root)
                yield self.nodes[i], node


def across(apart: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the components of a key: nodes outside the main one, in blocks, against all of the key's nodes.

    Pairs are compared where the block is, and only links leave the task.
    """
    outside = apart.filter("root <> main").groupBy("key").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks"))
    texts = _texts(apart.select("node"), rows, nodes)
    own = apart.join(outside, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    heads = own.filter("root <> main").withColumn("is_other", F.lit(False))
    others = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("is_other", F.lit(True))
    sent = heads.unionByName(others).drop("blocks").join(texts, "node")
    order = ("key", "block", "is_other")
    columns = [*order, "node", "root", "main", "keys", "digest", "text"]

    def rows_of(batches):
        for b in batches:
            small = list(zip(*(b.column(i).to_pylist() for i in range(6))))
            keys, digests = (b.column(i).flatten().to_numpy().reshape(len(small), -1) for i in (6, 7))
            digests = np.ascontiguousarray(digests).view(np.uint8)
            for at, texts_ in column_chunks(b.column(8)):
                for k, t in enumerate(texts_, at):
                    yield *small[k], keys[k], digests[k], t

    def run(batches):
        found, block, within = [], None, None
        for key, number, is_other, node, root, main, keys, digest, text in rows_of(batches):
            if within != (key, number):
                block, within = Block(key, percent), (key, number)
            if not is_other:
                block.add(node, root, shingles(text, shingle), keys, digest)
            elif block.nodes:
                found += block.links(node, root, main, text, shingle, keys, digest)
            if len(found) >= 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    together = sent.select(*columns).repartition("key", "block").sortWithinPartitions(*order)
    return written(together.mapInArrow(run, "a long, b long").distinct(), "across")


def grouped_nodes(rows: DataFrame, nodes: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """(node, root) of the nodes that pairs of at least ``percent`` similarity join into components."""
    index = nodes.select("node", F.explode("keys").alias("key"))
    shared = index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    members = written(index.join(shared.select("key"), "key").select("key", "node"), "buckets")
    return grouped(members, lambda pairs: verified(pairs, rows, nodes, shingle, percent),
                   lambda apart: across(apart, rows, nodes, shingle, percent))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable doc_id) and kept of every row."""
    rows = sketched(docs, shingle)
    nodes = written(rows.filter("node is not null").groupBy("node").agg(
        F.min("at").alias("at"), F.min("doc_id").alias("first_id"),
        F.any_value("keys").alias("keys")), "nodes")
    roots = grouped_nodes(rows, nodes, shingle, percent).withColumnRenamed("node", "of")
    placed = written(nodes.join(roots, F.col("node") == F.col("of"), "left")
                     .select("node", F.coalesce("root", "node").alias("root"), "first_id"), "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(smallest, "root").select(F.col("node").alias("of"), "component_id")
    linked = rows.filter("node is not null").join(classes, F.col("node") == F.col("of")).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
