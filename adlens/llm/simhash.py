"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is read as eight positional bytes. Two fingerprints within ``max_bits`` <= 2
differ in at most two of them. Postings of a single byte hold 1/256 of the corpus, and
tallying pairs over them grows with its square; the index therefore has the positional
bytes five at a time: its ``KEYS`` are 21 choices of five positions, such that any two
positions are left out together by at least two of them. So linked fingerprints share at
least ``MIN_SHARED`` = 2 keys, the guaranteed minimum of the count filter, while pairs with
exactly five equal bytes share at most one and go by their count alone. Pairs that reach the
count are verified by their bit distance.

Equal fingerprints are one node, so copies cost nothing. Pairs that meet in a posting are
not listed: see ``components.grouped``, which is the same for postings of any size.

Defined results: null or blank texts have fingerprint zero, which links like any other;
null ids take part under their fingerprint and never are the smallest id (a component
without any id has a null one); repeated rows return once each; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlens.llm.common import hex16, written
from adlens.llm.components import grouped

SEED = 42
#: The byte positions that each key leaves out. Of positions 0 to 6 every two are together in one line of
#: either plane of seven points; position 7 is with each of them twice.
LEFT_OUT = ([tuple((i + k) % 7 for k in line) for line in ((0, 1, 3), (0, 2, 3)) for i in range(7)]
            + [(7, i, (i + 1) % 7) for i in range(7)])
MIN_SHARED = 2
_HASHES_AT_ONCE = 1 << 18
_MARK = "hash of the text"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    form, digest = b" ".join([b"%b"] * shingle), xxhash.xxh64_intdigest
    if len(words) < shingle:
        n, counts = 1, _bits([digest(b" ".join(words), SEED)])
    else:
        n, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
        for s in range(0, n, _HASHES_AT_ONCE):
            some = words[s:s + _HASHES_AT_ONCE + shingle - 1]
            counts += _bits([digest(form % t, SEED) for t in zip(*(some[k:] for k in range(shingle)))])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _bits(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp of every row, written once."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(run, "doc_id long, text_hash long, fp long"), "fingerprints")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _kept_bytes(left_out: tuple[int, ...]) -> int:
    """The bits of all byte positions but ``left_out``, as a signed 64-bit mask."""
    return int(np.uint64(sum(0xFF << 8 * i for i in range(8) if i not in left_out)).astype(np.int64))


def shared_keys(a: Column, b: Column) -> Column:
    """Tally of the keys (five positional bytes each) that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum(F.when(x.bitwiseAND(F.lit(_kept_bytes(t))) == 0, 1).otherwise(0) for t in LEFT_OUT)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node) of the keys that several of the distinct fingerprints ``fp`` have."""
    fp = F.col("fp")
    keys = F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(_kept_bytes(t)))) for k, t in enumerate(LEFT_OUT)))
    index = nodes.select("fp", F.explode(keys).alias("key"))
    several = index.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("key")
    return written(index.join(several, "key").select("key", F.col("fp").alias("node")), "postings")


def roots(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(node, root) of the distinct fingerprints of ``nodes`` (fp) that links join into components."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees matches for at most two differing bits")
    near = lambda a, b: (shared_keys(a, b) >= MIN_SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)

    def across(apart: DataFrame) -> DataFrame:
        p, q = apart.filter("root <> main").alias("p"), apart.alias("q")
        c = F.col
        pairs = p.join(q, (c("p.key") == c("q.key")) & (c("p.root") != c("q.root")) & near(c("p.node"), c("q.node"))
                       & ((c("q.root") == c("q.main")) | (c("p.node") < c("q.node"))))
        return pairs.select(c("p.node").alias("a"), c("q.node").alias("b")).distinct()

    return grouped(postings(nodes), lambda pairs: pairs.filter(near(F.col("a"), F.col("b"))), across)


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """fp, root and component_id (smallest reachable doc_id) of every fingerprint, and its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "text_hash"))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first.alias("first")), "nodes")
    found = roots(nodes.select("fp"), max_bits)
    placed = written(nodes.join(found, nodes.fp == found.node, "left")
                     .select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "first"), "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first").alias("representative"))
    return placed.join(smallest, "root").select("fp", "root", "component_id", "representative")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id (smallest reachable doc_id) of every row."""
    rows = fingerprints(docs, shingle)
    classes = _classes(rows, max_bits).select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group.

    It is the first by doc_id (rows without an id last), fingerprint and hash of the text, so
    rows that share an id but not the text are documents of their own, as are rows without
    one. Of rows with the same id and text one stays.
    """
    rows = fingerprints(docs, shingle)
    keep = written(_classes(rows, max_bits).select("representative.*").distinct()
                   .select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")), "kept")
    marked = docs.withColumn(_MARK, _text_hash())
    return (marked.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["kept_id"]) & (marked[_MARK] == keep["kept_hash"]), "left_semi")
            .dropDuplicates(["doc_id", _MARK]).drop(_MARK))
