"""Homomorphic multiset fingerprints of documents, modular sums of wide hashed vectors.

A document is the multiset of its paragraphs (runs between line feeds). Each paragraph is
hashed to a wide vector and the fingerprint is the sum of these vectors, modulo 2^16 or 2^32
by lane, so it does not depend on the order of paragraphs, equal multisets give equal
fingerprints, and paragraphs are inserted or deleted by adding or subtracting their vector.

The vector has two parts. ``EQUAL`` lanes are uniform (an extendable hash of the paragraph)
and count modulo 2^16: two different multisets agree on them with chance 2^-(16 EQUAL).
``LIKE`` lanes are sums of random signs, one vector per word shingle of the paragraph: the
cosine of two sums estimates that of the shingle multisets, so edits show as a likeness between
0 and 1 (standard error about LIKE^-1/2). They count modulo 2^32 and are read as signed: a text
of at most 2^31 bytes has at most 2^30 shingles, so they never wrap. Likeness is exactly 1 for
equal fingerprints.

The edited text of a document takes its last half from the next document in the order of
doc_id, hash of the text and text. Documents are dealt to ranges of that order, so rows that
share an id, or have none, spread as well; where ranges begin is found on the narrow (id,
hash) alone. The first document of each range is also sent to the range before it, so every
row finds its next one in its own task, in one shuffle of the texts. A range is streamed,
one document ahead. There are as many ranges as the cluster has use for, and their starts
travel as two arrays of that length.

Defined results: a null text is empty; null doc_ids come first; rows of one doc_id are
ordered by the hash of their text, each the next of the one before; an empty text has the zero
fingerprint, alike (1) only to zero; a single document is its own next one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlens.llm.common import partitions_for, written

EQUAL = 32
LIKE = 128          # the width of the hash in bits
SHINGLE = 3
LANES = EQUAL + LIKE
_READ = np.array([0xFFFF] * EQUAL + [0xFFFFFFFF] * LIKE, np.uint32)  # the bits of a lane that count
ROWS_PER_RANGE = 8192
LOWEST = -(1 << 63)  # stands for a null id
_START = np.dtype([("key", "<i8"), ("hash", "<i8")])
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def vectors(paragraphs: list[str]) -> np.ndarray:
    """The sum, modulo 2^32, of the vectors of ``paragraphs``; of EQUAL lanes the lower 16 bits are read."""
    total = np.zeros(LANES, np.uint32)
    if paragraphs:
        raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=2 * EQUAL).digest() for p in paragraphs])
        total[:EQUAL] = np.frombuffer(raw, "<u2").reshape(-1, EQUAL).sum(axis=0, dtype=np.uint32)
    for raws in _shingle_hashes(paragraphs):
        bits = np.unpackbits(np.frombuffer(b"".join(raws), np.uint8).reshape(-1, LIKE // 8), axis=1)
        signs = 2 * bits.sum(axis=0, dtype=np.int64) - len(raws)
        total[EQUAL:] += (signs & 0xFFFFFFFF).astype(np.uint32)
    return total


def _shingle_hashes(paragraphs: list[str]):
    """Hashes of the paragraphs' word shingles (all words of a shorter paragraph), a bounded number at a time."""
    import xxhash
    digest, form, out = xxhash.xxh3_128_digest, b" ".join([b"%b"] * SHINGLE), []
    for p in paragraphs:
        words = p.encode("utf-8", "surrogatepass").split()
        if len(words) < SHINGLE:
            out += [digest(b" ".join(words))] if words else []
        for s in range(0, len(words) - SHINGLE + 1, 1 << 17):
            some = words[s:s + (1 << 17) + SHINGLE - 1]
            out += [digest(form % t) for t in zip(*(some[k:] for k in range(SHINGLE)))]
            if len(out) > 1 << 17:
                yield out
                out = []
    if out:
        yield out


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def fingerprint(text: str) -> np.ndarray:
    return vectors(paragraphs(text))


def insert(print_: np.ndarray, added: list[str]) -> np.ndarray:
    return print_ + vectors(added)


def delete(print_: np.ndarray, gone: list[str]) -> np.ndarray:
    return print_ - vectors(gone)


def to_hex(print_: np.ndarray) -> str:
    return print_[:EQUAL].astype(">u2").tobytes().hex() + print_[EQUAL:].astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the estimated cosine of the shingle multisets, at least 0 and below 1."""
    if not ((a - b) & _READ).any():
        return 1.0
    x, y = a[EQUAL:].astype(np.int32).astype(float), b[EQUAL:].astype(np.int32).astype(float)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / norm, 0.0), 1.0 - 1e-9) if norm else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_print(own: np.ndarray, text: str, following: str) -> np.ndarray:
    """The fingerprint of the edited text by deletion and insertion of what the edit touches."""
    half = len(text) // 2
    if not half:
        return own
    keep = text.rfind("\n", 0, len(text) - half) + 1  # paragraphs before this place stay as they are
    new = text[keep:len(text) - half] + following[:half]
    return insert(delete(own, paragraphs(text[keep:])), paragraphs(new))


# --- next documents -----------------------------------------------------------------------

def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """range, ahead, key, doc_id, text: each range holds its rows and, as ``ahead``, the first of the next one."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.xxhash64(text).alias("hash"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ids = written(rows.select("key", "hash"), "order")
    n = ids.count()
    parts = max(partitions_for(spark, n, rows_per_range), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    ranged = ids.repartitionByRange(parts, "key", "hash")
    firsts = sorted((r["first"]["key"], r["first"]["hash"]) for r in  # a row per range
                    ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "hash")).alias("first")).collect())
    starts = spark.sparkContext.broadcast(np.array(firsts, _START))

    def place(key: pa.Array, hash_: pa.Array) -> pa.Array:
        at = np.empty(len(key), _START)
        at["key"], at["hash"] = key.to_numpy(zero_copy_only=False), hash_.to_numpy(zero_copy_only=False)
        own = np.searchsorted(starts.value, at, side="right") - 1
        first = starts.value[own] == at
        before = np.where(own == 0, len(starts.value) - 1, own - 1)  # the first row of all is next to the last one
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(before, pa.int32(), mask=~first)], ["own", "before"])

    placed = rows.withColumn("at", F.arrow_udf(place, "own int, before int")("key", "hash"))
    here = F.struct(F.col("at.own").alias("range"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.col("at.before").alias("range"), F.lit(1).alias("ahead"))
    to = F.when(F.col("at.before").isNull(), F.array(here)).otherwise(F.array(here, ahead))
    return (placed.select("key", "hash", "doc_id", "text", F.explode(to).alias("to"))
            .select(F.col("to.range").alias("range"), F.col("to.ahead").alias("ahead"), "key", "doc_id", "text", "hash")
            .repartitionById(max(1, len(firsts)), F.col("range"))
            .sortWithinPartitions("range", "ahead", "key", "hash", "text"))


def document_fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    def compare(here, following):
        (doc_id, text, own), (_, next_text, next_own) = here, following
        new = edited_print(own, text, next_text)
        sha = hashlib.sha256(edited(text, next_text).encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, to_hex(own), to_hex(new), likeness(own, new), likeness(own, next_own)

    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def table(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        last, within = None, None
        for b in batches:
            out = []
            ranges, ahead, ids = (b.column(i).to_pylist() for i in (0, 1, 3))
            for r, a, i, text in zip(ranges, ahead, ids, b.column(4)):
                if a and (last is None or r != within):
                    continue  # the range is done: further rows ahead are ties of the first one
                text = text.as_py()
                here = (i, text, fingerprint(text))
                if last is not None:
                    out.append(compare(last, here))
                last, within = (None, None) if a else (here, r)
            if out:
                yield table(out)
        if last is not None:
            raise ValueError("a range has no row ahead")

    return with_next(docs, rows_per_range).mapInArrow(run, _OUT)
