"""Token files coded with a static range asymmetric numeral system.

Every text is encoded, an end id appended, and the ids of all documents in ascending
doc_id order are one stream. One frequency table, counted over the whole corpus, is shared
by all blocks. A block codes up to ``BLOCK`` ids with ``LANES`` interleaved states (id ``i``
belongs to lane ``i`` modulo lanes), so a numpy step codes one id of every lane of every
block of a frame. Blocks are independent: each stores the lane states and the place in its
words at checkpoints every ``CHECKPOINT`` steps, from which it can be decoded in parallel,
and a crc32 of its ids that the reader checks.

Files: ``table`` holds the frequency table, ``frames`` records of whole documents: the
shard (one range of doc_ids), the first id's place in the shard, the documents' ids and
lengths, and the blocks. Records are bounded by ``FRAME`` ids (or one document), files by
``FRAMES_PER_FILE`` records.

Scale: ids are encoded once into a written table; counting combines per task; one range
shuffle orders the stream; coding and decoding need no further shuffle. A shard's first
place is a prefix sum over one row per shard.

Defined results: null texts are empty (the end id alone); null doc_ids come first; rows of
one doc_id are ordered by crc32 and ids of their tokens; an empty table gives empty files
and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from adlens.llm.common import CHUNK_CHARS, column_chunks, framed, partitions_for, records, shared_path, write_records, written
from adlens.llm.tokens import encoder, ids_crc32

LANES = 128
BLOCK = 1 << 16
CHECKPOINT = 256
FRAME = 1 << 20
FRAMES_PER_FILE = 8
SHARD_TOKENS = 4 << 20
LOW = np.uint64(1 << 31)       # states stay in [2^31, 2^63), words have 32 bits
MAGIC_FRAME, MAGIC_TABLE = b"RNF1", b"RNT1"
_COUNTS = np.dtype([("id", "<u4"), ("n", "<u8")])


# --- the shared table ---------------------------------------------------------------------

class Table:
    """Symbols with frequencies that add up to 2^bits, each at least one."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.freqs, self.bits = symbols.astype("<u4"), freqs.astype("<u4"), bits
        self.freq = freqs.astype(np.uint64)
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self._slots = self._places = None

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> "Table":
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        bits = max(16, int(np.ceil(np.log2(max(2, len(symbols))))) + 4)
        freqs = np.maximum(1, np.floor(counts * (1 << bits) / counts.sum())).astype(np.int64)
        spare = (1 << bits) - int(freqs.sum())
        by_size = np.argsort(-freqs, kind="stable")
        if spare > 0:
            freqs[by_size[0]] += spare
        for i in by_size if spare < 0 else ():  # the ones raised to one took from the most frequent
            take = min(int(freqs[i]) - 1, -spare)
            freqs[i] -= take
            spare += take
            if not spare:
                break
        return cls(symbols, freqs, bits)

    def rank(self, ids: np.ndarray) -> np.ndarray:
        if self._places is None:
            self._places = np.zeros(int(self.symbols.max()) + 1, np.int32)
            self._places[self.symbols] = np.arange(len(self.symbols))
        return self._places[ids]

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freqs), dtype=np.int32), self.freqs)
        return self._slots

    def to_bytes(self) -> bytes:
        body = struct.pack("<BI", self.bits, len(self.symbols)) + self.symbols.tobytes() + self.freqs.tobytes()
        return MAGIC_TABLE + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw) -> "Table":
        raw = bytes(raw)
        if raw[:4] != MAGIC_TABLE or struct.unpack_from("<I", raw, 4)[0] != zlib.crc32(raw[8:]):
            raise ValueError("damaged frequency table")
        bits, n = struct.unpack_from("<BI", raw, 8)
        return cls(np.frombuffer(raw, "<u4", n, 13), np.frombuffer(raw, "<u4", n, 13 + 4 * n).astype(np.int64), bits)


# --- blocks -------------------------------------------------------------------------------

def _encode_equal(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of equal length, coded side by side; ``ids`` is [block, id]."""
    k, n = ids.shape
    steps = -(-n // LANES)
    padded = np.zeros((k, steps * LANES), np.int32)
    padded[:, :n] = table.rank(ids)
    padded[:, n:] = int(np.argmax(table.freq))
    sym = padded.reshape(k, steps, LANES).transpose(1, 0, 2)
    x = np.full((k, LANES), LOW, np.uint64)
    words, out = np.empty((steps, k, LANES), np.uint32), np.empty((steps, k, LANES), bool)
    marks = -(-steps // CHECKPOINT)
    states = np.empty((marks, k, LANES), np.uint64)
    bits, top, half = np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[sym[t]], table.first[sym[t]]
        full = x >= (f << top)
        words[t], out[t] = x.astype(np.uint32), full
        x = np.where(full, x >> half, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT] = x
    emitted = out.sum(axis=2)
    blocks = []
    for b in range(k):
        before = np.concatenate([[0], np.cumsum(emitted[:, b])])
        at = before[np.arange(marks) * CHECKPOINT].astype("<u4")
        body = words[:, b][out[:, b]].astype("<u4").tobytes()
        head = struct.pack("<IIHI", n, len(body) // 4, marks, ids_crc32(ids[b]))
        blocks.append(head + at.tobytes() + states[:, b].astype("<u8").tobytes() + body)
    return blocks


def encode_blocks(ids: np.ndarray, table: Table) -> bytes:
    """All blocks of a run of ids, their number first."""
    whole = len(ids) // BLOCK
    blocks = _encode_equal(ids[:whole * BLOCK].reshape(whole, BLOCK), table) if whole else []
    if len(ids) % BLOCK:
        blocks += _encode_equal(ids[whole * BLOCK:][None, :], table)
    return struct.pack("<I", len(blocks)) + b"".join(blocks)


def decode_blocks(raw: memoryview, table: Table) -> np.ndarray:
    """The ids of :func:`encode_blocks`; every checkpoint of every block is decoded side by side."""
    count, = struct.unpack_from("<I", raw, 0)
    at, heads, starts, states, body, base = 4, [], [], [], [], 0
    for _ in range(count):
        n, words, marks, crc = struct.unpack_from("<IIHI", raw, at)
        at += 14
        starts.append(np.frombuffer(raw, "<u4", marks, at).astype(np.int64) + base)
        at += 4 * marks
        states.append(np.frombuffer(raw, "<u8", marks * LANES, at).reshape(marks, LANES))
        at += 8 * marks * LANES
        body.append(np.frombuffer(raw, "<u4", words, at))
        at += 4 * words
        heads.append((n, marks, crc))
        base += words
    if not heads:
        return np.zeros(0, np.uint32)
    words = np.concatenate([*body, np.zeros(LANES, "<u4")]).astype(np.uint64)
    place, x = np.concatenate(starts), np.concatenate(states).astype(np.uint64)
    left = np.concatenate([np.minimum(CHECKPOINT, -(-n // LANES) - np.arange(m) * CHECKPOINT) for n, m, _ in heads])
    sym = np.zeros((CHECKPOINT, len(x), LANES), np.int32)
    slots, mask = table.slots(), np.uint64((1 << table.bits) - 1)
    bits, half = np.uint64(table.bits), np.uint64(32)
    order = np.argsort(-left, kind="stable")  # parts with steps left come first
    x, place, sorted_left = x[order], place[order], left[order]
    for t in range(int(left.max())):
        live = int(np.searchsorted(-sorted_left, -t, side="left"))
        y = x[:live]
        slot = y & mask
        s = slots[slot]
        sym[t, :live] = s
        y = table.freq[s] * (y >> bits) + slot - table.first[s]
        need = y < LOW
        take = need.cumsum(axis=1)
        word = words[np.minimum(place[:live, None] + take - 1, len(words) - 1)]
        x[:live] = np.where(need, (y << half) | word, y)
        place[:live] += take[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    sym, out, part = sym[:, back], [], 0
    for n, marks, crc in heads:
        ids = table.symbols[sym[:, part:part + marks].transpose(1, 0, 2).reshape(-1)[:n]]
        if ids_crc32(ids) != crc:
            raise ValueError("block fails its checksum")
        out.append(ids)
        part += marks
    return np.concatenate(out)


# --- files --------------------------------------------------------------------------------

def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian bytes of the encoder's width), n_tokens, ids_crc32 of every row; written once.

    Each task adds one row that has only ``counts``: how often it met each id (32-bit id, 64-bit number).
    """
    names = ["doc_id", "ids", "n_tokens", "ids_crc32", "counts"]

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        total = np.zeros(0, np.int64)
        for b in batches:
            for at, texts in column_chunks(b.column("text"), 8 * CHUNK_CHARS):
                raws = [r + end for r in enc.encode(texts)]
                c = np.bincount(np.frombuffer(b"".join(raws), enc.dtype))
                n = max(len(c), len(total))
                total = np.pad(total, (0, n - len(total))) + np.pad(c, (0, n - len(c)))
                yield pa.record_batch([
                    b.column("doc_id").slice(at, len(raws)), pa.array(raws, pa.binary()),
                    pa.array([len(r) // enc.dtype.itemsize for r in raws], pa.int64()),
                    pa.array([ids_crc32(enc.ids(r)) for r in raws], pa.int64()), pa.nulls(len(raws), pa.binary())], names)
        met = np.flatnonzero(total)
        packed = np.rec.fromarrays([met, total[met]], dtype=_COUNTS).tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                               pa.array([packed], pa.binary())], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_crc32 long, counts binary"), "tokens")


def counts(rows: DataFrame) -> DataFrame:
    """id, n over all rows of :func:`token_rows`, from the sums of its tasks."""
    def run(batches):
        for b in batches:
            for packed in b.column("counts").to_pylist():
                own = np.frombuffer(packed, _COUNTS)
                yield pa.record_batch([pa.array(own["id"].astype(np.int64)), pa.array(own["n"].astype(np.int64))], ["id", "n"])

    met = rows.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long")
    return met.groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write the token files of ``docs`` under ``path``."""
    spark = docs.sparkSession
    rows = token_rows(docs, tokenizer, end_id)
    table_rows = counts(rows).collect()  # one row per id of the vocabulary at most
    if not table_rows:
        return
    table = Table.of_counts(np.array([r["id"] for r in table_rows]), np.array([r["n"] for r in table_rows]))
    saved = table.to_bytes()
    write_records(spark.createDataFrame([(bytearray(framed(saved)),)], "record binary"), "record", f"{path}/table", 1)
    shards = partitions_for(spark, sum(r["n"] for r in table_rows), SHARD_TOKENS)
    shared = spark.sparkContext.broadcast(saved)

    def run(batches):
        from pyspark import TaskContext
        own, dtype = Table.from_bytes(shared.value), encoder(tokenizer).dtype
        shard, first = TaskContext.get().partitionId(), 0

        def frame(ids, raws):
            flat = np.frombuffer(b"".join(raws), dtype).astype("<u4")
            have = np.array([i is not None for i in ids], "u1")
            head = MAGIC_FRAME + struct.pack("<IQI", shard, first, len(ids))
            names = np.array([i or 0 for i in ids], "<i8").tobytes() + have.tobytes()
            sizes = np.array([len(r) // dtype.itemsize for r in raws], "<u4").tobytes()
            body = framed(head + names + sizes + encode_blocks(flat, own))
            return pa.record_batch([pa.array([body], pa.binary())], ["record"]), len(flat)

        ids, raws, size = [], [], 0
        for b in batches:
            for i, r in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                n = len(r) // dtype.itemsize
                if ids and size + n > FRAME:
                    out, done = frame(ids, raws)
                    yield out
                    ids, raws, size, first = [], [], 0, first + done
                ids.append(i)
                raws.append(r)
                size += n
        if ids:
            yield frame(ids, raws)[0]

    ordered = (rows.filter("counts is null").repartitionByRange(shards, "doc_id", "ids_crc32")
               .sortWithinPartitions("doc_id", "ids_crc32", "ids").select("doc_id", "ids"))
    write_records(ordered.mapInArrow(run, "record binary"), "record", f"{path}/frames", FRAMES_PER_FILE)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32-bit) of every document of token files."""
    shape = "doc_id long, shard long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    try:
        saved = [bytes(r) for f in _files(spark, f"{path}/table").collect() for r in records(f["content"])]
    except Exception as e:  # nothing was written for an empty table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], shape).drop("shard")
    shared = spark.sparkContext.broadcast(saved[0])

    def run(batches):
        table = Table.from_bytes(shared.value)
        for b in batches:
            for content in b.column("content"):
                for raw in records(content.as_py()):
                    yield decode_frame(raw, table, with_ids)

    rows = _files(spark, f"{path}/frames").mapInArrow(run, shape)
    rows = written(rows, "decoded")
    per = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    base = per.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")


def decode_frame(raw: memoryview, table: Table, with_ids: bool) -> pa.RecordBatch:
    if bytes(raw[:4]) != MAGIC_FRAME:
        raise ValueError("not a frame")
    shard, first, n = struct.unpack_from("<IQI", raw, 4)
    at = 20
    names, have = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "u1", n, at + 8 * n)
    sizes = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    ids = decode_blocks(raw[at + 13 * n:], table)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cols = [pa.array(names, mask=have == 0), pa.array(np.full(n, shard, np.int64)), pa.array(starts + first),
            pa.array(sizes), pa.array([ids_crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())]
    names_ = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()))
        names_.append("ids")
    return pa.record_batch(cols, names_)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    path = path or shared_path(docs.sparkSession, "token-files")
    write_files(docs, tokenizer, end_id, path)
    return read_files(docs.sparkSession, path)
