"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths under a block-diagonal mask). Pieces are placed longest first; of the open
sequences with room in *every* capacity the one is taken with the smallest weighted norm
of what would be left (``rule="norm"``) or the largest weighted dot product of the piece
and the room (``rule="dot"``).

Packing needs lengths only: texts are encoded once, and narrow piece rows (no ids) are
dealt by hash to tasks, which pack ``ITEMS_AT_ONCE`` of them at a time; each such lot leaves
at most a few sequences part full. Nothing is dropped; only documents longer than a
sequence are cut, the short remainder first.

Defined results: a null text is empty (the end id alone); null ids, repeated rows and ties
are packed as rows of their own; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlens.llm.common import CHUNK_CHARS, column_chunks, partitions_for, written
from adlens.llm.tokens import encoder, ids_crc32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
ITEMS_AT_ONCE = 8192
WEIGHTS = (1.0, 0.1, 0.1)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole, or the remainder and full sequences."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document's ids (with ``end_id`` last)."""
    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for at, texts in column_chunks(b.column("text"), 8 * CHUNK_CHARS):
                for i, raw in enumerate(enc.encode(texts), at):
                    tokens = np.append(enc.ids(raw), np.uint32(end_id))
                    out += [(ids[i], k, s, n, ids_crc32(tokens[s:s + n]))
                            for k, (s, n) in enumerate(cut(len(tokens), capacity))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights=WEIGHTS, rule: str = "norm"):
    """Sequence number and offset of each length; lengths must come longest first."""
    cap = np.array(capacities, float)
    w = np.asarray(weights, float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    smallest = int(lengths.min())
    need_least = np.array([smallest, 1, smallest * smallest], float)
    room, number, made = np.empty((64, 3)), np.empty(64, np.int64), 0
    opened = 0
    for i, n in enumerate(lengths.tolist()):
        item = np.array([n, 1.0, float(n) * n])
        if (item > cap).any():
            raise ValueError(f"a piece of {n} tokens exceeds a sequence's capacities {capacities}")
        best = -1
        if opened:
            left = room[:opened] - item
            fits = (left >= 0).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                if rule == "norm":
                    best = at[np.argmin(((left[at] / cap) ** 2) @ w)]
                else:
                    best = at[np.argmax((room[at] / cap) @ (w * item / cap))]
        if best < 0:
            if opened == len(number):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, number])
            best, opened = opened, opened + 1
            room[best], number[best] = cap, made
            made += 1
        bins[i], offsets[i] = number[best], cap[0] - room[best, 0]
        room[best] -= item
        if (room[best] < need_least).any():  # nothing fits any more: close it
            opened -= 1
            room[best], number[best] = room[opened], number[opened]
    return bins, offsets


def pack(items: DataFrame, capacity: int, max_documents: int | None = None, max_attention: int | None = None,
         weights=WEIGHTS, rule: str = "norm", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``items`` (the columns of :func:`pieces`) with ``sequence_id`` and ``offset``."""
    caps = (capacity, max_documents or capacity, max_attention or capacity * capacity)
    items = written(items, "pieces")
    tasks = partitions_for(items.sparkSession, items.count(), items_at_once)
    names = items.columns

    def packed(batches, first):
        t = pa.Table.from_batches(batches)
        t = t.sort_by([("length", "descending"), *((c, "ascending") for c in names if c != "length")])
        lengths = t.column("length").to_numpy()
        alone = rule == "norm" and caps[1] >= 1 and caps[2] >= capacity * capacity  # else best_fit raises
        full = int(np.searchsorted(-lengths, -capacity, side="right")) if alone else 0
        seq, off = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        more, off[full:] = best_fit(lengths[full:], caps, weights, rule)  # full pieces fill a sequence each
        seq[full:] = more + full
        t = t.append_column("sequence_id", pa.array(seq + first, pa.int64()))
        return t.append_column("offset", pa.array(off, pa.int64())).combine_chunks().to_batches(), first + int(seq.max()) + 1

    def run(batches):
        from pyspark import TaskContext
        held, rows, first = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            while b.num_rows:
                some = b.slice(0, items_at_once - rows)
                b = b.slice(some.num_rows)
                held.append(some)
                rows += some.num_rows
                if rows == items_at_once:
                    out, first = packed(held, first)
                    yield from out
                    held, rows = [], 0
        if held:
            yield from packed(held, first)[0]

    dealt = items.repartition(tasks, *names)
    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, **options) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity, **options)
