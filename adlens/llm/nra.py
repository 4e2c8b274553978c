"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

The documents' counts of the queried terms are written once; document counts, lengths and
document frequencies are sums over all of them. Then every task takes its documents in
shards, sorts each term's postings in a shard by impact (what the term adds to the score),
and reads the lists of a query's terms side by side from the top, in growing steps. What was
read of a document is the lower bound of its score; with the last impact read of each list
that it was not met in yet, the upper bound. A document whose upper bound is under the k-th
best lower bound is out. Reading ends when no unmet document can come in and all documents
that are not out have equal bounds: membership, ties and scores are then final. The k-th
best score of a task's earlier shards is a lower bound for the later ones, which so end
sooner. Tasks return at most k documents a query; a window ranks them.

Queries are taken in blocks of at most ``BLOCK_TERMS`` term occurrences (one query at
least), which bounds what is broadcast; each block is one pass over the documents. No
posting is ever shuffled, so a frequent term costs no task more than its own documents.

Defined results: null texts have no terms; documents without terms are not counted and
never found; queries without terms, or whose terms no document holds, return nothing; equal
scores go by ascending doc_id, null ids last; repeated rows are documents of their own, and
rows that repeat a query's id are queries of their own; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adlens.llm.common import column_chunks, written

K = 20
BLOCK_TERMS = 1 << 20
SHARD_DOCS = 8192
FIRST_READ = 128
#: Groups of tasks whose documents are ranked together before the last ranking.
MERGE_GROUPS = 64
#: Terms are maximal runs of these bytes (all of UTF-8's above ASCII), upper-case ASCII letters lowered.
_TERM_BYTES = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def blocks(queries: DataFrame, id_column: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(id, terms) of the queries, in lists of at most ``BLOCK_TERMS`` occurrences."""
    block, size = [], 0
    rows = queries.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        own = terms(row["text"])
        if not own:
            continue
        if block and size + len(own) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["id"], own))
        size += len(own)
    if block:
        yield block


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), codes and tfs of the vocabulary's terms, of each document with terms; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        code = {t: i for i, t in enumerate(shared.value)}.get
        for b in batches:
            for at, texts in column_chunks(b.column("text")):
                n, codes, tfs = [], [], []
                for t in texts:
                    own = terms(t)
                    ids, tf = np.unique(np.fromiter(map(code, own, repeat(-1)), np.int32, len(own)), return_counts=True)
                    known = int(len(ids) > 0 and ids[0] < 0)
                    n.append(len(own))
                    codes.append(ids[known:])
                    tfs.append(tf[known:])
                ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (codes, tfs)]
                yield pa.record_batch([b.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), *lists],
                                      ["doc_id", "n", "codes", "tfs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>").filter("n > 0"), "counted")


class Shard:
    """The impact-sorted lists of some documents."""

    def __init__(self, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((-impact, code))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(code[order], np.arange(n_terms + 1))

    def best(self, codes: list[int], times: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the shard's documents that may be among the k best with at least ``least``; scores are final."""
        lists = [(self.doc[a:b], self.impact[a:b] * t) for c, t in zip(codes, times)
                 if (a := self.starts[c]) < (b := self.starts[c + 1])]
        lower, depth, step = np.zeros(self.n_docs, np.int64), 0, FIRST_READ
        while True:
            for doc, impact in lists:
                lower[doc[depth:depth + step]] += impact[depth:depth + step]
            depth, step = depth + step, depth + step
            heads = [int(impact[depth - 1]) if depth < len(doc) else 0 for doc, impact in lists]
            if self.n_docs > k:
                least = max(least, int(np.partition(lower, self.n_docs - k)[self.n_docs - k]))
            unmet = sum(heads)
            if not unmet:
                break
            if unmet >= least:  # a document that was not met yet could come in
                continue
            rest = np.full(self.n_docs, unmet, np.int64)  # upper less lower bound
            for (doc, _), head in zip(lists, heads):
                if head:
                    rest[doc[:depth]] -= head
            if not rest[lower + rest >= least].any():
                break
        found = np.flatnonzero(lower >= least)
        return found, lower[found]


def _best(ids, missing, scores, k: int):
    """The k best of (doc_id, whether it is null, score), best first."""
    order = np.lexsort((ids, missing, -scores))[:k]
    return ids[order], missing[order], scores[order]


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    vocabulary = sorted({t for _, own in block for t in own})
    code = {t: i for i, t in enumerate(vocabulary)}
    items = [tuple(x.tolist() for x in np.unique([code[t] for t in own], return_counts=True)) for _, own in block]
    rows = counted(docs, vocabulary)
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    N, L = total["docs"], total["terms"]
    weight = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row per queried term at most
        weight[r["code"]] = math.floor(1000 * math.log((2 * N + 2) / (2 * r["count"] + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        queries, w = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)
        for b in batches:
            for first in range(0, b.num_rows, SHARD_DOCS):
                part = b.slice(first, SHARD_DOCS)
                names = part.column("doc_id")
                missing = np.asarray(names.is_null().to_numpy(zero_copy_only=False), bool)
                ids = names.fill_null(0).to_numpy(zero_copy_only=False)
                codes, tfs = part.column("codes"), part.column("tfs").flatten().to_numpy().astype(np.int64)
                sizes = np.diff(codes.offsets.to_numpy())
                code_ = codes.flatten().to_numpy()
                m = 75 + 25 * part.column("n").to_numpy() * N // L
                impact = w[code_] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, sizes)))
                some = impact > 0
                shard = Shard(np.repeat(np.arange(len(ids)), sizes)[some], code_[some], impact[some], len(ids), len(w))
                for q, (own, times) in enumerate(queries):
                    old = best[q]
                    found, scores = shard.best(own, times, k, int(old[2][-1]) if len(old[2]) == k else 1)
                    if len(found):
                        best[q] = _best(*(np.concatenate(x) for x in zip(old, (ids[found], missing[found], scores))), k)
        for q, (ids, missing, scores) in enumerate(best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), q)), pa.array(ids, mask=missing), pa.array(scores)],
                                      ["item", "doc_id", "score"])

    found = (rows.mapInArrow(run, "item long, doc_id long, score long")
             .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))))
    top = _ranked(_ranked(found, k, "item", "part"), k, "item")
    names = docs.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "item long, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as the block has queries


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_column: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents of every query."""
    out = None
    for block in blocks(queries, id_column):
        one = _search_block(docs, block, k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
