"""Exact nearest neighbours by a block matrix join with int8 tiles and error bounds.

Vectors are packed into blocks of up to ``BLOCK`` rows as they are scanned: int8 codes
with one scale per vector, the norms of the coded vector and of its rounding error, and
the float originals. Query blocks are sent to every group of candidate blocks and meet
them by an equi-join on the group, so each pair of blocks is one tile and one row.

In a tile the int8 product gives every inner product up to a bound: with x = s q + e the
error is at most ``s|q| |f| + |e| s'|q'| + |e| |f|``. A pair survives if its upper bound
reaches the k-th largest lower bound of its query in the tile; survivors are recomputed in
double precision on the original vectors and a heap of k per query leaves the tile. The
heaps of one query block against the blocks of a group are merged in the task, and those of
the groups by a top-k window that cuts each task's rows to k before the shuffle.
Nothing that could be among the k nearest is ever dropped, so recall is 1.

Scale: blocks are bounded rows; a task holds one tile, the heaps of one query block and the
blocks of one group (about ``BLOCKS_PER_GROUP``); the queries are a stated set, sent once to
each group.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component
take no part; so do rows without an id; only vectors of one length are compared; repeated
rows are candidates of their own, but rows with the query's own id never are, and a query id with
several vectors is asked once, with the smallest of them; ties go to the smaller vec_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.llm.common import partitions_for, written

BLOCK = 2048
BLOCKS_PER_GROUP = 32
_BLOCKS = "dim int, n int, ids binary, codes binary, numbers binary, vectors binary"


def usable(vec_id: Column, vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (vec_id.isNotNull() & vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))
            & F.exists(vector, lambda x: x != 0))


def quantise(v: np.ndarray):
    """int8 codes, and per vector: scale, norm of scale * codes, norm of the rounding error."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a subnormal vector: its codes are zero and the error is all of it
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, np.column_stack([scale, np.linalg.norm(coded, axis=1), np.linalg.norm(v - coded, axis=1)])


def blocks(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Blocks of the usable rows (vec_id, embedding), one per row; no shuffle."""
    def pack(dim, ids, values):
        v = np.array(values, np.float64).reshape(-1, dim)
        codes, numbers = quantise(v)
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                                *(pa.array([x.tobytes()], pa.binary()) for x in
                                  (np.array(ids, "<i8"), codes, numbers, v))],
                               ["dim", "n", "ids", "codes", "numbers", "vectors"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                v = v.values.to_numpy()
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == rows:
                    yield pack(len(v), *held.pop(len(v)))
        for dim, (ids, values) in held.items():
            yield pack(dim, ids, values)

    good = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(usable(F.col("vec_id"), F.col("embedding"))))
    return good.mapInArrow(run, _BLOCKS)


def _block(dim, n, ids, codes, numbers, vectors):
    return (np.frombuffer(ids, "<i8"), np.frombuffer(codes, np.int8).reshape(n, dim),
            np.frombuffer(numbers, np.float64).reshape(n, 3), np.frombuffer(vectors, np.float64).reshape(n, dim))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equal rows, summed in component order in double precision."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tile(queries, candidates, k: int):
    """Query ids, candidate ids and scores of the k best candidates of each query of one tile."""
    qi, qc, qn, qv = queries
    ci, cc, cn, cv = candidates
    product = qc.astype(np.float32) @ cc.astype(np.float32).T  # whole numbers, exact below 2^24
    if qc.shape[1] * 127 * 127 >= 1 << 24:
        product = qc.astype(np.float64) @ cc.astype(np.float64).T
    near = product * (qn[:, :1] * cn[:, 0][None, :])
    bound = (qn[:, 1:2] * cn[:, 2][None, :] + qn[:, 2:3] * (cn[:, 1] + cn[:, 2])[None, :]) * (1 + 1e-9) + 1e-300
    bound += 1e-12 * (qn[:, 1:2] + qn[:, 2:3]) * (cn[:, 1] + cn[:, 2])[None, :]  # rounding of the sums themselves
    low, high = near - bound, near + bound
    own = qi[:, None] == ci[None, :]
    low[own], high[own] = -np.inf, -np.inf
    if len(ci) > k:
        least = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k]
        high = np.where(high >= least[:, None], high, -np.inf)
    q, c = np.nonzero(high > -np.inf)
    score = inner(qv[q], cv[c])
    return best(qi[q], ci[c], score, k)


def best(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` largest scores of each query id, ties to the smaller candidate."""
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[first], candidate[first], score[first]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, groups: int | None = None, rows: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates of largest inner product of each query."""
    spark = vectors.sparkSession
    names = ("dim", "n", "ids", "codes", "numbers", "vectors")
    n = vectors.select("vec_id").count()
    c = written(blocks(vectors.coalesce(partitions_for(spark, n, rows)), rows), "blocks")
    asked = (vectors.filter(is_query).filter(usable(F.col("vec_id"), F.col("embedding"))).groupBy("vec_id")
             .agg(F.min("embedding").alias("embedding")))
    asked = written(asked, "queries")
    q = written(blocks(asked.repartition(partitions_for(spark, asked.count(), rows)), rows), "query-blocks")
    made = max(1, c.count())
    groups = groups or min(made, max(int(spark.conf.get("spark.sql.shuffle.partitions")), made // BLOCKS_PER_GROUP))
    c = c.withColumn("group", F.pmod(F.xxhash64("ids", "codes"), F.lit(groups)))
    used = c.select("group", F.col("dim").alias("q_dim")).distinct()
    q = q.select(*(F.col(x).alias(f"q_{x}") for x in names))
    sent = q.join(used, "q_dim").withColumnRenamed("group", "q_group")
    # queries on the left: a merge join then pairs one query block with all blocks of its group in a row
    tiles = sent.join(c, (c["group"] == sent["q_group"]) & (c["dim"] == sent["q_dim"]))

    def run(batches):
        block, heap = None, None
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for r in range(b.num_rows):
                x = [col[r].as_py() for col in cols]
                found = tile(_block(*x[6:]), _block(*x[:6]), k)
                if block == x[8]:
                    heap = best(*(np.concatenate(p) for p in zip(heap, found)), k)
                    continue
                if block is not None:
                    yield pa.record_batch([pa.array(p) for p in heap], ["query_id", "vec_id", "score"])
                block, heap = x[8], found
        if block is not None:
            yield pa.record_batch([pa.array(p) for p in heap], ["query_id", "vec_id", "score"])

    heaps = (tiles.select(*names, *(f"q_{x}" for x in names))
             .mapInArrow(run, "query_id long, vec_id long, score double"))
    in_order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (heaps.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
