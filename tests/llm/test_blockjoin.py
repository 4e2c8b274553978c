"""Nearest neighbours against brute force; the int8 bounds."""

import numpy as np
from pyspark.sql import functions as F

from adlens.llm import blockjoin

SHAPE = "vec_id long, embedding array<float>, score string, rank string, label int"


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    asked = {}
    for i, v in ok:
        if i % 20 == 0:
            asked[i] = min([v.tolist(), asked.get(i, v.tolist())])
    out = []
    for q, v in sorted(asked.items()):
        v = np.array(v)
        near = []
        for i, w in ok:
            if i != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v.tolist(), w.tolist()):
                    s += a * b
                near.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


def check(spark, data, **options):
    df = spark.createDataFrame([(i, v, "s", "r", 1) for i, v in data], SHAPE).repartition(3)
    got = blockjoin.nearest(df, F.col("vec_id") % 20 == 0, **options)
    assert sorted(map(tuple, got.collect())) == sorted(brute(data, options.get("k", 20)))


def test_random_ties_and_scales(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-6, 6)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # ties
    check(spark, rows, k=20, rows=37, groups=5)
    check(spark, rows, k=3, rows=16, groups=2)


def test_odd_rows(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(0, v), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, v), (7, [1.0, 2.0, 3.0]),
            (20, [1e-45, 0.0]), (40, [3e38, -3e38]), (8, v), (8, v), (9, [-1.0, 0.5]), (0, v), (60, [2.0, 1.0]), (60, [0.5, 1.0])]
    check(spark, rows, k=4, rows=3)
    assert blockjoin.nearest(spark.createDataFrame([], SHAPE), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(80, 64))
    (qa, na), (qb, nb) = blockjoin.quantise(a), blockjoin.quantise(b)
    near = (qa.astype(float) @ qb.T.astype(float)) * (na[:, :1] * nb[:, 0])
    bound = na[:, 1:2] * nb[:, 2] + na[:, 2:3] * (nb[:, 1] + nb[:, 2])
    assert (np.abs(near - a @ b.T) <= bound + 1e-9).all()
    low, high = near - bound, near + bound
    least = np.partition(low, 60, axis=1)[:, 60]
    assert (high >= least[:, None]).mean() < 0.6
