"""Targets, whole documents near them, and positions that follow the schedules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adlens.llm import curriculum
from llm_fixtures import DOCS, frame, words


def direct_targets(sizes):
    """The excess over three sizes reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    while True:
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        for s in over:
            target[s] = 3.0 * sizes[s]
        free = [s for s in names if target[s] < 3 * sizes[s] - 1e-9]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)


def mixed(spark, df):
    return curriculum.mix(curriculum.sizes(df)).collect()


def check(spark, df):
    got = mixed(spark, df)
    rows = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(r["doc_id"]), size(r["text"])) for r in rows)
    sums = {}
    for r in rows:
        sums[r["source"]] = sums.get(r["source"], 0) + size(r["text"])
    want = direct_targets(sums)
    for r in got:
        assert r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    for s in sums:
        own = [r for r in got if r["source"] == s]
        miss = abs(sum(r["taken"] for r in own) - want[s])
        assert miss <= max((r["size"] for r in own), default=0) / 2 + 1e-6
    return got


def test_odd_rows(spark):
    check(spark, frame(spark))


def test_skewed_sources(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "CELL_ROWS", 20)
    rnd = random.Random(1)
    rows = [(i, words(rnd.randint(1, 60), i), None, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, 0, *"abcdef")
            for i in range(600)] + [(9000 + i, words(3, i), None, "tiny", 0, *"abcdef") for i in range(4)] + \
           [(9100, "", None, "nothing", 0, *"abcdef")]
    df = frame(spark, rows).repartition(4)
    a, b = check(spark, df), mixed(spark, df.repartition(3))
    assert sorted(map(repr, a)) == sorted(map(repr, b))  # reruns agree, whatever the partitions
    by = {}
    for r in a:
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
    tiny = [r for r in a if r["source"] == "tiny"]
    assert all(r["copies"] == 3 for r in tiny)


def test_positions_invert_the_schedules(spark):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(q, n) for q in shares for n in range(3)], "q double, n long")
    for r in df.select("q", "n", curriculum.position(F.col("q"), F.col("n")).alias("t")).collect():
        s, t = curriculum.SLOPES[r["n"]], r["t"]
        assert 0 <= t <= 1 and t + s * (t * t - t) == pytest.approx(r["q"], abs=1e-12)


def positions(rows):
    """(position, place, pass) of every copy, by integrating the source's schedule numerically."""
    out = []
    for r in rows:
        slope, target = curriculum.SLOPES[r["number"] % 3], r["target"]
        for k in range(r["copies"]):
            want = (r["start"] + r["size"] / 2 + k * r["source_size"]) / target if target else 0.0
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if mid + slope * (mid * mid - mid) < min(want, 1.0) else (low, mid)
            out.append((low, r["place"], k, r["doc_id"], r["size"]))
    return out


def test_taken_words_come_from_positions(spark):
    rows = [(i, words(5 + i % 9, i), None, f"s{i % 4}", 0, *"abcdef") for i in range(120)]
    rows += [(None, words(6, 500 + i), None, "s1", 0, *"abcdef") for i in range(40)]
    df = frame(spark, rows)
    got = curriculum.assigned(df, 4).collect()
    want = positions(mixed(spark, df))
    assert len(got) == 160 and sum(r["taken"] for r in got) == sum(p[4] for p in want)
    turns = sorted((r["first_turn"], r["first_position"], r["doc_id"]) for r in got if r["doc_id"] is not None and r["taken"])
    first = {}
    for turn, p in enumerate(sorted(want, key=lambda p: p[:3]), 1):
        first.setdefault((p[3], p[1]), (turn, p[0]))
    named = sorted((turn, at, i) for (i, _), (turn, at) in first.items() if i is not None)
    assert [i for _, _, i in turns] == [i for _, _, i in named]
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) for a, b in zip(turns, named))
    assert [r["first_turn"] for r in got if r["taken"]] == sorted(r["first_turn"] for r in got if r["taken"])


def test_rows_without_an_id_spread_over_the_cells(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "CELL_ROWS", 100)
    rows = [(i if i % 2 else None, words(4, i), None, "one", 0, *"abcdef") for i in range(2000)]
    s = curriculum.sizes(frame(spark, rows))
    cells = s.withColumn("cell", curriculum._cell(F.col("place"), F.lit(2000))).groupBy("cell").count().collect()
    assert len(cells) == 20 and max(r["count"] for r in cells) < 200


def test_training_order(spark):
    rows = [(i, words(5 + i % 9, i), None, f"s{i % 4}", 0, *"abcdef") for i in range(120)]
    rows += [(None, words(4, 900 + i), None, "s1", 0, *"abcdef") for i in range(9)] + [(7, "another text of row seven", None, "s1", 0, *"abcdef")] * 2
    df = frame(spark, rows)
    out = curriculum.training_order(df, 4)
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    whole = F.struct(*df.columns)
    at = curriculum.copies(curriculum.mix(curriculum.sizes(df, F.md5(whole.cast("string").cast("binary")))))
    per = {r["place"]: r["text"] for r in df.select(F.md5(whole.cast("string").cast("binary")).alias("place"), "text").collect()}
    want = at.orderBy("position", "place", "pass_no", "start").collect()
    assert texts == [per[r["place"]] for r in want]
    single = frame(spark, [(*r[:3], "one", *r[4:]) for r in rows])  # the target is the source's size: every row once
    assert sorted(r["text"] for r in curriculum.training_order(single, 4).collect()) == sorted(r[1] for r in rows)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixed(spark, empty) == [] and curriculum.training_order(empty).count() == 0
