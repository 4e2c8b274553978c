"""The filter audit against applying the filters one after the other."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from adlens.llm import filteraudit
from llm_fixtures import DOCS, frame, words


def direct(docs, labels):
    """Rows of the audit of (id, text, source) rows and (id, quality, toxic) rows."""
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = {}
    for d, t, s in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        parts.setdefault(s or "", []).append((fails, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for f in order:
                total[f] += sum(r[0][f] for r in left)
                left = [r for r in left if not r[0][f]]
        for order in permutations("ABCDE"):
            left, removed_before = rows, []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[0][f]]
                redundant = sum(r[0][f] for r in removed_before)
                left = [r for r in left if not r[0][f]]
                removed_before = removed_before + here
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out.append((part, "".join(order), step, len(left), len(here), redundant, only,
                            sum(r[1] for r in here), sum(r[2] for r in here), total[f]))
    return sorted(out)


def check(spark, docs, labels):
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string, mask int"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == direct(rows, [x[:3] for x in labels])


LABELS = [(0, 1, 0, "p", 1), (2, 0, 1, "p", 1), (2, 1, None, "p", 1), (5, 1, 1, "p", 1), (None, 1, 1, "p", 1), (999, 1, 1, "p", 1)]


def mixed(spark):
    r = random.Random(4)
    rows = []
    for k in range(300):
        t = words(r.randint(30, 90), k % 40, 400 if k % 3 else 12)
        if k % 5 == 0:
            t = t.upper()
        if k % 7 == 0:
            t += " 100%"
        rows.append((k, t, f"s{k % 3}" if k % 11 else None))
    rows += [(7, rows[0][1], "s1"), (None, rows[3][1], "s0"), (None, "twice without an id", "s2"), (None, "twice without an id", "s2")]
    rows += [(k, "a text that stands in many rows", "hot") for k in range(400, 500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_odd_rows(spark):
    check(spark, frame(spark), LABELS)


def test_mixed_failures(spark):
    check(spark, mixed(spark), LABELS)


def test_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "MAX_BLOCKS", 1)
    check(spark, mixed(spark), LABELS)


def test_texts_with_one_hash(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    check(spark, mixed(spark), LABELS)


def test_unique_texts_are_cleared(spark):
    docs = mixed(spark)
    rows = filteraudit.judged(docs)
    blocks = 400
    merged = filteraudit.sketch(rows, blocks)
    left = filteraudit.may_repeat(rows, merged, blocks).select("hash").distinct().collect()
    repeats = {r["hash"] for r in rows.groupBy("hash").count().filter("count > 1").collect()}
    assert repeats <= {r["hash"] for r in left}
    assert len(left) < len(repeats) + 20


def test_empty_table(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, part string, mask int")
    assert filteraudit.audit(spark.createDataFrame([], DOCS), labels).collect() == []
