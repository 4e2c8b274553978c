"""Multiset fingerprints: the algebra, and edited texts and next documents against a direct walk."""

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from adlens.llm import multiset
from llm_fixtures import DOCS, frame, simple, words


def test_algebra():
    ps = [words(12, i) for i in range(9)]
    a = multiset.vectors(ps)
    assert (a == multiset.vectors(ps[::-1])).all()
    assert (a == multiset.vectors(ps[:4]) + multiset.vectors(ps[4:])).all()
    assert (multiset.insert(multiset.vectors(ps[1:]), ps[:1]) == a).all()
    assert (multiset.delete(a, ps[3:]) == multiset.vectors(ps[:3])).all()
    assert (multiset.vectors(ps + ps[:1]) != a).any() and not multiset.vectors([]).any()
    many = multiset.vectors(["x"] * 70_000)  # sums wrap, deletion still undoes them
    assert (multiset.delete(many, ["x"] * 69_999) == multiset.vectors(["x"])).all()


def test_likeness():
    ps = [words(40, i) for i in range(20)]
    a = multiset.vectors(ps)
    assert multiset.likeness(a, multiset.vectors(ps[::-1])) == 1.0
    assert abs(multiset.likeness(a, multiset.vectors(ps[:10] + [words(40, 100 + i) for i in range(10)])) - 0.5) < 0.25
    assert multiset.likeness(a, multiset.vectors([words(40, 200 + i) for i in range(20)])) < 0.3
    assert multiset.likeness(a, multiset.vectors([])) == 0.0 and multiset.likeness(multiset.vectors([]), multiset.vectors([])) == 1.0


def test_edited_print_is_that_of_the_edited_text():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \né.") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for t, u in zip(texts, texts[1:]):
        new = multiset.edited(t, u)
        assert (multiset.edited_print(multiset.fingerprint(t), t, u) == multiset.fingerprint(new)).all()
        half = len(t) // 2
        assert new == t[:len(t) - half] + u[:half]


def check(df, rows_per_range):
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "", r["doc_id"]) for r in hashed))
    want = []
    for k, (_, _, _, t, i) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][3]
        e = multiset.edited(t, n)
        a, b, c = multiset.fingerprint(t), multiset.fingerprint(e), multiset.fingerprint(n)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), multiset.to_hex(a), multiset.to_hex(b),
                     multiset.likeness(a, b), multiset.likeness(a, c)))
    got = multiset.document_fingerprints(df, rows_per_range).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_next_documents(spark):
    check(frame(spark), 1)
    check(frame(spark), 3)
    check(frame(spark).coalesce(1), 10_000)
    rnd = random.Random(4)
    ids = [rnd.choice([rnd.randrange(40), rnd.randrange(-(10 ** 15), 10 ** 15)]) for _ in range(150)]
    check(spark.createDataFrame([(i, f"{words(9, k)}\n{words(5, i % 7)}") for k, i in enumerate(ids)],
                                "doc_id long, text string").repartition(6), 4)


def test_single_and_empty(spark):
    row = multiset.document_fingerprints(simple(spark, ["abcd"])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1.0
    assert multiset.document_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    assert np.isfinite([r["near_edited"] for r in multiset.document_fingerprints(frame(spark)).collect()]).all()


def test_long_repetitive_texts_stay_alike(spark):
    line = " ".join(f"word{i}" for i in range(15))
    for n in (1000, 5000, 50_000):
        assert multiset.likeness(multiset.vectors([line] * n), multiset.vectors([line] * (n // 2))) > 0.999
    half, signed = multiset.vectors([line] * 2500), multiset.vectors([line]).astype(np.int32)[multiset.EQUAL:].astype(int)
    assert (half.astype(np.int32)[multiset.EQUAL:] == 2500 * signed).all()
    long = "\n".join([line] * 5000)
    rows = multiset.document_fingerprints(simple(spark, [long, "\n".join([line] * 4000)])).orderBy("doc_id").collect()
    assert all(r["near_edited"] > 0.99 and r["near_next"] > 0.99 for r in rows)
    assert len(rows[0]["fingerprint"]) == 4 * multiset.EQUAL + 8 * multiset.LIKE


def test_rows_without_an_id_spread_over_the_ranges(spark):
    df = spark.createDataFrame([(None if k % 2 else k, words(5, k)) for k in range(4000)], "doc_id long, text string")
    sizes = [r["count"] for r in multiset.with_next(df, 100).filter("ahead = 0").groupBy("range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    plans = [multiset.with_next(d, 10)._jdf.queryExecution().optimizedPlan().toString() for d in (df, df.limit(400))]
    assert abs(len(plans[0]) - len(plans[1])) < 200  # the plan doesn't grow with the rows


def direct_print(text):
    """Lanes by their definition, one paragraph and shingle at a time."""
    import xxhash
    equal, like = [0] * multiset.EQUAL, [0] * multiset.LIKE
    for p in filter(None, text.split("\n")):
        raw = hashlib.blake2b(p.encode(), digest_size=2 * multiset.EQUAL).digest()
        equal = [(e + int.from_bytes(raw[2 * k:2 * k + 2], "little")) % 2**16 for k, e in enumerate(equal)]
        ws = p.encode().split()
        runs = [ws[k:k + 3] for k in range(len(ws) - 2)] if len(ws) >= 3 else [ws] * bool(ws)
        for run in runs:
            bits = int.from_bytes(xxhash.xxh3_128_digest(b" ".join(run)), "big")
            like = [v + (1 if bits >> multiset.LIKE - 1 - k & 1 else -1) for k, v in enumerate(like)]
    return "".join(f"{e:04x}" for e in equal) + "".join(f"{v % 2**32:08x}" for v in like)


def test_prints_by_their_definition():
    for t in ("", "one", "two words\nand three more", words(30, 1) + "\n" + words(30, 1), "ü ß é à\n\nü ß é à"):
        assert multiset.to_hex(multiset.fingerprint(t)) == direct_print(t)
