"""NRA results against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from adlens.llm import nra
from llm_fixtures import DOCS, frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, items, k):
    """(item_id, rank, doc_id, score) of (id, text) rows."""
    own = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    N, L = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * N) // L
            score = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=20):
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = nra.search(docs, queries, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == direct(rows, items, k)


def test_odd_rows(spark):
    docs = frame(spark)
    check(spark, docs, [(0, "plain words, plain words"), (1, "Ünïcode ß"), (2, None), (3, ""), (None, "tie here id"), (4, "unknown"),
                        (5, words(60, 1)), (6, "x" * 50_000), (7, "TIE")])
    check(spark, docs, [(0, "plain words stand")], k=1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert nra.search(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert nra.search(frame(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []


def corpus(spark, n=700, parts=5):
    r = random.Random(7)
    rows = [(k, words(r.randint(1, 120), k % 97, 60)) for k in range(n)]
    rows += [(k, "same text for all of these") for k in range(5000, 5100)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_ties_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(nra, "SHARD_DOCS", 40)
    items = [(k, words(12, k % 97, 60)) for k in range(25)] + [(30, "same text"), (31, "all all of")]
    check(spark, corpus(spark), items, k=20)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(nra, "BLOCK_TERMS", 30)
    items = [(k, words(12, k, 60)) for k in range(7)] + [(8, words(50, 3, 60))]
    assert len(list(nra.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id"))) == 5
    check(spark, corpus(spark, 200, 2), items, k=5)


def test_reads_stop_early_and_agree_with_whole_sums():
    r = np.random.default_rng(1)
    n_docs, n_terms, k = 20_000, 6, 10
    doc, code, impact = [], [], []
    for t in range(n_terms):
        own = r.choice(n_docs, 15_000, replace=False)
        doc.append(own), code.append(np.full(len(own), t)), impact.append((r.pareto(1.0, len(own)) * 1000).astype(np.int64) + 1)
    doc, code, impact = map(np.concatenate, (doc, code, impact))
    shard = nra.Shard(doc, code, impact, n_docs, n_terms)
    whole = np.zeros(n_docs, np.int64)
    times = [1, 2, 1, 1, 3, 1]
    for t, q in enumerate(times):
        whole[doc[code == t]] += impact[code == t] * q
    kth = int(np.sort(whole)[-k])
    found, scores = shard.best(list(range(n_terms)), times, k, 1)
    assert sorted(scores.tolist())[-k:] == sorted(whole.tolist())[-k:]
    assert (whole[found] == scores).all() and set(np.flatnonzero(whole >= kth)) <= set(found.tolist())
    # with a threshold from elsewhere nothing of this shard comes in
    assert len(shard.best(list(range(n_terms)), times, k, int(whole.max()) + 1)[0]) == 0
