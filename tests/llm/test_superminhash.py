"""SuperMinHash classes against all pairs, signatures against the walk of one element at a time."""

import random
import re

import numpy as np

from adlens.llm import superminhash
from llm_fixtures import DOCS, frame, simple, words


def direct(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(ws) < shingle:
        return {" ".join(ws)} if ws else set()
    return {" ".join(ws[i:i + shingle]) for i in range(len(ws) - shingle + 1)}


def classes(rows, percent=80):
    """(id, size, smallest reachable id, kept) by comparing all pairs."""
    sets, to = [direct(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                to[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        first = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), first, d == first))
    return sorted(out, key=repr)


def check(spark, df):
    got = superminhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = classes([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def test_odd_rows(spark):
    check(spark, frame(spark))


def test_empty_table(spark):
    got = superminhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert got.collect() == []


def test_near_copies_about_the_threshold(spark):
    """Groups whose members differ in 1 to 30 words of 200: many pairs stand just above or below 0.8."""
    r, texts = random.Random(5), []
    for g in range(12):
        base = words(200, g, 3000).split()
        for _ in range(12):
            copy = list(base)
            for k in r.sample(range(len(copy)), r.randint(0, 9)):
                copy[k] = f"new{r.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    want = check(spark, simple(spark, texts))
    assert 12 < len({c for _, _, c, _ in want}) < 144


def test_links_beside_the_first_round(spark):
    """A chain: neighbours are linked, others are not, so most links aren't with a bucket's smallest node."""
    pool, texts = words(400, 3, 5000).split(), []
    for k in range(0, 160, 8):
        texts.append(" ".join(pool[k:k + 200]))
    want = check(spark, simple(spark, texts))
    assert {c for _, _, c, _ in want} == {0}


def test_shared_passage_is_no_link(spark):
    passage = words(60, 9, 1000)
    texts = [passage + " " + words(80, 100 + k, 4000) for k in range(60)]
    want = check(spark, simple(spark, texts))
    assert len({c for _, _, c, _ in want}) == 60


def test_repeated_and_missing_ids(spark):
    a, b = words(50, 1), words(50, 2)
    rows = [(1, a), (1, b), (2, b), (None, a), (None, "only here without an id"), (None, "only here without an id"), (3, None), (3, "")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def sequential(elements, slots):
    """One element after the other, with the same random draws."""
    top, out = 2**64, [None] * slots

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    for e in elements:
        walk = list(range(slots))
        for level in range(slots):
            draw = mixed((int(e) + (2 * level + 1) * 0x9E3779B97F4A7C15) % top)
            k = level + ((mixed(draw) >> 32) * (slots - level) >> 32)
            walk[level], walk[k] = walk[k], walk[level]
            value = (draw >> 8) | level << 56
            p = walk[level]
            out[p] = value if out[p] is None else min(out[p], value)
    return out


def test_signatures_equal_the_full_walks():
    """Early stopping changes nothing, alone or together with other documents."""
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 17, 40, 300, 1500, 5)]
    got = superminhash.signatures(sets, 32)
    for own, row in zip(sets, got):
        assert row.tolist() == sequential(own.tolist(), 32)


def test_estimates_vary_less_than_independent_hashes():
    r, n, errors = np.random.default_rng(2), 100, []
    for _ in range(400):
        both = r.integers(0, 2**63, n, dtype=np.uint64)
        a, b = np.concatenate([both, r.integers(0, 2**63, n // 2, dtype=np.uint64)]), np.concatenate([both, r.integers(0, 2**63, n // 2, dtype=np.uint64)])
        x, y = superminhash.signatures([a, b])
        errors.append(float((x == y).mean()) - 0.5)
    independent = 0.25 / superminhash.SLOTS
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * independent


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Blocks of two nodes: every pair of components is compared somewhere."""
    monkeypatch.setattr(superminhash, "BLOCK_NODES", 2)
    monkeypatch.setattr(superminhash, "SALT_PAIRS", 2)
    r, texts = random.Random(8), []
    base = words(120, 3, 3000).split()
    for _ in range(60):  # variants of one text, from almost equal to far
        copy = list(base)
        for k in r.sample(range(len(copy)), r.randint(0, 25)):
            copy[k] = f"new{r.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    want = check(spark, simple(spark, texts))
    assert len({c for _, _, c, _ in want}) > 3
