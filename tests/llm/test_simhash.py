"""SimHash classes against all pairs."""

import random
import re

import numpy as np
import xxhash

from adlens.llm import simhash
from llm_fixtures import DOCS, frame, simple, words


def direct(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(rows, max_bits=2):
    """Smallest reachable id of every (id, fingerprint), by brute force."""
    n = len(rows)
    to = list(range(n))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= max_bits:
                to[root(i)] = root(j)
    out = []
    for i, (d, f) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{f:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def check(spark, df, rows):
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == classes([(i, direct(t)) for i, t in rows])


def test_odd_rows(spark):
    df = frame(spark)
    check(spark, df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_near_copies(spark):
    rnd, texts = random.Random(3), []
    for g in range(30):
        base = words(300, g).split()
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    df = simple(spark, texts)
    check(spark, df, list(enumerate(texts)))


def linked(spark, values, max_bits=2):
    fps = sorted(set(values))
    df = spark.createDataFrame([(int(np.int64(np.uint64(v))),) for v in fps], "fp long")
    roots = {np.uint64(np.int64(r["node"])).item(): np.uint64(np.int64(r["root"])).item()
             for r in simhash.roots(df, max_bits).collect()}
    got = {}
    for v in fps:
        got.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    for (i, _, c) in classes([(i, v) for i, v in enumerate(fps)], max_bits):
        want.setdefault(c, set()).add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_linked_fingerprints_share_the_guaranteed_keys():
    """Any two byte positions are left out together by two keys or more; no key leaves three others out as well."""
    for i in range(8):
        for j in range(8):
            assert sum(i in t and j in t for t in simhash.LEFT_OUT) >= simhash.MIN_SHARED
    assert len({frozenset(t) for t in simhash.LEFT_OUT}) == len(simhash.LEFT_OUT) == 21


def test_the_tally_decides(spark):
    """Pairs that meet under one key only are out by their count, before any bits are compared."""
    rnd = random.Random(2)
    rows = []
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for at in rnd.sample(range(8), rnd.randint(0, 4)):
            b ^= 1 << 8 * at + rnd.randrange(8)
        rows.append((int(np.int64(np.uint64(a))), int(np.int64(np.uint64(b)))))
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", simhash.shared_keys(df["a"], df["b"]).alias("n")).collect()
    differing = lambda r: {i for i in range(8) if (r["a"] ^ r["b"]) >> 8 * i & 255}
    for r in got:
        assert r["n"] == sum(differing(r) <= set(t) for t in simhash.LEFT_OUT)
        assert (r["n"] >= simhash.MIN_SHARED) == (len(differing(r)) <= 2)
    assert any(r["n"] == 1 for r in got)  # met, but dropped by the count


def test_dense_postings_are_whole(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    values = [centre]
    for _ in range(250):  # a long chain and clumps that agree on half the bits
        v = values[rnd.randrange(len(values))]
        for _ in range(rnd.randint(1, 2)):
            v ^= 1 << rnd.randrange(20)
        values.append(v)
    values += [rnd.getrandbits(64) for _ in range(40)]
    for bits in (0, 1, 2):
        linked(spark, values, bits)


def test_empty_and_single(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[0] for r in simhash.near_duplicates(simple(spark, ["a b c"])).select("component_id").collect()] == [0]


def test_representatives_keep_one_row_of_each_group(spark):
    df = frame(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    texts = [r["text"] or "" for r in kept.collect()]
    prints = {direct(t) for t in texts}
    assert prints == {direct(r["text"]) for r in df.collect()}  # no group is lost, and of near groups one row stays
    assert len(texts) == len({c for _, _, c in classes_of(df)})


def classes_of(df):
    """(id, fingerprint, number of the component) of every row."""
    rows = [(k, direct(r["text"])) for k, r in enumerate(df.collect())]
    return classes(rows)


def test_representatives_of_repeated_and_missing_ids(spark):
    a, b, c = "alpha beta gamma delta", "totally other words here", "a third text without id"
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, c + " and more and more words"), (3, None)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(
        [(1, a), (1, b), (None, c), (3, c + " and more and more words"), (3, None)], key=repr)
