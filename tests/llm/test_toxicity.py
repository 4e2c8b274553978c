"""The tagger: exact marginals, held-out accuracy, spans and defined results."""

import itertools
import random
import zlib

import numpy as np
import pytest

from adlens.llm import toxicity
from llm_fixtures import DOCS, frame, words

BAD = ["grubble", "snarfer", "blighto"]


def corpus(n=400, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        ws = words(rnd.randint(20, 120), 7 + i).split()
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(BAD))
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 5]
    return toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5):
        u, a = rng.normal(size=size), rng.normal(size=(2, 2))
        weights = {}
        for path in itertools.product((0, 1), repeat=size):
            s = sum(u[t] for t in range(size) if path[t]) + sum(a[path[t - 1], path[t]] for t in range(1, size))
            weights[path] = np.exp(s)
        z = sum(weights.values())
        want = [sum(w for p, w in weights.items() if p[t]) / z for t in range(size)]
        pairs = np.zeros((2, 2))
        for p, w in weights.items():
            for t in range(1, size):
                pairs[p[t - 1], p[t]] += w / z
        grid = np.zeros((8, 2))
        grid[:size, 0] = u
        m, got = toxicity.forward_backward(grid, np.array([size, 0]), a, pairs=True)
        assert np.allclose(m[:size, 0], want) and not m[size:, 0].any() and not m[:, 1].any()
        assert np.allclose(got, pairs)


def test_held_out_accuracy(model):
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    scores = model.score(toxicity.aggregate(toxicity.marginals(model, [t for _, t, _ in rows])))
    labels = np.array([y for *_, y in rows])
    assert ((scores >= 0.5) == labels).mean() > 0.98


def test_training_reads_no_held_out_row(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows],
                                    "doc_id long, toxic int")
    a, b = toxicity.train(docs, right), toxicity.train(docs, flipped)
    assert (a.weights == b.weights).all() and a.layer == b.layer
    small = toxicity.train(docs, right, max_documents=20)
    assert (small.weights != a.weights).any()


def test_spans_and_scores(spark, model):
    text = "calm words grubble snarfer and Blighto, then peace " + words(30, 9)
    df = frame(spark, [(1, text, "en", "a", 1, *"sfzpkr"), (2, None, None, None, None, *"sfzpkr"), (None, "", "en", "a", 0, *"sfzpkr"),
                       (3, "plain words", "en", "a", 0, *"sfzpkr"), (3, "plain words", "en", "a", 0, *"sfzpkr")])
    rows = toxicity.tag(df, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    first = next(r for r in rows if r["doc_id"] == 1)
    assert first["predicted"] == 1 and [text[s["begin"]:s["end"]] for s in first["spans"]] == ["grubble snarfer", "Blighto"]
    kept = toxicity.clean_rows(df, model)
    assert kept.columns == df.columns and kept.count() == 4


def test_long_texts_are_read_to_the_end(spark, model):
    df = frame(spark, [(1, words(20_000, 3) + " grubble snarfer" * 150, "en", "a", 1, *"sfzpkr")])
    assert toxicity.tag(df, model).first()["predicted"] == 1


def test_untrainable_and_empty(spark):
    assert toxicity.fit([], np.array([])).score(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    assert toxicity.fit(["a", "b"], np.array([1, 1])).score(np.zeros((1, 3))).tolist() == [1.0]
    empty = spark.createDataFrame([], DOCS)
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.tag(empty, model).count() == 0 and toxicity.tag(frame(spark), model).count() == frame(spark).count()
    odd = spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 0), (4, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.tag(frame(spark), toxicity.train(frame(spark), odd)).count() == frame(spark).count()


def test_texts_without_words_and_the_models_bytes():
    empty = toxicity.fit(["", " "], np.array([0, 1]))
    assert np.isfinite(empty.score(toxicity.aggregate([np.zeros(0)]))).all()
    again = toxicity.Model.from_bytes(empty.to_bytes())
    assert (again.weights == empty.weights).all() and again.layer == empty.layer and again.transitions == empty.transitions
