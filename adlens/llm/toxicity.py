"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given per document, the field tags tokens. Token labels are derived first: a
word or affix whose occurrence in toxic documents cannot be chance (a likelihood-ratio
test over the sampled documents) marks tokens of *toxic* documents; every token of a clean
document is clean; toxic documents without a marked token are left out of the field's
training. The field has unigram features of each token (the word, its first three to seven
and last three letters, a bias) and a transition matrix; it is fitted by gradient ascent on
its log-likelihood, the gradient coming from forward-backward marginals. A document's
marginals are aggregated (largest, expected number, share) and a logistic layer fitted on
the sampled documents turns them into the score.

The classifier is fitted on a bounded sample of labelled rows: at most ``max_documents``
rows in hash order, of at most ``max_chars`` characters each, and ``max_segments`` chains.
Scoring covers every whole text of every row. A chain is at most ``CHAIN`` words long;
longer texts are several chains, which together cover each word once. Features are
hashed, so the model has a fixed size (4 MB) and travels with the task closure.

Defined results: null or empty texts score what a document without tokens does; without
usable training rows (or with one class only) every score is the share of toxic rows, 0 if
there are none; a document labelled twice counts as toxic if any label says so; null ids
are scored like others; repeated rows return once each; an empty table gives an empty
result; no column but the text is an input of a score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlens.llm.common import column_chunks, text_chunks

MAX_DOCUMENTS = 6000
MAX_CHARS = 40_000
MAX_SEGMENTS = 16_000
CHAIN = 64
EVIDENCE = 18.0        # likelihood-ratio statistic: chance of about one in 50,000 per feature
ROUNDS = 60
CACHE_WORDS = 150_000
BUCKETS = 1 << 20      # hashed features
CHAINS_AT_ONCE = 4000  # of the training grids

PREFIXES = (3, 4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed ids of a word's features."""
    w = word.lower()
    n = len(w)
    names = ["w" + w, *("p" + w[:k] for k in PREFIXES if n >= k), *(["s" + w[-3:]] if n >= 3 else [])]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in names]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32), repr=False)
    bias: float = 0.0
    transitions: tuple = ((0.0, 0.0), (0.0, 0.0))
    layer: tuple | None = None     # of the document score: intercept and a weight per aggregate
    prior: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def to_bytes(self) -> bytes:
        """The model with the weights that aren't zero."""
        at = np.flatnonzero(self.weights)
        return pickle.dumps(self.__getstate__() | {"weights": (at.astype(np.int32), self.weights[at])})

    @staticmethod
    def from_bytes(raw: bytes) -> "Model":
        state = pickle.loads(raw)
        at, values = state.pop("weights")
        model = Model(**state)
        model.weights[at] = values
        return model

    def unary(self, words: list[str]) -> np.ndarray:
        """The score of each word's toxic state over its clean one."""
        cache = self.cache
        new = [w for w in set(words) if w not in cache]
        ids = [features(w) for w in new]
        owner = np.repeat(np.arange(len(new)), [len(x) for x in ids])
        flat = np.array([i for x in ids for i in x], int)
        fresh = dict(zip(new, (self.bias + np.bincount(owner, self.weights[flat], len(new))).tolist()))
        if len(cache) + len(fresh) <= CACHE_WORDS:
            cache.update(fresh)
            return np.array([cache[w] for w in words], float)
        return np.array([fresh[w] if w in fresh else cache[w] for w in words], float)

    def score(self, aggregates: np.ndarray) -> np.ndarray:
        if self.layer is None:
            return np.full(len(aggregates), self.prior)
        return _sigmoid(self.layer[0] + aggregates @ np.array(self.layer[1:]))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def chains(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of every chain of texts with so many tokens, laid one after another."""
    starts, sizes, at = [], [], 0
    for n in counts:
        s = np.arange(0, n, CHAIN)
        starts.append(at + s)
        sizes.append(np.minimum(CHAIN, n - s))
        at += n
    return (np.concatenate(starts) if starts else np.zeros(0, int)).astype(int), \
           (np.concatenate(sizes) if sizes else np.zeros(0, int)).astype(int)


def forward_backward(unary: np.ndarray, sizes: np.ndarray, transitions, pairs: bool = False):
    """Marginal of the toxic state, [step, chain]; with ``pairs`` also the expected transitions (2 x 2).

    ``unary`` is [step, chain]; the steps of a chain beyond its size are ignored.
    """
    steps, n = unary.shape
    a = np.exp(np.array(transitions, float))
    e = np.exp(np.clip(unary, -30, 30))
    f0, f1 = np.empty((steps, n)), np.empty((steps, n))
    live = [sizes > t for t in range(steps)]
    for t in range(steps):
        if t == 0:
            x0, x1 = np.ones(n), e[0]
        else:
            x0 = f0[t - 1] * a[0, 0] + f1[t - 1] * a[1, 0]
            x1 = (f0[t - 1] * a[0, 1] + f1[t - 1] * a[1, 1]) * e[t]
        z = x0 + x1
        f0[t], f1[t] = x0 / z, x1 / z
    marginal, expected = np.zeros((steps, n)), np.zeros((2, 2))
    b0, b1 = np.full(n, 0.5), np.full(n, 0.5)
    for t in range(steps - 1, -1, -1):
        on = live[t]
        x0, x1 = f0[t] * b0, f1[t] * b1
        marginal[t] = np.where(on, x1 / (x0 + x1), 0.0)
        if t and pairs:
            cells = [[f0[t - 1] * a[0, 0] * b0, f0[t - 1] * a[0, 1] * e[t] * b1],
                     [f1[t - 1] * a[1, 0] * b0, f1[t - 1] * a[1, 1] * e[t] * b1]]
            z = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
            expected += [[float((c / z)[on].sum()) for c in row] for row in cells]
        g1 = b1 * e[t]
        c0, c1 = a[0, 0] * b0 + a[0, 1] * g1, a[1, 0] * b0 + a[1, 1] * g1
        z = c0 + c1
        b0, b1 = np.where(on, c0 / z, b0), np.where(on, c1 / z, b1)
    return (marginal, expected) if pairs else marginal


def _grid(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[step, chain] of token values; 0 beyond a chain's end."""
    at = starts[None, :] + np.arange(CHAIN)[:, None]
    inside = np.arange(CHAIN)[:, None] < sizes[None, :]
    return np.where(inside, values[np.minimum(at, max(0, len(values) - 1))], 0.0) if len(values) else np.zeros((CHAIN, 0))


def marginals(model: Model, texts: list[str]) -> list[np.ndarray]:
    """The toxic marginal of every word of each text."""
    words = [_WORD.findall(t) for t in texts]
    counts = [len(w) for w in words]
    flat = model.unary([w for ws in words for w in ws])
    starts, sizes = chains(counts)
    if not len(starts):
        return [np.zeros(0) for _ in texts]
    m = forward_backward(_grid(flat, starts, sizes), sizes, model.transitions)
    out = m.T[np.arange(CHAIN)[None, :] < sizes[:, None]]
    return np.split(out, np.cumsum(counts)[:-1])


def aggregate(ps: list[np.ndarray]) -> np.ndarray:
    """Per document: log odds of the largest marginal, expected toxic words (log), their density (log)."""
    rows = []
    for p in ps:
        m = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
        n = float(p[p >= 0.5].sum()) if len(p) else 0.0
        rows.append((np.log(m / (1 - m)), np.log1p(n), np.log((n + 0.05) / (len(p) + 20))))
    return np.array(rows, float).reshape(-1, 3)


def _tokens(texts: list[str]):
    """Type ids of each text's words, and the features of each type ([type, feature], -1 for none)."""
    types: dict[str, int] = {}
    rows, width = array("i"), len(PREFIXES) + 2
    out = []
    for t in texts:
        ids = array("i")
        for w in _WORD.findall(t):
            w = w.lower()
            i = types.get(w)
            if i is None:
                i = types[w] = len(types)
                fs = features(w)
                rows.extend(fs + [-1] * (width - len(fs)))
            ids.append(i)
        out.append(np.array(ids, np.int32))
    return out, np.array(rows, np.int32).reshape(-1, width)


def evidence(words: list[np.ndarray], table: np.ndarray, toxic: np.ndarray):
    """Which features toxic documents alone explain, and in how many documents each feature occurs."""
    count = np.zeros((2, BUCKETS), np.int64)
    for ids, y in zip(words, toxic):
        seen = np.unique(table[np.unique(ids)])
        count[y, seen[seen >= 0]] += 1
    n1 = int(toxic.sum())
    n0, base = len(toxic) - n1, n1 / len(toxic)
    marks, often = np.zeros(BUCKETS, bool), np.flatnonzero(count[1] >= 3)
    c0, c1 = count[:, often].astype(float)
    k = c0 + c1
    g = 2 * (c1 * np.log(c1 / (k * base)) + c0 * np.log(np.maximum(c0, 1e-9) / (k * (1 - base))))
    marks[often] = (c1 * n0 > 20 * c0 * n1) & (g >= EVIDENCE)
    return marks, count.sum(axis=0)


def fit(texts: list[str], toxic: np.ndarray, max_segments: int = MAX_SEGMENTS, rounds: int = ROUNDS) -> Model:
    """The model of labelled texts (toxic: 0 or 1)."""
    toxic = np.asarray(toxic, int)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(prior=float(toxic.mean()) if len(texts) else 0.0)
    words, table = _tokens(texts)
    marks, count = evidence(words, table, toxic)
    marked = ((table >= 0) & marks[table]).any(axis=1)
    trained = count >= 3
    use_docs = [(ids, marked[ids] if y else np.zeros(len(ids), bool)) for ids, y in zip(words, toxic)]
    use_docs = [(ids, hit) for (ids, hit), y in zip(use_docs, toxic) if len(ids) and (hit.any() or not y)]
    counts = [len(ids) for ids, _ in use_docs]
    ids = np.concatenate([x for x, _ in use_docs]) if use_docs else np.zeros(0, int)
    tags = np.concatenate([x for _, x in use_docs]).astype(float) if use_docs else np.zeros(0)
    starts, sizes = chains(counts)
    with_hit = np.array([tags[s:s + n].any() for s, n in zip(starts, sizes)], bool)
    rng = np.random.default_rng(0)
    order = rng.permutation(len(starts))
    hits, rest = order[with_hit[order]][:max_segments // 2], order[~with_hit[order]]
    use = np.sort(np.concatenate([hits, rest[:max_segments - len(hits)]]))
    starts, sizes = starts[use], sizes[use]
    # the chains in blocks of [step, chain] grids, and the features that occur in them
    blocks = []
    for a in range(0, len(starts), CHAINS_AT_ONCE):
        s, n = starts[a:a + CHAINS_AT_ONCE], sizes[a:a + CHAINS_AT_ONCE]
        blocks.append((_grid(ids, s, n).astype(np.int32), _grid(tags, s, n).astype(bool), n, np.arange(CHAIN)[:, None] < n[None, :]))
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(token[inside]) for token, _, _, inside in blocks)]))
    row = np.zeros(len(table), np.int32)
    row[used] = np.arange(len(used))
    blocks = [(row[token], tag, n, inside) for token, tag, n, inside in blocks]
    own = table[used]
    keep = (own >= 0) & trained[own]
    (names, flat), owner = np.unique(own[keep], return_inverse=True), np.broadcast_to(np.arange(len(used))[:, None], own.shape)[keep]
    del words, table, use_docs, ids, tags, own, keep, row
    theta, bias, trans = np.zeros(len(names)), -2.0, np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for _, tag, _, inside in blocks:
        for t in range(1, CHAIN):
            on = inside[t]
            np.add.at(seen, (tag[t - 1][on].astype(int), tag[t][on].astype(int)), 1)
    g2, g2b, g2t = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        u = bias + np.bincount(owner, theta[flat], len(used))
        by_type, pair, gb = np.zeros(len(used)), np.zeros((2, 2)), 0.0
        for token, tag, n, inside in blocks:
            m, some = forward_backward(np.where(inside, u[token], 0.0), n, trans, pairs=True)
            delta = np.where(inside, tag - m, 0.0)
            by_type += np.bincount(token[inside], delta[inside], len(used))
            pair, gb = pair + some, gb + float(delta.sum())
        grad = np.bincount(flat, by_type[owner], len(names)) - 0.01 * theta
        gt = seen - pair - 0.01 * trans
        g2, g2b, g2t = g2 + grad ** 2, g2b + gb ** 2, g2t + gt ** 2
        theta, bias = theta + 0.7 * grad / np.sqrt(g2), bias + 0.7 * gb / np.sqrt(g2b)
        trans = trans + 0.3 * gt / np.sqrt(g2t)
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = theta
    model = Model(weights, float(bias), tuple(map(tuple, trans.tolist())), None,
                  float(toxic.mean()))
    x = np.concatenate([aggregate(marginals(model, [texts[i] for i in some])) for some in text_chunks(texts)])
    model.layer = _logistic(x, toxic)
    model.cache = {}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple:
    """Intercept and weights of a ridge logistic regression, by Newton steps; weights stay non-negative."""
    x = np.column_stack([np.ones(len(x)), x])
    free = np.ones(x.shape[1], bool)
    while True:
        w, z = np.zeros(x.shape[1]), x[:, free]
        for _ in range(30):
            p = _sigmoid(z @ w[free])
            g = z.T @ (y - p) - ridge * w[free]
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(h, g)
            w[free] += np.clip(step, -3, 3)
        bad = free & (w < 0) & (np.arange(len(w)) > 0)
        if not bad.any():
            return tuple(w.tolist())
        free &= ~bad


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample, in hash order of the ids, of the labelled rows that are not held out.

    The sample (``max_documents`` texts of at most ``max_chars``) is fitted in one task; only the model goes to the driver.
    """
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = (rows.filter(F.length("text") <= max_chars).select("id").join(marks, "id")
           .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_documents))
    few = F.broadcast(ids)  # at most max_documents rows of two numbers
    sample = (rows.join(few, "id").filter(F.length("text") <= max_chars)
              .groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
              .repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y"))

    def run(batches):
        texts, marks_ = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            marks_ += [min(1, max(0, y)) for y in b.column("y").to_pylist()]
        yield pa.record_batch([pa.array([fit(texts, np.array(marks_, int)).to_bytes()], pa.binary())], ["model"])

    fitted = sample.mapInArrow(run, "model binary").collect()
    return Model.from_bytes(bytes(fitted[0]["model"])) if fitted else fit([], np.array([]))


def _scored(model: Model, column):
    """Text, marginals and score of every row of an Arrow string column, in bounded amounts of text."""
    for _, texts in column_chunks(column):
        ps = marginals(model, texts)
        yield from zip(texts, ps, model.score(aggregate(ps)).tolist())


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Offending code-point ranges: runs of words with a marginal of ``least`` or more, with the largest one."""
    out, last = [], None
    for k, m in enumerate(_WORD.finditer(text)):
        if p[k] >= least:
            if last == k - 1 and out:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
            else:
                out.append((m.start(), m.end(), float(p[k])))
            last = k
    return out


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the offending spans of every row."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        for b in batches:
            scores, found = [], []
            for text, p, s in _scored(model, b.column("text")):
                scores.append(s)
                found.append([dict(zip(("begin", "end", "probability"), x)) for x in spans(text, p)]
                             if len(p) and p.max() >= 0.5 else [])
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()),
                                   pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, kind)],
                                  ["doc_id", "score", "predicted", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int, "
                                  "spans array<struct<begin:long,end:long,probability:double>>")


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not take for toxic."""
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = [s < 0.5 for _, _, s in _scored(model, b.column(text))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
