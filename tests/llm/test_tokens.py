"""Piecewise encoding, token files, packing and the length histogram against whole encodings."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from adlens.llm import histogram, packing, rans
from adlens.llm.common import shared_path
from adlens.llm.tokens import _WHITE, PieceEncoder
from llm_fixtures import DOCS, TOKENIZER, frame, simple, words


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def whole(tok, text, *end):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + list(end), "<u4")


def test_pieces_join_to_the_whole(tok):
    rnd = random.Random(1)
    chars = list("ab '!?.,1é漢<|") + list(_WHITE.replace("-", "")) + ["\x1c", "\x1f", "​", "<|endoftext|>", "'s", "  ", "\n\n"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for limit in (10, 100_000):
        e = PieceEncoder(TOKENIZER, limit)
        for i in range(0, len(texts), 500):
            for t, raw in zip(texts[i:i + 500], e.encode(texts[i:i + 500])):
                assert (e.ids(raw) == whole(tok, t)).all(), repr(t)


def test_each_distinct_piece_is_looked_up_once(tok):
    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

    e = PieceEncoder(TOKENIZER)
    e.cache = Counting(e.cache)
    texts = ["head one two, one two,\n" * 500, "", " one  two", "two,", "é漢 one\none"] * 3
    for _ in range(2):  # new pieces, then known ones
        Counting.asked = 0
        assert all((e.ids(raw) == whole(tok, t)).all() for t, raw in zip(texts, e.encode(texts)))
        assert Counting.asked <= 30


def test_words_are_kept_without_their_punctuation(tok):
    class Counting:
        words = 0

        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            Counting.words += word.startswith("\u0120")  # a blank before it
            return self.model.tokenize(word)

    first, second = ([f"{w}{c}" for c in "abcdefghij"] for w in ("one", "two"))
    chunks = [["head " + " ".join(w + m for w in ws for m in marks)] for ws, marks in
              ((first, ",;"), (second, ",;"), (first + second, [".", "!?", ""]))]
    e = PieceEncoder(TOKENIZER, 20)  # room for the words alone
    e.model = Counting(e.model)
    for texts in chunks:
        assert all((e.ids(raw) == whole(tok, t)).all() for t, raw in zip(texts, e.encode(texts)))
    assert Counting.words == 20


def test_column_chunks_cover_every_row():
    import pyarrow as pa
    from adlens.llm.common import column_chunks
    column = pa.array(["a" * 10, None, "", "é" * 15, "c"], pa.string())
    for part in (column, column.slice(1, 3), column.slice(0, 0)):
        for limit in (1, 12, 1000):
            got = list(column_chunks(part, limit))
            assert [t for _, ts in got for t in ts] == [t or "" for t in part.to_pylist()]
            assert [at for at, _ in got] == list(np.cumsum([0] + [len(ts) for _, ts in got]))[:len(got)]


def test_range_coder_round_trips():
    rnd = np.random.default_rng(0)
    for ids in (np.zeros(0, "<u4"), np.full(70_000, 7, "<u4"), rnd.zipf(1.3, 200_000).clip(0, 50_000).astype("<u4"),
                rnd.integers(0, 50_000, 300).astype("<u4"), np.arange(50_000, dtype="<u4")):
        if len(ids):
            s, c = np.unique(ids, return_counts=True)
            table = rans.Table.from_bytes(rans.Table.of_counts(s, c).to_bytes())
            assert table.freqs.sum() == 1 << table.bits and table.freqs.min() >= 1
        for n in {0, 1, 127, 128, 129, len(ids) // 2, len(ids)}:
            if n <= len(ids) and len(ids):
                raw = rans.encode_blocks(ids[:n], table)
                assert (rans.decode_blocks(memoryview(raw), table) == ids[:n]).all()


def test_range_coder_size_and_checksum():
    ids = np.random.default_rng(1).zipf(1.5, 300_000).clip(0, 1000).astype("<u4")
    s, c = np.unique(ids, return_counts=True)
    table = rans.Table.of_counts(s, c)
    raw = rans.encode_blocks(ids, table)
    p = c / c.sum()
    assert len(raw) * 8 < len(ids) * -(p * np.log2(p)).sum() * 1.08
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks(memoryview(bytes(broken)), table)


def stream(tok, rows, end):
    """(doc_id, start, n, crc) in the order of the files."""
    coded = [(i, whole(tok, t, end)) for i, t in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes())))
    out, at = [], 0
    for i, a in coded:
        out.append((i, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    return sorted(out, key=repr)


def test_token_files(spark, tok, monkeypatch):
    monkeypatch.setattr(rans, "SHARD_TOKENS", 5000)
    rows = [(r["doc_id"], r["text"]) for r in frame(spark).collect()]
    rows += [(100 + i, words(80, i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = shared_path(spark, "tokens")
    got = rans.round_trip(df, TOKENIZER, 2, path)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == stream(tok, rows, 2)
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in rans.read_files(spark, path, with_ids=True).collect()}
    assert (back[100] == whole(tok, rows[-60][1], 2)).all()


def test_token_files_empty(spark):
    assert rans.round_trip(spark.createDataFrame([], DOCS), TOKENIZER, 2).count() == 0


def placed(spark, tok, df, **options):
    got = packing.pack_documents(df, TOKENIZER, 0, 64, **options).collect()
    by_seq, docs = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault((r["doc_id"], ), []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 64
    return got, by_seq


def test_packing(spark, tok):
    df = frame(spark).unionByName(frame(spark, [(1000 + i, words(3 + i % 70, i), None, None, None, *"abcdef") for i in range(300)]))
    got, by_seq = placed(spark, tok, df)
    want = []
    for r in df.collect():
        a = whole(tok, r["text"], 0)
        want += [(r["doc_id"], k, s, n, zlib.crc32(a[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(a), 64))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    total = sum(x[3] for x in want)
    assert len(by_seq) <= -(-total // 64) * 1.05 + 1


def test_packing_constraints(spark, tok):
    df = frame(spark, [(i, words(2 + i % 9, i), None, None, None, *"abcdef") for i in range(200)])
    for rule in ("norm", "dot"):
        got, by_seq = placed(spark, tok, df, max_documents=3, max_attention=1500, rule=rule)
        assert len(got) == 200
        assert max(map(len, by_seq.values())) <= 3
        assert max(sum(r["length"] ** 2 for r in rs) for rs in by_seq.values()) <= 1500


def test_packing_empty_and_cut(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def test_length_histogram(spark, tok, monkeypatch):
    monkeypatch.setattr(histogram, "RANGE", 7)
    df = frame(spark).unionByName(frame(spark, [(1000 + i, words(i % 30, i), None, None, None, *"abcdef") for i in range(100)]))
    lengths = np.array([len(whole(tok, r["text"])) for r in df.collect()])
    got = {r["context_limit"]: r for r in histogram.context_limits(histogram.length_histogram(df, TOKENIZER)).collect()}
    assert sorted(got) == sorted(set(lengths.tolist()))
    for n, r in got.items():
        assert r["documents"] == (lengths == n).sum() and r["whole_documents"] == (lengths <= n).sum()
        assert r["whole_tokens"] == lengths[lengths <= n].sum() and r["truncated_documents"] == (lengths > n).sum()
        assert r["kept_tokens"] == np.minimum(lengths, n).sum() and r["lost_tokens"] == np.maximum(lengths - n, 0).sum()
        assert r["total_tokens"] == lengths.sum() and r["quantile"] == pytest.approx((lengths <= n).mean())
    assert histogram.context_limits(histogram.length_histogram(spark.createDataFrame([], DOCS), TOKENIZER)).count() == 0


def test_simple_documents_have_ids(spark, tok):
    got = rans.round_trip(simple(spark, ["a b", None]), TOKENIZER, 2).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(whole(tok, "a b")) + 1, 1]


SPECIAL = ["<|endoftext|>", "foo <|endoftext|> bar", "in<|endoftext|>side a word", "a<|endoftext|>  b \n<|endoftext|>\n\nc <|endoftext",
           "no special token"]


def test_special_tokens_are_single_ids(spark):
    from adlens.llm.tokens import encoder
    default = Tokenizer.from_file(TOKENIZER)
    special = default.token_to_id("<|endoftext|>")
    coded = [whole(default, t) for t in SPECIAL]
    assert [(a == special).sum() for a in coded] == [1, 1, 1, 2, 0] and len(coded[0]) == 1 and len(coded[1]) == 4
    rnd = random.Random(3)
    chars = list("ab '!?.,1é漢<|") + list(_WHITE.replace("-", "")) + ["<|endoftext|>"] * 8 + ["'s", "  ", "\n\n", " \n"]
    texts = SPECIAL + ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    e = encoder(TOKENIZER)
    assert e.splits
    for t, raw in zip(texts, e.encode(texts)):
        assert (e.ids(raw) == whole(default, t)).all(), repr(t)
    df = simple(spark, SPECIAL)
    files = rans.round_trip(df, TOKENIZER, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, files), key=repr) == stream(default, list(enumerate(SPECIAL)), 2)
    want = [(i, 0, 0, len(a) + 1, zlib.crc32(whole(default, t, 0).tobytes())) for i, (t, a) in enumerate(zip(SPECIAL, coded))]
    assert sorted(tuple(r)[:5] for r in packing.pack_documents(df, TOKENIZER, 0, 64).collect()) == want
    got = histogram.context_limits(histogram.length_histogram(df, TOKENIZER)).collect()
    assert {r["context_limit"]: r["documents"] for r in got} == {n: [len(a) for a in coded].count(n) for n in map(len, coded)}


def test_added_tokens_that_forbid_cuts():
    from tokenizers import AddedToken
    from adlens.llm.tokens import _stays_whole
    assert _stays_whole(AddedToken("<|endoftext|>"))
    for bad in (AddedToken("two words"), AddedToken("word"), AddedToken("--"), AddedToken("<|x|>", lstrip=True), AddedToken("<|x|>", rstrip=True)):
        assert not _stays_whole(bad)


def test_full_pieces_keep_to_every_capacity(spark):
    df = simple(spark, [words(200, 1)])
    assert packing.pack_documents(df, TOKENIZER, 0, 64, max_attention=64 * 64).count() > 3
    with pytest.raises(Exception, match="exceeds a sequence's capacities"):
        packing.pack_documents(df, TOKENIZER, 0, 64, max_attention=64 * 64 - 1).collect()
