"""Shared rows and helpers of the training-data tests."""

import random

import public_tokenizers
from pyspark.sql import types as T

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SMOKE = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("position", T.StringType()), T.StructField("kept_id", T.StringType()), T.StructField("row", T.StringType()),
])


def words(n, seed=0, alphabet=400):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(alphabet)]
    return " ".join(r.choice(names) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    long_text = words(30_000, 1)
    rows = [
        (0, "plain words stand here", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None),
        (4, long_text, "en", "b"), (5, "plain words stand here", "en", "a"), (5, "plain words stand here", "en", "a"),
        (None, "no id at all", "en", "a"), (None, None, None, None), (6, "one", "en", "c"), (7, "two words", "en", "c"),
        (8, "Ünïcode ß   text with odd blanks \u0085 end", "de", "d"), (9, "x" * 50_000, "en", "d"),
        (10, "tie a", "en", "e"), (10, "tie b", "en", "e"),
    ]
    return [(i, t, la, s, len(t) if t else None, "s", "f", "z", "p", "k", "r") for i, t, la, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def simple(spark, texts, sources=None):
    """Documents 0.. of these texts."""
    return spark.createDataFrame([(i, t, None, (sources or [None] * len(texts))[i]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
