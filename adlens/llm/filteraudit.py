"""How five corpus filters interact: what each removes in every order of application.

Each document gets a mask with one bit for each filter it fails (A too few words, B too few
different words, C too many capitals, D odd characters, E a text that a smaller doc_id has).
All figures are sums over masks, so the table is reduced to counts by (part, mask, labels)
before any order is looked at: 80 combinations of (filters before, filter) per part give all
120 orders.

E needs the smallest id of every text without moving all texts:

1. The *sketch* is a counting Bloom filter over the hashes of the texts, ``PLACES`` counters
   to a text in one block of 64. Every task counts its own rows (partial aggregation) and
   the counts are added up. A text one of whose counters is 1 stands once in the table. What
   is kept of a block is the mask of the counters above 1.
2. Only texts all of whose counters are above 1 go through the shuffle, one row for each text
   and task; there they are grouped by the full text, with their smallest id.
3. The classes go back to the rows by the hash alone, which is narrow; hashes that different
   texts share are settled by the full text.

The blocks are broadcast. Their number follows the number of rows up to ``MAX_BLOCKS`` (a
row of 16 bytes each); beyond that counters fill up, so that more texts than necessary are
grouped, and the result stays the same.

Defined results: a null text is empty (and equal to other empty ones); a null source is the
part with the empty name; rows without an id neither fail E nor make others fail it; rows
with the same id and text don't fail E by each other; repeated label rows count as the
larger value, missing labels as 0; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from adlens.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
PLACES = 3
#: Blocks of 64 counters; one for each so many rows, up to a table of about 130 MB.
ROWS_PER_BLOCK, MAX_BLOCKS = 4, 1 << 22


def failures(text: Column) -> Column:
    """The bits (A = 1, B = 2, C = 4, D = 8) of the conditions on the text alone."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    conditions = (n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text and mask of A to D of every row."""
    text = F.col("whole")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), _text().alias("whole"))
            .select("doc_id", "part", text_hash(text).alias("hash"), failures(text).alias("mask")))


def _block(hash_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(hash_, F.lit(1)), F.lit(blocks))


def _place(hash_: Column, k: int) -> Column:
    """The k-th of the ``PLACES`` counters of a text in its block."""
    return F.shiftright(hash_, 6 * k).bitwiseAND(F.lit(63)).cast("int")


def sketch(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, above): the merged counters of the hashes in ``rows``; bit p of ``above`` is set where counter p is over 1."""
    places = F.array_distinct(F.array(*(_place(F.col("hash"), k) for k in range(PLACES))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    return (rows.select(_block(F.col("hash"), blocks).alias("block"), F.explode(places).alias("place"))
            .groupBy("block", "place").agg(F.count("*").alias("n")).filter("n > 1")
            .groupBy("block").agg(F.bit_or(one).alias("above")))


def may_repeat(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """The rows whose counters all are above 1."""
    need = F.lit(0).cast("long")
    for k in range(PLACES):
        need = need.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("hash"), k)))
    met = rows.withColumn("block", _block(F.col("hash"), blocks)).join(F.broadcast(merged), "block")  # MAX_BLOCKS rows at most
    return met.filter(F.col("above").bitwiseAND(need) == need).drop("block", "above")


def repeated(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (of :func:`judged`) with the bit of E added to the mask."""
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n // ROWS_PER_BLOCK)))
    merged = written(sketch(rows, blocks), "sketch")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("whole")).filter("doc_id is not null")
    possible = may_repeat(texts.withColumn("hash", text_hash(F.col("whole"))), merged, blocks)
    # grouped by the full text: the partial aggregates send each text once a task
    classes = written(possible.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                      .select(text_hash(F.col("whole")).alias("hash"), "first", "last"), "classes")
    per = classes.groupBy("hash").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
    lone = per.filter("texts = 1 and first < last").select("hash", "first")
    out = _with_e(rows.join(lone, "hash", "left"))
    shared = written(per.filter("texts > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return out
    # different texts with one hash: settled by the texts themselves
    own = docs.withColumns({"whole": _text(), "hash": text_hash(_text())}).join(shared, "hash", "left_semi")
    firsts = (own.filter("doc_id is not null").groupBy("whole").agg(F.min(F.col("doc_id").cast("long")).alias("first")))
    settled = (own.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                          failures(F.col("whole")).alias("mask"), "whole").join(firsts, "whole", "left"))
    return out.join(shared, "hash", "left_anti").select("doc_id", "part", "mask").unionByName(_with_e(settled).select("doc_id", "part", "mask"))


def _with_e(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)).drop("first")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and the number n of rows with them; written once."""
    rows = repeated(docs, written(judged(docs), "judged")).select("doc_id", "part", "mask")
    value = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1).otherwise(0)), F.lit(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(value("quality"), value("toxic"))
    named = rows.filter("doc_id is not null").join(marks, F.col("doc_id") == F.col("of"), "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    nameless = rows.filter("doc_id is null").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    every = named.select("part", "mask", mark("quality"), mark("toxic")).unionByName(nameless)
    return written(every.groupBy("part", "mask", "quality", "toxic").agg(F.count("*").alias("n")), "masks")


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the filters before, bit of the filter) of all steps of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = orders()
    combinations = sorted({(before, bit) for _, _, before, bit in steps})
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("before"), F.lit(f).alias("bit")) for p, f in combinations)))
    at = mask_counts(docs, labels).withColumn("c", each).select("*", "c.before", "c.bit")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = written(at.groupBy("part", "before", "bit").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails & (F.col("quality") == 1)).alias("good_lost"),
        total(~gone & fails & (F.col("toxic") == 1)).alias("toxic_lost")), "combinations")
    # so many of the 120 orders have just these filters before this one
    times = F.element_at(F.array(*(F.lit(factorial(i) * factorial(4 - i)) for i in range(5))), F.bit_count("before") + 1)
    shapley = per.groupBy("part", "bit").agg(F.sum(F.col("removed") * times).alias("shapley"))
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return (per.join(shapley, ["part", "bit"]).join(F.broadcast(table), ["before", "bit"])  # 600 rows
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
