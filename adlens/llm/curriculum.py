"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all
words; a target stops at ``MAX_REPEATS`` times its source's size and the excess is shared
anew by weight until none is above. That fixed point is ``least(cap, level * weight)`` with
one common level, found with prefix sums over the sources in the order in which they reach
their caps.

Positions: every source has a weight schedule over training time 0..1. Its integral,
scaled to the target, is the source's cumulative token demand; a document copy whose words
are the source's words from ``c`` on stands where that demand reaches the copy's middle,
which inverts the demand. Schedules are straight lines, so the inverse is a closed form.

A source's words are laid out in a fixed pseudo-random order (md5 of id and text) and repeated:
pass ``k`` covers the demand from ``k`` sizes on. A document is taken once for each pass in
which its middle lies before the target, and one copy of one document per source mends what
whole documents miss; no document is taken more than ``MAX_REPEATS`` times. Every copy taken
has a training position; copies are range-sorted by it, and what a document contributes is
summed over its positions.

Scale: sizes and per-source sums combine before the shuffle. The order inside a source is
cut into cells by the md5 prefix, many for a large source, so a hot source is summed over
many tasks; a cell's start is a prefix sum over the per-cell totals. Only the table of
sources (one row each) is handled in one task.

Defined results: null texts have size 0 and are taken as often as the words around them;
null sources are a source, the last; rows without an id are documents like others (their
text spreads them over the order); repeated rows are documents of their own; an empty table
gives an empty result; other columns are not read by :func:`mix` and kept by
:func:`training_order`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from adlens.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
CELL_ROWS = 4096
#: Slopes of the weight schedules, repeating over the sources: weight 1 + slope * (2 t - 1) at time t.
SLOPES = (0.0, -0.5, 0.5)


def sizes(docs: DataFrame, place: Column | None = None) -> DataFrame:
    """doc_id, source, size and the place in the order (md5 of id and text), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if place is None:
        place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\n"), text).cast("binary"))
    return written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), place.alias("place")), "sizes")


def targets(rows: DataFrame) -> DataFrame:
    """source, number, weight, n_docs, source_size, target of every source."""
    per = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    s = (per.withColumn("number", F.row_number().over(by_name) - 1)
         .withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
         .withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double")))
    reach = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({
        "free_weight": F.sum("weight").over(reach.rowsBetween(0, Window.unboundedFollowing)),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(whole).cast("double"),
    })
    # the level if this source and all that cap later are free; the first such source below its cap sets it
    level = (F.col("total") - F.col("capped")) / F.col("free_weight")
    s = s.withColumn("level", level)
    s = s.withColumn("turn", F.row_number().over(reach))
    below = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    s = s.withColumn("common", F.min(below).over(whole)["level"])
    return s.select("source", "number", "weight", "n_docs", "source_size",
                    F.least(F.col("cap"), F.col("common") * F.col("weight")).alias("target"))


def _cell(place: Column, n_docs: Column) -> Column:
    cells = F.ceil(n_docs / CELL_ROWS)
    head = F.conv(F.substring(F.rpad(place, 8, "0"), 1, 8), 16, 10).cast("long")
    return F.floor(head * cells / F.lit(1 << 32)).cast("long")


def mix(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`sizes` with source_size, target, copies, taken and the start of the words in the source."""
    sources = written(targets(rows), "sources")
    s = sources.select(F.col("source").alias("of"), "number", "n_docs", "source_size", "target")
    placed = rows.join(s, F.col("source").eqNullSafe(F.col("of"))).withColumn("cell", _cell(F.col("place"), F.col("n_docs")))
    cells = placed.groupBy("number", "cell").agg(F.sum("size").alias("in_cell"))
    earlier = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("number").alias("n"), F.col("cell").alias("c"),
                         F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("number", "cell").orderBy("place", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    started = placed.withColumn("in_cell_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = started.join(cells, (F.col("number") == F.col("n")) & (F.col("cell") == F.col("c")))
    start = F.col("before") + F.col("in_cell_start")
    middle = start + F.col("size") / F.lit(2.0)
    passes = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - middle) / F.col("source_size"))).otherwise(1)
    copies = F.least(F.lit(MAX_REPEATS), F.greatest(F.lit(0), passes)).cast("long")
    laid = written(out.select("doc_id", "source", "number", "size", "place", "source_size", "target",
                              start.alias("start"), copies.alias("copies")), "laid")
    return _corrected(laid).withColumn("taken", F.col("copies") * F.col("size"))


def _corrected(laid: DataFrame) -> DataFrame:
    """One copy of one document more or less per source, where that brings the source nearer to its target.

    Laying out whole documents misses the target by up to half a document; the document whose
    size is nearest to the miss mends most of it.
    """
    sums = laid.groupBy(F.col("number").alias("n")).agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
    miss, gain = F.col("miss"), F.abs(F.abs(F.col("miss")) - F.col("size"))
    can = F.when(miss > 0, F.col("copies") < MAX_REPEATS).otherwise(F.col("copies") > 0) & (gain < F.abs(miss))
    rows = laid.join(sums, F.col("number") == F.col("n"))
    one = rows.filter(can).groupBy("n").agg(F.min(F.struct(gain.alias("gain"), "place", "doc_id", "start")).alias("one"))
    one = one.select(F.col("n").alias("m"), "one.place", "one.doc_id", "one.start")
    same = ((laid["number"] == one["m"]) & (laid["place"] == one["place"])
            & laid["doc_id"].eqNullSafe(one["doc_id"]) & (laid["start"] == one["start"]))
    less = sums.select(F.col("n"), F.signum("miss").cast("long").alias("change"))
    step = one.join(less, one["m"] == less["n"])
    return (laid.join(step, same, "left")
            .select(*(laid[c] for c in laid.columns if c != "copies"),
                    (laid["copies"] + F.when((laid["size"] > 0) & F.col("change").isNotNull(), F.col("change")).otherwise(0))
                    .alias("copies")))


def slope(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(x)) for x in SLOPES)), (number % len(SLOPES) + 1).cast("int"))


def position(demand: Column, number: Column) -> Column:
    """The training time in 0..1 at which the share ``demand`` of a source's words has been used.

    The integral of 1 + s (2 t - 1) is t + s (t^2 - t); its inverse is the root in 0..1.
    """
    s, q = slope(number), F.least(F.lit(1.0), F.greatest(F.lit(0.0), demand))
    root = 2 * q / ((1 - s) + F.sqrt(F.greatest((1 - s) * (1 - s) + 4 * s * q, F.lit(0.0))))
    return F.least(F.lit(1.0), root)


def copies(mixed: DataFrame) -> DataFrame:
    """One row per taken copy of :func:`mix`'s rows: pass_no (from 0) and position."""
    taken = mixed.filter("copies > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.col("start") + F.col("size") / F.lit(2.0) + F.col("pass_no") * F.col("source_size")
    share = F.when(F.col("target") > 0, at / F.col("target")).otherwise(0.0)
    return taken.withColumn("position", position(share, F.col("number")))


def _partitions(spark: SparkSession, partitions: int | None) -> int:
    return partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))


def schedule(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The copies of :func:`copies` range-sorted by position, with their ``turn`` in training (from 1)."""
    order = ("position", "place", "pass_no", "doc_id")
    at = copies(mixed).repartitionByRange(_partitions(mixed.sparkSession, partitions), *order).sortWithinPartitions(*order)
    at = written(at.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "schedule")
    parts = at.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("least"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = parts.select("part", "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return at.join(starts, "part").withColumn("turn", F.col("before") + F.col("nth") - F.col("least") + 1).drop("nth", "least", "before")


def assigned(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position and first_turn of every document.

    ``taken`` adds up the words at the document's training positions; documents without any
    have null for the last two. Rows are range-sorted by them.
    """
    mixed = written(mix(sizes(docs)).drop("taken").withColumn("row", F.monotonically_increasing_id()), "mixed")
    at = schedule(mixed, partitions)
    per = at.groupBy(F.col("row").alias("of")).agg(
        F.sum("size").alias("words"), F.min("position").alias("first_position"), F.min("turn").alias("first_turn"))
    out = (mixed.join(per, F.col("row") == F.col("of"), "left")
           .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), "first_position", "first_turn"))
    order = (F.col("first_turn").asc_nulls_last(), "doc_id")
    return out.repartitionByRange(_partitions(docs.sparkSession, partitions), *order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per copy, range-sorted by training position.

    Rows are told apart by all their columns, so rows that share an id, or have none, are
    mixed like any others.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    place = F.md5(whole.cast("string").cast("binary"))
    at = copies(mix(sizes(docs, place))).select(F.col("place").alias("of"), "position", "pass_no", "start")
    rows = docs.select(whole.alias("row"), place.alias("place")).dropDuplicates(["place"])
    order = ("position", "place", "pass_no", "start")
    return (rows.join(at, F.col("place") == F.col("of"))
            .repartitionByRange(_partitions(docs.sparkSession, partitions), *order).sortWithinPartitions(*order).select("row.*"))
