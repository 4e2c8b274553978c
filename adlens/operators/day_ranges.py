"""Sums over date ranges from one table of days, so that any number of ranges costs one scan.

The fact is reduced once to two rows per scope and day: timestamps at exactly 00:00, and
later ones. A range that ends at a midnight, as the comparisons' and presets' do, takes
both rows of the days inside and only the first row of its last day. Ranges may depend on
the scope's first and last timestamps, which the table knows; days are then matched with the
ranges that hold them. After the first aggregation every step works on days, not on rows.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import MEASURES


def day_key(day: Column, late: Column | bool = False) -> Column:
    """Place of a day's midnight (even) or of the rest of the day (the odd number after it)."""
    late = F.lit(late) if isinstance(late, bool) else late
    return F.unix_date(day.cast("date")).cast("long") * 2 + late.cast("long")


def day_sums(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., key, rows, measure sums, first, last): sums keep the measures' exact types."""
    late = F.col("date") > F.date_trunc("day", "date").cast("timestamp_ntz")
    dated = fact.where(F.col("date").isNotNull())
    return dated.groupBy(*scope, day_key(F.col("date"), late).alias("key")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in MEASURES],
        F.min("date").alias("first"), F.max("date").alias("last"))


def range_sums(fact: DataFrame, scope: Sequence[str],
               ranges: Callable[[Column, Column], Sequence[tuple[Column, Column]]]) -> DataFrame:
    """(scope..., range_no, rows, measure sums, first, last) of every range of every scope, empty ranges included.

    ``ranges`` gets the scope's first and last timestamps and returns (low, high) pairs of
    inclusive :func:`day_key` places. A scope without a dated row has no ranges.
    """
    scope = list(scope)
    whole = Window.partitionBy(*scope)  # without a scope: two rows a day in one task
    days = day_sums(fact, scope).withColumns({
        "first": F.min("first").over(whole), "last": F.max("last").over(whole),
        "_lead": F.row_number().over(whole.orderBy("key")) == 1})
    each = [F.struct(F.lit(i).alias("range_no"), low.alias("low"), high.alias("high"))
            for i, (low, high) in enumerate(ranges(F.col("first"), F.col("last")))]
    inside = lambda r: F.col("_lead") | ((F.col("key") >= r["low"]) & (F.col("key") <= r["high"]))
    met = days.withColumn("r", F.explode(F.filter(F.array(*each), inside)))
    # a scope's first day stands for every range, so that empty ones get a row of zeros
    counts = (F.col("key") >= F.col("r.low")) & (F.col("key") <= F.col("r.high"))
    return met.groupBy(*scope, F.col("r.range_no").alias("range_no")).agg(
        F.coalesce(F.sum(F.when(counts, F.col("rows"))), F.lit(0)).alias("rows"),
        *[F.sum(F.when(counts, F.col(m))).alias(m) for m in MEASURES],
        F.min("first").alias("first"), F.max("last").alias("last"))
