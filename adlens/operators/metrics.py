"""KPI summary, segment tables and calendar-period tables (scope-aware).

All aggregates are plain ``groupBy``/``groupingSets`` so Spark combines partial
sums map-side before the shuffle: a hot scope (one advertiser with a third of all
rows) shuffles one partial row per map task, not its raw rows. Top-N per scope is
a ``row_number`` filter, which Spark plans as a WindowGroupLimit applied before
the exchange as well as after it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import MEASURES, PERIOD_GRAINS, SEGMENT_DIMENSIONS, SEGMENT_LIMIT
from adlens.functions.calendar import period_label
from adlens.functions.columns import with_rates


def measure_sums(cols: Sequence[str] = MEASURES) -> list[Column]:
    """Σ of each measure as DOUBLE (exact when the inputs are integer / decimal)."""
    return [F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]


def top_n(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int,
          rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of each ``partition`` group by ``order``.

    With no partition columns this is ``orderBy().limit()`` (TakeOrderedAndProject:
    a per-partition top-n, then a merge of at most n rows per partition).
    """
    if not partition and rank_col is None:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*partition).orderBy(*order)
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def kpi_summary(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Row count, the six measure sums and the five ratios of sums, per scope."""
    agg = fact.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), *measure_sums())
    return with_rates(agg)


def segment_table(fact: DataFrame, dimension: str, scope: Sequence[str] = (), limit: int | None = SEGMENT_LIMIT,
                  rank_col: str | None = None) -> DataFrame:
    """Measures and ratios per value of ``dimension``; top ``limit`` by cost (ties by name)."""
    agg = with_rates(fact.groupBy(*scope, dimension).agg(*measure_sums()))
    if limit is None:
        return agg
    return top_n(agg, list(scope), [F.desc("cost"), F.asc(dimension)], limit, rank_col)


def segments_all(fact: DataFrame, scope: Sequence[str] = (), limit: int | None = SEGMENT_LIMIT,
                 segments: dict[str, str] = SEGMENT_DIMENSIONS) -> DataFrame:
    """All five segment tables from one scan and one exchange (GROUPING SETS).

    Long format: ``segment`` names the table, ``segment_value`` the group.
    """
    scope = list(scope)
    dims = list(segments.values())
    sets = [scope + [d] for d in dims]
    agg = fact.groupingSets(sets, *scope, *dims).agg(
        *measure_sums(), *[F.grouping(d).alias(f"_g_{i}") for i, d in enumerate(dims)])
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, (seg, d) in enumerate(segments.items()):
        name = F.when(F.col(f"_g_{i}") == 0, F.lit(seg)).otherwise(name)
        value = F.when(F.col(f"_g_{i}") == 0, F.col(d)).otherwise(value)
    out = with_rates(agg.select(*scope, name.alias("segment"), value.alias("segment_value"), *MEASURES))
    if limit is None:
        return out
    return top_n(out, scope + ["segment"], [F.desc("cost"), F.asc("segment_value")], limit, "segment_rank")


def _period_aggs() -> list[Column]:
    return [F.min("date").cast("date").alias("period_start"), F.max("date").cast("date").alias("period_end"),
            F.count(F.lit(1)).alias("rows"), *measure_sums()]


def period_table(fact: DataFrame, grain: str, scope: Sequence[str] = ()) -> DataFrame:
    """Per-calendar-bucket table for one grain; undated rows are dropped."""
    dated = fact.where(F.col("date").isNotNull())
    agg = dated.groupBy(*scope, period_label(grain, "date").alias("period_label")).agg(*_period_aggs())
    return with_rates(agg)


def periods_all(fact: DataFrame, scope: Sequence[str] = (), grains: Sequence[str] = PERIOD_GRAINS) -> DataFrame:
    """All seven grains from one scan and one exchange (GROUPING SETS over the labels)."""
    scope = list(scope)
    labels = {f"_l_{g}": period_label(g, "date") for g in grains}
    dated = fact.where(F.col("date").isNotNull()).select(*scope, "date", *MEASURES, *[v.alias(k) for k, v in labels.items()])
    keys = list(labels)
    agg = dated.groupingSets([scope + [k] for k in keys], *scope, *keys).agg(
        *_period_aggs(), *[F.grouping(k).alias(f"_g{k}") for k in keys])
    grain = F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for g, k in zip(grains, keys):
        grain = F.when(F.col(f"_g{k}") == 0, F.lit(g)).otherwise(grain)
        label = F.when(F.col(f"_g{k}") == 0, F.col(k)).otherwise(label)
    out = agg.select(*scope, grain.alias("grain"), label.alias("period_label"), "period_start", "period_end", "rows",
                     *MEASURES)
    return with_rates(out)


def month_week_periods(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The monthly and weekly rows of :func:`periods_all`, with each row of the fact taken once.

    The fact is reduced to the parts that months cut weeks into; only these are dealt by scope, where both
    grains' sums, and windows of the scope, need no further exchange.
    """
    scope = list(scope)
    day = F.col("date").cast("date")
    parts = fact.where(F.col("date").isNotNull()).groupBy(
        *scope, F.trunc(day, "week").alias("_week"), F.trunc(day, "month").alias("_month")).agg(
        F.min("date").cast("date").alias("period_start"), F.max("date").cast("date").alias("period_end"),
        F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in MEASURES])
    if scope:
        parts = parts.repartition(*scope)
    grains = [F.struct(F.lit(g).alias("grain"), period_label(g, "period_start").alias("period_label")) for g in ("monthly", "weekly")]
    both = parts.select(*scope, F.inline(F.array(*grains)), "period_start", "period_end", "rows", *MEASURES)
    return with_rates(both.groupBy(*scope, "grain", "period_label").agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.sum("rows").alias("rows"),
        *measure_sums()))


def date_bounds(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """First and last day with data, and the number of undated rows, per scope."""
    return fact.groupBy(*scope).agg(F.min("date").cast("date").alias("min_date"),
                                    F.max("date").cast("date").alias("max_date"),
                                    F.count_if(F.col("date").isNull()).alias("undated_rows"))
