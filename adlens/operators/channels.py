"""Sales-channel KPIs, group rollups, benchmark gaps and the channel review.

Channel tables hold one row per (scope, channel); every operator here is a
grouped aggregate or a join against the fixed 4-row benchmark dimension, which
is broadcast because its size is fixed by the catalog, not by the data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from adlens.constants import CHANNEL_GROUP_TARGET_ROAS, DEFAULT_TARGET_ROAS, LTV_FACTOR
from adlens.functions.columns import safe_div
from adlens.functions.formatting import fmt_count, fmt_money, fmt_percent
from adlens.operators.scoped import attach


def active_channels(registry: DataFrame) -> DataFrame:
    """Active registry rows in display order (then group, then name)."""
    return registry.where(F.col("is_active")).orderBy("display_order", "channel_group", "channel_name")


def integrated_kpis(metrics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Totals over channels: revenue, ad cost, orders, conversions, new customers; ROAS,
    AOV = revenue/orders, CAC = cost/new customers, LTV = AOV × 2.6, mean repeat rate."""
    agg = metrics.groupBy(*scope).agg(
        *[F.sum(c).cast("double").alias(c) for c in ["revenue", "ad_cost", "orders", "conversions", "new_customers"]],
        F.avg("repeat_purchase_rate").alias("repeat_purchase_rate"))
    aov = safe_div("revenue", "orders")
    return agg.select(*scope, "revenue", "ad_cost", "orders", "conversions", "new_customers",
                      safe_div("revenue", "ad_cost").alias("roas"), aov.alias("aov"),
                      safe_div("ad_cost", "new_customers").alias("cac"), (aov * LTV_FACTOR).alias("ltv"),
                      "repeat_purchase_rate")


def benchmark_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, float(v)) for g, v in CHANNEL_GROUP_TARGET_ROAS.items()],
                                 "channel_group string, benchmark_roas double")


def group_rollup(metrics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Revenue, ad cost and channel count per channel group; catalog groups without
    channels are kept with zeros (left join from the group dimension)."""
    spark = metrics.sparkSession
    per = metrics.groupBy(*scope, "channel_group").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("ad_cost").cast("double").alias("ad_cost"),
        F.count(F.lit(1)).alias("channels"))
    keys = [*scope, "channel_group"]
    groups = benchmark_dimension(spark).select("channel_group")
    if scope:  # each scope gets every group of the (fixed) catalog
        names = [r["channel_group"] for r in groups.collect()]
        groups = metrics.select(*scope).distinct().withColumn("channel_group", F.explode(F.array(*map(F.lit, names))))
    groups = groups.unionByName(per.select(*keys)).distinct()
    return groups.join(per, keys, "left").fillna({"revenue": 0.0, "ad_cost": 0.0, "channels": 0})


def channel_benchmark(metrics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Gap of each channel's ROAS to its group's target (default 3.5), ranked by gap."""
    bench = F.broadcast(benchmark_dimension(metrics.sparkSession))
    j = metrics.join(bench, "channel_group", "left")
    target = F.coalesce(F.col("benchmark_roas"), F.lit(DEFAULT_TARGET_ROAS))
    out = j.select(*scope, "channel_name", "channel_group", F.col("roas").alias("current_roas"),
                   target.alias("benchmark_roas"), (F.col("roas") - target).alias("gap"),
                   F.when(F.col("roas") >= target, F.lit("above_benchmark")).otherwise(F.lit("below_benchmark"))
                   .alias("status"))
    w = Window.partitionBy(*scope).orderBy(F.desc("gap"), F.asc("channel_name"))
    return out.withColumn("gap_rank", F.row_number().over(w))


def channel_review(metrics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Among channels with ad spend: weakest and best ROAS channel and the mean ROAS."""
    active = metrics.where(F.col("ad_cost") > 0)
    key = F.struct(F.col("roas"), F.col("channel_name"))  # ties broken by channel name
    return active.groupBy(*scope).agg(
        F.max_by("channel_name", key).alias("best_channel"),
        F.max("roas").alias("best_roas"),
        F.min_by("channel_name", key).alias("weak_channel"),
        F.min("roas").alias("weak_roas"),
        F.avg("roas").alias("avg_roas"),
        F.count(F.lit(1)).alias("active_channels"))


def share_of_max(value: Column, max_value: Column) -> Column:
    """Bar width in percent: clamp(value / max × 100, 2, 100); 0 when max ≤ 0."""
    return F.when(max_value <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.least(value / max_value * 100, F.lit(100.0)), F.lit(2.0)))


def revenue_bars(metrics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each channel's revenue as a share-of-max bar (max per scope)."""
    m = metrics.withColumn("revenue", F.col("revenue").cast("double"))
    mx = m.groupBy(*scope).agg(F.max("revenue").alias("_max"))
    j = attach(m.select(*scope, "channel_name", "revenue"), mx, scope)
    return j.select(*scope, "channel_name", "revenue", share_of_max(F.col("revenue"), F.col("_max")).alias("bar_pct"))


def channel_display(metrics: DataFrame) -> DataFrame:
    """Display strings: money with '원', counts with separators, ratios as percent."""
    return metrics.select(
        "channel_name", "channel_group", fmt_money("revenue").alias("revenue"), fmt_money("ad_cost").alias("ad_cost"),
        fmt_count("orders").alias("orders"), fmt_count("conversions").alias("conversions"),
        fmt_count("new_customers").alias("new_customers"),
        fmt_percent("repeat_purchase_rate").alias("repeat_purchase_rate"), fmt_percent("roas").alias("roas"))
