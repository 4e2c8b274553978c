"""Rule engine: thresholds, anomalies and recommendations.

The anomaly base is the campaign segment table after its top-20 cut, so every
per-scope computation here runs over at most 20 rows per scope; the exact
percentiles are window aggregates over that bounded set.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.session import materialize

from adlens.constants import (CORE_ACTIVITY, HIGH_IMPRESSION_QUANTILE, LABEL_PRECEDENCE, LOW_CTR_FLOOR,
                              LOW_CTR_QUANTILE, NO_CONVERSION_COST_QUANTILE, NO_CONVERSION_SPEND_SHARE,
                              RULE_LOW_CTR, RULE_NO_CONVERSION, RULE_SCALE, SCALE_ROAS, SEGMENT_LIMIT)
from adlens.constants import MEASURES
from adlens.functions.columns import first_valid, with_rates
from adlens.operators.metrics import kpi_summary, measure_sums, segment_table, top_n
from adlens.operators.scoped import attach

# rule_code -> (priority, recommended action, expected effect); our own wording.
RECOMMENDATION_CATALOG = {
    RULE_NO_CONVERSION: ("P1", "lower bids or budget, or exclude the search terms", "cut wasted spend"),
    RULE_LOW_CTR: ("P2", "review creative copy, product names and keyword match types", "lift click-through rate"),
    RULE_SCALE: ("P2", "raise the daily budget or extend to similar keywords and products", "grow conversion volume"),
}
DEFAULT_RECOMMENDATION = ("P3", "expert review", "lower operating risk")
NO_CONVERSION_DATA = ("P1", "no_conversion_data", "check conversion tracking and the raw data by period and media",
                      "trustworthy analysis", "high")
NO_URGENT_POINT = ("P3", "no_urgent_point", "review top-spend and top-ROAS campaigns", "find improvement candidates",
                   "low")
ALL_ACCOUNTS = "all"


def rule_aggregates(fact: DataFrame, scope: Sequence[str] = (), shared: bool = True,
                    platforms: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(per scope × campaign, per scope × platform) raw sums from ONE scan and ONE exchange.

    Every rule-engine output (summary, anomaly base, primary platform) derives from
    these two small tables; sums keep the input types (exact for integer / decimal
    measures), so a scope summary re-aggregated from campaigns equals a direct sum.
    The aggregate is small (one row per scope × campaign / platform) and is written
    once as a table under the shared checkpoint folder: its many consumers prune
    different columns, which defeats exchange reuse, so without it the fact would be
    rescanned once per consumer. The written table also survives executor loss.
    ``shared=False`` (a single consumer) keeps it lazy. Only issues need the platforms, and
    of them the cost alone; ``platforms=False`` leaves them out (None), and with them half
    of what small scopes shuffle.
    """
    scope = list(scope)
    sums = [F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in MEASURES]]
    if not platforms:
        campaigns = fact.groupBy(*scope, "campaign_name").agg(*sums)
        return materialize(campaigns, "rule-aggregates") if shared else campaigns, None
    kinds = dict(fact.dtypes)
    by_campaign = F.struct(F.lit(True).alias("_campaign"), F.col("campaign_name").alias("_name"), *MEASURES)
    by_platform = F.struct(F.lit(False).alias("_campaign"), F.col("platform").alias("_name"), *[
        F.col(m) if m == "cost" else F.lit(None).cast(kinds[m]).alias(m) for m in MEASURES])
    agg = fact.select(*scope, F.inline(F.array(by_campaign, by_platform))).groupBy(*scope, "_campaign", "_name").agg(*sums)
    if shared:
        agg = materialize(agg, "rule-aggregates")
    return (agg.where("_campaign").select(*scope, F.col("_name").alias("campaign_name"), "rows", *MEASURES),
            agg.where(~F.col("_campaign")).select(*scope, F.col("_name").alias("platform"), "cost"))


def summary_from_campaigns(campaigns: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """KPI summary per scope re-aggregated from the campaign sums."""
    agg = campaigns.groupBy(*scope).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *measure_sums())
    return with_rates(agg)


def base_from_campaigns(campaigns: DataFrame, scope: Sequence[str] = (), limit: int = SEGMENT_LIMIT) -> DataFrame:
    """Campaign table (DOUBLE sums + ratios) after the top-``limit`` cut by cost, ties by name."""
    typed = with_rates(campaigns.select(*scope, "campaign_name",
                                        *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in MEASURES]))
    return top_n(typed, list(scope), [F.desc("cost"), F.asc("campaign_name")], limit, "base_rank")


def anomaly_base(fact: DataFrame, scope: Sequence[str] = (), limit: int = SEGMENT_LIMIT) -> DataFrame:
    """Campaign segment table after the top-``limit`` cut, with ``base_rank`` (1 = highest cost)."""
    return segment_table(fact, "campaign_name", scope, limit, rank_col="base_rank")


def with_thresholds(base: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Add the per-scope thresholds and the no-activity gate as window aggregates over the base."""
    w = Window.partitionBy(*scope)
    inactive = F.lit(True)
    for c in CORE_ACTIVITY:
        inactive = inactive & (F.sum(c).over(w) <= 0)
    return base.withColumns({
        "no_conversion_cost_threshold": F.greatest(F.percentile("cost", NO_CONVERSION_COST_QUANTILE).over(w),
                                                   F.sum("cost").over(w) * NO_CONVERSION_SPEND_SHARE),
        "high_impression_threshold": F.percentile("impressions", HIGH_IMPRESSION_QUANTILE).over(w),
        "low_ctr_threshold": F.greatest(F.percentile("ctr", LOW_CTR_QUANTILE).over(w), F.lit(LOW_CTR_FLOOR)),
        "inactive": inactive,
    })


def thresholds(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per scope with the three rule thresholds."""
    t = with_thresholds(anomaly_base(fact, scope), scope)
    return t.groupBy(*scope).agg(*[F.first(c).alias(c) for c in
                                   ["no_conversion_cost_threshold", "high_impression_threshold", "low_ctr_threshold"]])


def _rule(seq: int, severity: str, code: str, cond: Column) -> Column:
    return F.when(cond, F.struct(F.lit(seq).alias("rule_seq"), F.lit(severity).alias("severity"),
                                 F.lit(code).alias("rule_code")))


def anomalies_from_base(base: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    t = with_thresholds(base, scope)
    c = F.col
    rules = F.array(
        _rule(1, "high", RULE_NO_CONVERSION,
              (c("cost") >= c("no_conversion_cost_threshold")) & (c("conversions") <= 0)),
        _rule(2, "medium", RULE_LOW_CTR,
              (c("impressions") >= c("high_impression_threshold")) & (c("ctr") <= c("low_ctr_threshold"))),
        _rule(3, "opportunity", RULE_SCALE, (c("cost") > 0) & (c("roas") >= SCALE_ROAS) & (c("conversions") > 0)),
    )
    labels = [x for x in LABEL_PRECEDENCE if x in base.columns]
    fired = t.where(~c("inactive")).select(
        *scope, "base_rank", first_valid(*labels).alias("target"), "cost", "ctr", "cvr", "roas",
        F.filter(rules, lambda r: r.isNotNull()).alias("_fired"))
    return fired.select(*scope, "base_rank", F.inline("_fired"), "target", "cost", "ctr", "cvr", "roas")


def anomalies(fact: DataFrame, scope: Sequence[str] = (), limit: int = SEGMENT_LIMIT,
              aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rule hits over the campaign base: spend without conversion (high), low CTR at
    volume (medium), scale candidate (opportunity); a row may fire several rules."""
    campaigns = (aggregates or rule_aggregates(fact, scope, shared=False, platforms=False))[0]
    return anomalies_from_base(base_from_campaigns(campaigns, scope, limit), scope)


def scope_state(fact: DataFrame, anomaly_rows: DataFrame, scope: Sequence[str] = (),
                aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per scope: KPI summary, anomaly counts by severity and the anomalies as an array (``hits``; bounded by the base, null without any)."""
    hit = F.struct("base_rank", "rule_seq", "severity", "rule_code", "target", "cost", "ctr", "cvr", "roas")
    counts = anomaly_rows.groupBy(*scope).agg(
        F.collect_list(hit).alias("hits"),
        F.count(F.lit(1)).alias("n_anomalies"),
        F.count_if(F.col("severity") == "high").alias("n_high"),
        F.count_if(F.col("severity") == "medium").alias("n_medium"),
        F.count_if(F.col("severity") == "opportunity").alias("n_opportunity"))
    summary = summary_from_campaigns(aggregates[0], scope) if aggregates else kpi_summary(fact, scope)
    state = attach(summary, counts, scope)
    return state.fillna(0, subset=["n_anomalies", "n_high", "n_medium", "n_opportunity"])


def _catalog_map(pos: int) -> Column:
    return F.create_map(*[x for k, v in RECOMMENDATION_CATALOG.items() for x in (F.lit(k), F.lit(v[pos]))])


def recommendations(fact: DataFrame, scope: Sequence[str] = (), anomaly_rows: DataFrame | None = None,
                    aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One recommendation per anomaly; a fallback row for a scope without anomalies.

    A scope with no measurable activity (no rows, or every core sum ≤ 0) gets none.
    """
    scope = list(scope)
    aggs = aggregates or rule_aggregates(fact, scope, platforms=False)
    a = anomaly_rows if anomaly_rows is not None else anomalies(fact, scope, aggregates=aggs)
    state = scope_state(fact, a, scope, aggs)
    active =~((F.col("rows") <= 0) | (F.col("impressions") <= 0) & (F.col("clicks") <= 0) & (F.col("cost") <= 0)
               & (F.col("conversions") <= 0) & (F.col("revenue") <= 0))
    text = "priority", "target", "issue", "recommended_action", "expected_effect", "risk_level"

    def row(rec_no: Column, rule_seq: Column, *values: Column) -> Column:
        return F.struct(rec_no.alias("rec_no"), rule_seq.alias("rule_seq"), *[v.alias(n) for n, v in zip(text, values)])

    def from_hit(h: Column) -> Column:
        named = [F.coalesce(_catalog_map(i)[h["rule_code"]], F.lit(DEFAULT_RECOMMENDATION[i])) for i in range(3)]
        return row(h["base_rank"], h["rule_seq"], named[0], h["target"], h["rule_code"], named[1], named[2], h["severity"])

    no_conv = (F.col("cost") > 0) & (F.col("conversions") == 0)

    def pick(i: int) -> Column:
        return F.when(no_conv, F.lit(NO_CONVERSION_DATA[i])).otherwise(F.lit(NO_URGENT_POINT[i]))

    fallback = row(F.lit(0), F.lit(0), pick(0), F.lit(ALL_ACCOUNTS), pick(1), pick(2), pick(3), pick(4))
    # a scope's hits are at most three for each campaign of the base: rows from rules and fallbacks come from one pass
    return state.where(active).select(*scope, F.inline(F.when(F.col("n_anomalies") == 0, F.array(fallback)).otherwise(
        F.transform("hits", from_hit))))
