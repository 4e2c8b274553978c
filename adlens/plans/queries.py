"""Named queries over the driver tables: the registry behind ``__spark_entry__``.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.constants import PERIOD_GRAINS, SEGMENT_DIMENSIONS
from adlens.functions.columns import with_rates
from adlens.operators import compare, issues, metrics, rules
from adlens.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

# A/B comparison parameters used by the registered A/B queries (user-chosen periods).
AB_RANGES = ("1996-01-01", "1996-12-31", "1997-01-01", "1997-12-31")
BY_ACCOUNT = ("account_name",)


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _fact(spark, sf):
    return tables.ad_fact(spark, sf)


def _segment(dim: str) -> Query:
    return lambda spark, sf: metrics.segment_table(_fact(spark, sf), dim)


def _period(grain: str) -> Query:
    return lambda spark, sf: metrics.period_table(_fact(spark, sf), grain)


def analysis_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "kpi_summary": lambda spark, sf: metrics.kpi_summary(_fact(spark, sf)),
        "kpi_by_account": lambda spark, sf: metrics.kpi_summary(_fact(spark, sf), BY_ACCOUNT),
        "row_rates": lambda spark, sf: with_rates(_fact(spark, sf)),
    }
    for name, dim in SEGMENT_DIMENSIONS.items():
        q[f"segment_{name}"] = _segment(dim)
    q["segments_all"] = lambda spark, sf: metrics.segments_all(_fact(spark, sf))
    q["segment_topn_by_account"] = lambda spark, sf: metrics.segment_table(_fact(spark, sf), "campaign_name",
                                                                           BY_ACCOUNT)
    for g in PERIOD_GRAINS:
        q[f"period_{g}"] = _period(g)
    q["periods_all"] = lambda spark, sf: metrics.periods_all(_fact(spark, sf))
    q["event_period_daily"] = lambda spark, sf: metrics.period_table(tables.event_fact(spark, sf), "daily")
    q["event_kpi_by_account"] = lambda spark, sf: metrics.kpi_summary(tables.event_fact(spark, sf), BY_ACCOUNT)
    q["preset_ranges"] = lambda spark, sf: compare.preset_ranges(_fact(spark, sf))
    q["preset_kpis"] = lambda spark, sf: compare.preset_kpis(_fact(spark, sf))
    q["recent_comparison"] = lambda spark, sf: compare.recent_comparison(_fact(spark, sf), whole_days=True)
    q["recent_comparison_by_account"] = lambda spark, sf: compare.recent_comparison(_fact(spark, sf), BY_ACCOUNT, True)
    q["event_recent_comparison"] = lambda spark, sf: compare.recent_comparison(tables.event_fact(spark, sf))
    a0, a1, b0, b1 = (_d(x) for x in AB_RANGES)
    q["ab_comparison"] = lambda spark, sf: compare.ab_comparison(_fact(spark, sf), a0, a1, b0, b1)
    q["comparison_comments"] = lambda spark, sf: compare.comparison_comments(
        compare.ab_comparison(_fact(spark, sf), a0, a1, b0, b1))
    q["comparison_comments_by_month"] = lambda spark, sf: _monthly_comments(tables.monthly_account_fact(spark, sf))
    q["recommendations_unconverted"] = lambda spark, sf: rules.recommendations(tables.unconverted_fact(spark, sf), BY_ACCOUNT)
    q["thresholds"] = lambda spark, sf: _rounded_thresholds(rules.thresholds(_fact(spark, sf)))
    q["thresholds_by_account"] = lambda spark, sf: _rounded_thresholds(rules.thresholds(_fact(spark, sf), BY_ACCOUNT))
    q["anomalies"] = lambda spark, sf: rules.anomalies(_fact(spark, sf))
    q["anomalies_by_account"] = lambda spark, sf: rules.anomalies(_fact(spark, sf), BY_ACCOUNT)
    q["recommendations"] = lambda spark, sf: rules.recommendations(_fact(spark, sf))
    q["action_issues"] = lambda spark, sf: issues.action_issues(_fact(spark, sf))
    q["action_issues_by_account"] = lambda spark, sf: issues.action_issues(_fact(spark, sf), BY_ACCOUNT)
    q["action_issues_by_month"] = lambda spark, sf: issues.action_issues(tables.monthly_account_fact(spark, sf), BY_ACCOUNT)
    q["recommendations_by_month"] = lambda spark, sf: rules.recommendations(tables.monthly_account_fact(spark, sf),
                                                                            BY_ACCOUNT)
    q["health_score_by_month"] = lambda spark, sf: issues.health_score(tables.monthly_account_fact(spark, sf), BY_ACCOUNT)
    q["recent_comparison_by_month"] = lambda spark, sf: compare.recent_comparison(
        tables.monthly_account_fact(spark, sf), BY_ACCOUNT)
    q["issues_top3"] = lambda spark, sf: issues.top_issues(issues.action_issues(_fact(spark, sf)))
    q["health_score"] = lambda spark, sf: issues.health_score(_fact(spark, sf))
    q["health_score_by_account"] = lambda spark, sf: issues.health_score(_fact(spark, sf), BY_ACCOUNT)
    q["industry_tier"] = lambda spark, sf: issues.industry_tier(metrics.kpi_summary(_fact(spark, sf)))
    return q


#: Two single months: most of the monthly accounts have rows in neither.
MONTH_RANGES = ("1996-02-01", "1996-02-29", "1997-03-01", "1997-03-31")


def _monthly_comments(fact: DataFrame) -> DataFrame:
    a0, a1, b0, b1 = (_d(x) for x in MONTH_RANGES)
    return compare.comparison_comments(compare.ab_comparison(fact, a0, a1, b0, b1, BY_ACCOUNT), BY_ACCOUNT, fact)


def _rounded_thresholds(df: DataFrame) -> DataFrame:
    # Interpolated percentiles may differ in the last bit between engines; round only for display.
    return df.withColumns({
        "no_conversion_cost_threshold": F.round("no_conversion_cost_threshold", 6),
        "high_impression_threshold": F.round("high_impression_threshold", 6),
        "low_ctr_threshold": F.round("low_ctr_threshold", 9),
    })


def all_queries() -> dict[str, Query]:
    from adlens.plans.collection_queries import collection_queries
    from adlens.plans.json_queries import json_queries
    from adlens.plans.ingest_queries import ingest_queries
    q = analysis_queries()
    q.update(ingest_queries())
    q.update(collection_queries())
    q.update(json_queries())
    from adlens.plans.channel_queries import channel_queries
    q.update(channel_queries())
    from adlens.plans.audit_queries import audit_queries
    q.update(audit_queries())
    from adlens.plans.file_queries import file_queries
    q.update(file_queries())
    from adlens.plans.report_queries import report_queries
    q.update(report_queries())
    from adlens.plans.stream_queries import stream_queries
    q.update(stream_queries())
    from adlens.plans.extra_queries import extra_queries
    q.update(extra_queries())
    from adlens.plans.text_queries import text_queries
    q.update(text_queries())
    return q
