"""Oracle SQL registry: query name -> DuckDB SQL (same column names as the Spark query)."""

from __future__ import annotations

from adlens.plans import oracle_sql as o
from adlens.plans.queries import AB_RANGES, MONTH_RANGES


def analysis_oracles() -> dict[str, str]:
    acct = ("account_name",)
    q = {
        "kpi_summary": o.kpi_summary(),
        "kpi_by_account": o.kpi_summary(scope=acct),
        "row_rates": o.row_rates(),
    }
    for name, dim in o.SEGMENTS.items():
        q[f"segment_{name}"] = o.segment(dim)
    q["segments_all"] = o.segments_all()
    q["segment_topn_by_account"] = o.segment("campaign_name", acct)
    for g in o.GRAINS:
        q[f"period_{g}"] = o.period(g)
    q["periods_all"] = o.periods_all()
    q["event_period_daily"] = o.period("daily", o.EVENT_FACT, "event_fact")
    q["event_kpi_by_account"] = o.kpi_summary(o.EVENT_FACT, "event_fact", acct)
    q["preset_ranges"] = o.preset_ranges()
    q["preset_kpis"] = o.preset_kpis()
    q["recent_comparison"] = o.recent_comparison()
    q["recent_comparison_by_account"] = o.recent_comparison(acct)
    q["event_recent_comparison"] = o.recent_comparison((), o.EVENT_FACT, "event_fact")
    q["ab_comparison"] = o.ab_comparison(*AB_RANGES)
    q["comparison_comments"] = o.comparison_comments(*AB_RANGES)
    q["thresholds"] = o.thresholds()
    q["thresholds_by_account"] = o.thresholds(acct)
    q["anomalies"] = o.anomalies()
    q["anomalies_by_account"] = o.anomalies(acct)
    q["recommendations"] = o.recommendations()
    q["action_issues"] = o.action_issues()
    q["action_issues_by_account"] = o.action_issues(acct)
    q["action_issues_by_month"] = o.over_monthly_accounts(o.action_issues(acct))
    q["recommendations_by_month"] = o.over_monthly_accounts(o.recommendations(acct))
    q["health_score_by_month"] = o.over_monthly_accounts(o.health_score(acct))
    q["comparison_comments_by_month"] = o.monthly_comments(*MONTH_RANGES)
    q["recommendations_unconverted"] = o.over_unconverted(o.recommendations(acct))
    q["recent_comparison_by_month"] = o.over_monthly_accounts(o.recent_comparison(acct))
    q["issues_top3"] = o.action_issues(top=3)
    q["health_score"] = o.health_score()
    q["health_score_by_account"] = o.health_score(acct)
    q["industry_tier"] = o.industry_tier()
    return q


def all_oracles() -> dict[str, str]:
    from adlens.plans.collection_queries import collection_oracles
    from adlens.plans.json_queries import json_oracles
    from adlens.plans.ingest_queries import ingest_oracles
    q = analysis_oracles()
    q.update(ingest_oracles())
    q.update(collection_oracles())
    q.update(json_oracles())
    from adlens.plans.channel_queries import channel_oracles
    q.update(channel_oracles())
    from adlens.plans.audit_queries import audit_oracles
    q.update(audit_oracles())
    from adlens.plans.file_queries import file_oracles
    q.update(file_oracles())
    from adlens.plans.report_queries import report_oracles
    q.update(report_oracles())
    from adlens.plans.stream_queries import stream_oracles
    q.update(stream_oracles())
    from adlens.plans.extra_queries import extra_oracles
    q.update(extra_oracles())
    from adlens.plans.text_queries import text_oracles
    q.update(text_oracles())
    return q
