"""Registered wording and small-text queries (titles, action parts, bands, labels) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.operators import collection, compare, files, issues, report, rules
from adlens.operators.channels import active_channels
from adlens.plans import oracle_sql as o
from adlens.plans.extra_queries import _registry
from adlens.sources import tables

ACCOUNT = ["account_name"]
WORDING = [("budget", "daily budget"), ("conversions", "orders"), ("insufficient data", "not enough data")]
LABELS = {"severity": "심각도", "target": "대상", "rule_code": "규칙"}
SEVERITIES = {"high": "긴급", "medium": "주의", "opportunity": "기회"}


def _issue_wording(spark, sf):
    i = issues.action_issues(tables.monthly_account_fact(spark, sf), ACCOUNT)
    return i.select("account_name", "issue_rank", report.issue_title(F.col("problem"), F.col("recommended_action")).alias("title"),
                    F.array_join(report.action_parts(F.col("recommended_action")), " | ").alias("parts"),
                    report.chained_replace(F.col("problem"), WORDING).alias("wording"))


def _change_bands(spark, sf):
    c = compare.recent_comparison(tables.monthly_account_fact(spark, sf), ACCOUNT)
    rate = F.when(F.col("previous") != 0, F.col("change_rate"))
    return c.select("account_name", "metric", report.change_band(rate).alias("band"))


def _log_statuses(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("event_id", "event_type")
    raw = (F.when(F.col("event_type") == "view", " Success ").when(F.col("event_type") == "click", "PARTIAL")
           .when(F.col("event_type") == "purchase", "no_data").when(F.col("event_type") == "signup", "weird"))
    return ev.select("event_id", collection.whitelist_status(raw).alias("status"))


def _detection_cutoffs(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("event_id", "ts", "user_id")
    return ev.select("event_id", files.detection_cutoff(F.col("ts").cast("timestamp_ntz"), F.col("user_id") % 2 == 0,
                                                        (F.col("event_id") % 20 - 5).cast("int")).alias("cutoff"))


def _item_lists(spark, sf):
    p = tables.read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    text = F.concat(F.lit(" , "), F.col("p_name"), F.lit("\n"), F.col("p_brand"), F.lit(" ,,\n"))
    return p.select("p_partkey", report.normalise_list(text).alias("items"))


def _localized(spark, sf):
    found = rules.anomalies(tables.ad_fact(spark, sf)).select("severity", "target", "rule_code", "cost")
    return report.localize(found, LABELS, {"severity": SEVERITIES})


def text_queries() -> dict:
    return {
        "issue_wording": _issue_wording,
        "change_bands": _change_bands,
        "log_status_whitelist": _log_statuses,
        "detection_cutoffs": _detection_cutoffs,
        "item_lists": _item_lists,
        "localized_anomalies": _localized,
        "delocalized_anomalies": lambda spark, sf: report.delocalize(
            _localized(spark, sf), LABELS, {"severity": SEVERITIES}),
        "dashboard_counters_all": lambda spark, sf: report.dashboard_counters(
            tables.ad_fact(spark, sf), issues.action_issues(tables.ad_fact(spark, sf)), tables.file_inventory(spark, sf),
            active_channels(_registry(spark, sf))),
        "newest_downloads": lambda spark, sf: files.newest_downloads(tables.file_inventory(spark, sf)),
    }


def text_oracles() -> dict:
    from adlens.plans.file_queries import INV
    from adlens.plans.report_queries import report_oracles
    iss = o.over_monthly_accounts(o.action_issues(("account_name",)))
    cmp = o.over_monthly_accounts(o.recent_comparison(("account_name",)))
    wording = "problem"
    for a, b in WORDING:
        wording = f"replace({wording}, '{a}', '{b}')"
    severity = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITIES.items())
    pct = "format('{:,.2f}', change_rate * 100) || '%'"
    return {
        "issue_wording": f"""WITH i AS ({iss}),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(recommended_action, '[,·/]'),
        lambda x: regexp_replace(x, '^[ .]+|[ .]+$', '', 'g')), lambda x: x <> '')[1:4] AS a FROM i)
SELECT account_name, issue_rank, CASE
    WHEN problem = 'spend without conversions' THEN 'explain the conversion drop'
    WHEN problem = 'weak click response' THEN 'check creatives and keywords'
    WHEN problem = 'insufficient data' THEN 'collect more data' ELSE 'review: ' || a[1] END AS title,
  array_to_string(a, ' | ') AS parts, {wording} AS wording FROM p""",
        "change_bands": f"""WITH c AS ({cmp})
SELECT account_name, metric, CASE WHEN previous = 0 THEN 'no previous period' WHEN change_rate > 0 THEN '+' || {pct}
       WHEN change_rate < 0 THEN {pct} ELSE 'no change' END AS band FROM c""",
        "log_status_whitelist": """SELECT event_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'partial'
       WHEN 'purchase' THEN 'no_data' ELSE 'failed' END AS status FROM events""",
        "detection_cutoffs": """SELECT event_id, CASE WHEN user_id % 2 = 0
       THEN CAST(ts AS TIMESTAMP) - to_minutes(CAST(greatest(event_id % 20 - 5, 0) AS INTEGER)) ELSE CAST(ts AS TIMESTAMP) END
       AS cutoff FROM events""",
        "item_lists": "SELECT p_partkey, trim(p_name) || ', ' || trim(p_brand) AS items FROM part",
        "localized_anomalies": f"""WITH a AS ({o.anomalies()})
SELECT CASE severity {severity} ELSE severity END AS "심각도", target AS "대상", rule_code AS "규칙", cost FROM a""",
        "delocalized_anomalies": f"SELECT severity, target, rule_code, cost FROM ({o.anomalies()}) a",
        "dashboard_counters_all": f"""WITH d AS ({report_oracles()["dashboard_counters"]}), {INV}
SELECT d.*, (SELECT COUNT(*) FROM inv WHERE starts_with(path, 'data/raw/')) AS raw_files,
       (SELECT COUNT(*) FROM inv WHERE starts_with(path, 'data/reports/')) AS reports,
       (SELECT COUNT(*) FROM nation WHERE n_nationkey % 5 <> 4) AS channels FROM d""",
        "newest_downloads": f"""WITH {INV}
SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, length, modificationTime FROM inv
WHERE regexp_matches(lower(path), '[.](csv|xlsx|xls)$') AND length > 0
  AND NOT starts_with(lower(regexp_extract(path, '([^/]+)$', 1)), 'demo_')
ORDER BY modificationTime DESC, path LIMIT 20""",
    }
