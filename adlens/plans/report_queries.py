"""Registered display / report queries and their DuckDB oracles."""

from __future__ import annotations

from adlens.operators import compare, issues, metrics, report, rules
from adlens.plans import oracle_sql as o
from adlens.plans.batch_run import narratives
from adlens.sources import tables


def _fact(spark, sf):
    return tables.ad_fact(spark, sf)


def _report_lines(spark, sf, scope=()):
    return narratives(_fact(spark, sf), scope, "all accounts")


def report_queries() -> dict:
    return {
        "formatted_summary": lambda spark, sf: report.format_for_display(metrics.kpi_summary(_fact(spark, sf))),
        "comparison_display": lambda spark, sf: report.comparison_display(compare.recent_comparison(_fact(spark, sf))),
        "period_markdown": lambda spark, sf: report.period_markdown(metrics.period_table(_fact(spark, sf), "monthly")),
        "issue_lanes": lambda spark, sf: report.issue_lanes(issues.action_issues(_fact(spark, sf))),
        "action_sheet": lambda spark, sf: report.action_sheet(issues.action_issues(_fact(spark, sf))),
        "severity_counts": lambda spark, sf: report.severity_counts(rules.anomalies(_fact(spark, sf))),
        "top_campaign_by_cost": lambda spark, sf: report.top_label(
            metrics.segment_table(_fact(spark, sf), "campaign_name", limit=None), "cost", "campaign_name"),
        "dashboard_counters": lambda spark, sf: report.dashboard_counters(
            _fact(spark, sf), issues.action_issues(_fact(spark, sf))),
        "basic_view": lambda spark, sf: report.view_projection(
            metrics.segment_table(_fact(spark, sf), "platform", limit=None)),
        "report_lines": _report_lines,
        "report_lines_by_account": lambda spark, sf: _report_lines(spark, sf, ("account_name",)),
        "report_plain_text": lambda spark, sf: report.plain_text(_report_lines(spark, sf)),
    }


MESSAGE = """CASE WHEN problem = 'insufficient data' THEN 'There is too little data to explain results yet; recent data is needed first.'
       ELSE problem || ' for ' || target || ': ' || evidence || '. Next: ' || recommended_action || '.' END"""


def _cnt(x):
    return f"format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _money(x):
    return f"(format('{{:,.0f}}', CAST({x} AS DOUBLE)) || '원')"


def _pct(x):
    return f"(format('{{:,.2f}}', CAST({x} AS DOUBLE) * 100) || '%')"


def _by_metric(x):
    return (f"CASE WHEN metric IN ('rows', 'impressions', 'clicks', 'conversions', 'orders') THEN {_cnt(x)} "
            f"WHEN metric IN ('cost', 'revenue', 'cpc', 'cpa') THEN {_money(x)} "
            f"WHEN metric IN ('ctr', 'cvr', 'change_rate', 'roas') THEN {_pct(x)} ELSE CAST({x} AS VARCHAR) END")


def report_oracles() -> dict:
    summary = o.kpi_summary()
    cmp = o.recent_comparison()
    monthly = o.period("monthly")
    iss = o.action_issues()
    row = " || ' | ' || ".join([
        "period_label", "strftime(period_start, '%Y-%m-%d')", "strftime(period_end, '%Y-%m-%d')", _cnt("impressions"),
        _cnt("clicks"), _money("cost"), _cnt("conversions"), _money("revenue"), _pct("ctr"), _money("cpc"),
        _pct("cvr"), _money("cpa"), _pct("roas")])
    header = "| " + " | ".join(["period_label", "period_start", "period_end", "impressions", "clicks", "cost",
                                "conversions", "revenue", "ctr", "cpc", "cvr", "cpa", "roas"]) + " |"
    sep = "| " + " | ".join(["---"] * 13) + " |"
    def markdown(grain: str, scope: tuple[str, ...]) -> str:
        keys = "".join(f"{k}, " for k in scope)
        heads = f"(SELECT DISTINCT {', '.join(scope)} FROM m) h" if scope else "(SELECT 1) h"
        part = f"PARTITION BY {', '.join(scope)} " if scope else ""
        return f"""(WITH m AS ({o.period(grain, scope=scope)})
SELECT {keys}0 AS line_no, '{header}' AS line FROM {heads}
UNION ALL SELECT {keys}1, '{sep}' FROM {heads}
UNION ALL SELECT {keys}CAST(ROW_NUMBER() OVER ({part}ORDER BY period_start, period_label) + 1 AS INTEGER), '| ' || {row} || ' |' FROM m)"""

    def narrative(scope: tuple[str, ...] = ()) -> str:
        keys = "".join(f"{k}, " for k in scope)
        part = f"PARTITION BY {', '.join(scope)} " if scope else ""
        who = " || ' / ' || ".join(scope) if scope else "'all accounts'"
        return f"""WITH s AS ({o.kpi_summary(scope=scope)}), r AS ({o.recommendations(scope)}), i AS ({o.action_issues(scope)}),
a AS ({o.anomalies(scope)}),
lines AS (
  SELECT {keys}1 AS section_no, unnest([0, 1, 2, 3, 4, 5, 6]) AS line_no,
         unnest(['# ' || {who} || ' ad performance report', '- rows: ' || {_cnt('rows')}, '- cost: ' || {_money('cost')},
                 '- revenue: ' || {_money('revenue')}, '- roas: ' || {_pct('roas')}, '- ctr: ' || {_pct('ctr')},
                 '- cvr: ' || {_pct('cvr')}]) AS line FROM s
  UNION ALL SELECT {keys}unnest([2, 3, 4, 5, 6]), -1,
                   unnest(['## Recommendations', '## Today''s actions', '## Anomalies', '## Monthly', '## Weekly']) FROM s
  UNION ALL SELECT {keys}2, CAST(ROW_NUMBER() OVER ({part}ORDER BY rec_no, rule_seq) AS INTEGER),
                   '- [' || priority || '] ' || target || ': ' || issue || ' -> ' || recommended_action FROM r
  UNION ALL SELECT {keys}3, issue_rank * 20 + unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), unnest([
              '### [' || CASE severity WHEN 'high' THEN 'urgent' WHEN 'medium' THEN 'watch' WHEN 'opportunity' THEN 'opportunity'
                         WHEN 'low' THEN 'reference' ELSE severity END || '] ' || problem,
              '- priority score: ' || format('{{:,.2f}}', CAST(priority_score AS DOUBLE)), '- advertiser: ' || {who},
              '- media: ' || media, '- target: ' || target, '- evidence: ' || evidence,
              '- likely cause: ' || cause_hypothesis, '- recommended action: ' || recommended_action,
              '- expected effect: ' || expected_effect, '- message: ' || {MESSAGE},
              '- report: ' || CASE WHEN report_include THEN 'include' ELSE 'if needed' END]) FROM i
            WHERE report_include OR problem = 'insufficient data' OR severity IN ('high', 'medium', 'opportunity')
  UNION ALL SELECT {keys}4, CAST(ROW_NUMBER() OVER ({part}ORDER BY base_rank, rule_seq) AS INTEGER),
                   '- ' || severity || ' / ' || rule_code || ' / ' || target || ' / ' || {_money('cost')} FROM a
  UNION ALL SELECT {keys}5, line_no, line FROM {markdown('monthly', scope)} m
  UNION ALL SELECT {keys}6, line_no, line FROM {markdown('weekly', scope)} w)
SELECT {keys}section_no, line_no, line FROM lines"""

    return {
        "report_lines": narrative(),
        "report_lines_by_account": narrative(("account_name",)),
        "report_plain_text": f"""WITH t AS ({narrative()})
SELECT section_no, line_no, regexp_replace(line, '[#*]', '', 'g') AS line FROM t""",
        "formatted_summary": f"""WITH s AS ({summary})
SELECT {_cnt('rows')} AS rows, {_cnt('impressions')} AS impressions, {_cnt('clicks')} AS clicks,
       {_money('cost')} AS cost, {_cnt('conversions')} AS conversions, {_money('revenue')} AS revenue,
       {_cnt('orders')} AS orders, {_pct('ctr')} AS ctr, {_money('cpc')} AS cpc, {_pct('cvr')} AS cvr,
       {_money('cpa')} AS cpa, {_pct('roas')} AS roas FROM s""",
        "comparison_display": f"""WITH c AS ({cmp})
SELECT metric_no, metric, {_by_metric('previous')} AS previous, {_by_metric('current')} AS current,
       {_by_metric('delta')} AS delta, {_pct('change_rate')} AS change_rate FROM c""",
        "period_markdown": f"""WITH m AS ({monthly})
SELECT 0 AS line_no, '{header}' AS line
UNION ALL SELECT 1, '{sep}'
UNION ALL SELECT CAST(ROW_NUMBER() OVER (ORDER BY period_start, period_label) + 1 AS INTEGER), '| ' || {row} || ' |'
FROM m""",
        "issue_lanes": f"""WITH i AS ({iss}),
l AS (SELECT *, CASE WHEN severity = 'high' THEN 'urgent' WHEN severity = 'opportunity' THEN 'opportunity'
                     WHEN severity IN ('medium', 'low') THEN 'watch' END AS lane FROM i)
SELECT * FROM (SELECT lane, CAST(ROW_NUMBER() OVER (PARTITION BY lane ORDER BY issue_rank) AS INTEGER) AS lane_rank,
                      issue_rank, severity, target, problem FROM l WHERE lane IS NOT NULL) z WHERE lane_rank <= 2""",
        "action_sheet": f"""WITH i AS ({iss})
SELECT issue_rank, CASE severity WHEN 'high' THEN 'urgent' WHEN 'medium' THEN 'watch'
                    WHEN 'opportunity' THEN 'opportunity' WHEN 'low' THEN 'reference' ELSE severity END AS severity,
       priority_score, media, target, problem, evidence, cause_hypothesis, recommended_action, expected_effect,
       CASE WHEN report_include THEN 'include' ELSE 'exclude' END AS report_include,
       'all accounts' AS advertiser, {MESSAGE} AS advertiser_message FROM i""",
        "severity_counts": f"""WITH a AS ({o.anomalies()})
SELECT severity, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM a GROUP BY severity""",
        "top_campaign_by_cost": f"""{o.with_ctes(o.AD_FACT)}
SELECT arg_max(campaign_name, (c, campaign_name)) AS top_label
FROM (SELECT campaign_name, CAST(SUM(cost) AS DOUBLE) AS c FROM ad_fact GROUP BY campaign_name) t""",
        "dashboard_counters": f"""{o.with_ctes(o.AD_FACT)},
f AS (SELECT COUNT(DISTINCT CASE WHEN trim(account_name) <> '' AND account_name <> '미분류' THEN account_name END)
               AS accounts,
             COUNT(DISTINCT CASE WHEN trim(campaign_name) <> '' AND campaign_name <> '미분류' THEN campaign_name END)
               AS campaigns,
             COUNT(DISTINCT CASE WHEN trim(platform) <> '' AND platform <> '미분류' THEN platform END) AS platforms
      FROM ad_fact),
i AS ({iss}),
c AS (SELECT COUNT(*) AS issues, COUNT(*) FILTER (WHERE severity = 'high') AS critical,
             COUNT(*) FILTER (WHERE severity = 'medium') AS warning, COUNT(*) FILTER (WHERE report_include) AS report_due
      FROM i)
SELECT * FROM f, c""",
        "basic_view": f"""{o.with_ctes(o.AD_FACT)}
SELECT platform, impressions, clicks, cost, conversions, revenue, {o.rates()}
FROM (SELECT platform, {o.sums()} FROM ad_fact GROUP BY platform) t""",
    }
