"""Prioritised action issues, health score and industry tier (per scope)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import (BENCHMARK_CHECK_SCORE, COST_PER_SCORE_POINT, COST_SCORE_CAP, HEALTH_BASE,
                              HEALTH_CTR_CAP, HEALTH_CTR_WEIGHT, HEALTH_FAIR, HEALTH_GOOD, HEALTH_HIGH_PENALTY,
                              HEALTH_MEDIUM_PENALTY, HEALTH_OPPORTUNITY_CAP, HEALTH_OPPORTUNITY_WEIGHT,
                              HEALTH_ROAS_CAP, HEALTH_ROAS_WEIGHT, HIGH_ZERO_ROAS_PENALTY, INDUSTRY_CPC,
                              INDUSTRY_ROAS, INDUSTRY_TOP_FACTOR, INSUFFICIENT_DATA_SCORE, MAX_ISSUES_WITH_SUPPORT,
                              MIN_ROWS_FOR_JUDGMENT, NO_ANOMALY_SCORE, OTHER_SEVERITY_SCORE, REPORT_SEVERITIES,
                              REPORT_SHARE_SCORE, RULE_LOW_CTR, RULE_NO_CONVERSION, RULE_SCALE, SAVING_FACTOR,
                              SEARCH_ADS_MEDIA_WORD, SEVERITY_BASE_SCORE)
from adlens.functions.formatting import fmt_money, fmt_percent
from adlens.operators.rules import anomalies, rule_aggregates, scope_state
from adlens.operators.scoped import attach

ALL_MEDIA = "all_media"
UNDETERMINED_MEDIA = "undetermined"
ALL_ACCOUNTS = "all"

# rule_code -> (problem, cause hypothesis, recommended action); our own wording.
ISSUE_TEXT = {
    RULE_NO_CONVERSION: ("spend without conversions", "keyword intent mismatch, landing page or missing tracking",
                         "cut budget, add negative keywords, check landing page and conversion tracking"),
    RULE_LOW_CTR: ("weak click response", "creative fatigue or copy not matching keywords",
                   "refresh creatives and align copy per core keyword"),
    RULE_SCALE: ("strong results, budget can grow", "ROAS and conversions are both healthy",
                 "raise budget step-wise by 10-20 %"),
}


def priority_score(severity: Column, cost: Column, roas: Column) -> Column:
    base = F.lit(OTHER_SEVERITY_SCORE).cast("double")
    for sev, pts in SEVERITY_BASE_SCORE.items():
        base = F.when(severity == sev, F.lit(float(pts))).otherwise(base)
    cost_pts = F.least(cost / COST_PER_SCORE_POINT, F.lit(float(COST_SCORE_CAP)))
    penalty = F.when((severity == "high") & (roas <= 0), F.lit(float(HIGH_ZERO_ROAS_PENALTY))).otherwise(F.lit(0.0))
    return base + cost_pts + penalty


def _text_map(pos: int) -> Column:
    return F.create_map(*[x for k, v in ISSUE_TEXT.items() for x in (F.lit(k), F.lit(v[pos]))])


def _issue_struct(keep: Column, order: int, score: float, media: Column, target: str, problem: str,
                  evidence: Column, cause: str, action: Column, effect: str) -> Column:
    """A low-severity, not-report-included scope-level issue candidate (kept when ``keep``)."""
    return F.struct(keep.alias("_keep"), F.lit(order).cast("int").alias("_src"), F.lit("low").alias("severity"),
                    F.lit(float(score)).alias("priority_score"), media.alias("media"), F.lit(target).alias("target"),
                    F.lit(problem).alias("problem"), evidence.alias("evidence"), F.lit(cause).alias("cause_hypothesis"),
                    action.alias("recommended_action"), F.lit(effect).alias("expected_effect"),
                    F.lit(False).alias("report_include"))


def primary_platform(fact: DataFrame, scope: Sequence[str] = (), platforms: DataFrame | None = None) -> DataFrame:
    """Top-cost platform per scope (ties by name), from the per-platform sums."""
    per = (platforms if platforms is not None else fact.groupBy(*scope, "platform").agg(F.sum("cost").alias("cost")))
    per = per.select(*scope, "platform", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    return per.groupBy(*scope).agg(
        F.min_by("platform", F.struct(-F.col("cost"), F.col("platform"))).alias("primary_platform"))


def action_issues(fact: DataFrame, scope: Sequence[str] = (), anomaly_rows: DataFrame | None = None,
                  aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Operating issues ordered by priority score (``issue_rank`` 1 = most urgent).

    Insufficient data (fewer than 3 rows, or no cost, impressions and clicks) gives a
    single low issue. Otherwise one issue per anomaly, or a 'nothing urgent' issue, then
    supporting issues while the scope has fewer than three.
    """
    scope = list(scope)
    aggs = aggregates or rule_aggregates(fact, scope)  # one scan feeds summary, anomaly base and platforms
    a = anomaly_rows if anomaly_rows is not None else anomalies(fact, scope, aggregates=aggs)
    state = attach(scope_state(fact, a, scope, aggs), primary_platform(fact, scope, aggs[1]), scope)
    insufficient = ((F.col("rows") < MIN_ROWS_FOR_JUDGMENT)
                    | ((F.col("cost") <= 0) & (F.col("impressions") <= 0) & (F.col("clicks") <= 0)))
    state = state.withColumn("insufficient", insufficient)
    c = F.col

    def from_hit(h: Column) -> Column:
        code, severity = h["rule_code"], h["severity"]
        evidence = F.concat_ws(", ", F.concat(F.lit("cost "), fmt_money(h["cost"])),
                               *[F.concat(F.lit(f"{m} "), fmt_percent(h[m])) for m in ("ctr", "cvr", "roas")])
        effect = (F.when(code == RULE_NO_CONVERSION, F.concat(F.lit("about "), fmt_money(h["cost"] * SAVING_FACTOR), F.lit(" monthly saving")))
                  .when(code == RULE_LOW_CTR, F.lit("CTR +10-20 %"))
                  .when(code == RULE_SCALE, F.lit("revenue +8-12 %"))
                  .otherwise(F.lit("less wasted spend")))
        return F.struct(
            (~c("insufficient")).alias("_keep"), (h["base_rank"] * 10 + h["rule_seq"]).cast("int").alias("_src"), severity.alias("severity"),
            priority_score(severity, h["cost"], h["roas"]).cast("double").alias("priority_score"), F.lit(UNDETERMINED_MEDIA).alias("media"),
            h["target"].alias("target"), F.coalesce(_text_map(0)[code], code).alias("problem"), evidence.alias("evidence"),
            F.coalesce(_text_map(1)[code], F.lit("needs review")).alias("cause_hypothesis"),
            F.coalesce(_text_map(2)[code], F.lit("review by campaign, ad group and keyword")).alias("recommended_action"),
            effect.alias("expected_effect"), severity.isin(REPORT_SEVERITIES).alias("report_include"))

    # All issues come from ONE pass over the per-scope state, which holds the scope's hits (at most
    # three rules for each of the base's campaigns): an array of candidate structs, filtered by each
    # candidate's condition and exploded. So hits need no join with the gate, and ranks no exchange.
    ok = ~c("insufficient")
    roas_cost = F.concat(F.lit("total roas "), fmt_percent(c("roas")), F.lit(", cost "), fmt_money(c("cost")))
    existing = F.greatest(c("n_anomalies"), F.lit(1))
    support_n = F.least(F.greatest(F.lit(MAX_ISSUES_WITH_SUPPORT) - existing, F.lit(0)), F.lit(2))
    zero_perf = F.lit(True)
    for m in ["impressions", "clicks", "cost", "conversions", "revenue"]:
        zero_perf = zero_perf & (c(m) <= 0)
    media = F.coalesce(F.nullif(F.trim(c("primary_platform")), F.lit("")), F.lit(ALL_MEDIA))
    no_data = (F.when(media.contains(SEARCH_ADS_MEDIA_WORD), F.lit("no search-ads performance data for the period"))
               .otherwise(F.lit("no ad performance data for the period")))
    candidates = F.array(
        _issue_struct(ok & (c("n_anomalies") == 0), 100000, NO_ANOMALY_SCORE, F.lit(ALL_MEDIA), ALL_ACCOUNTS,
                      "no urgent issue", roas_cost, "no clear waste signal in the current data",
                      F.lit("keep checking top-spend and top-performing campaigns"), "keep results, find candidates"),
        _issue_struct(ok & (support_n >= 1), 100001, REPORT_SHARE_SCORE, F.lit(ALL_MEDIA), "this analysis",
                      "share the advertiser report", F.concat(F.lit("total roas "), fmt_percent(c("roas"))),
                      "summarise key changes and next actions first",
                      F.lit("send the report from the report centre"), "less reporting time"),
        _issue_struct(ok & (support_n >= 2), 100002, BENCHMARK_CHECK_SCORE, F.lit(ALL_MEDIA), "industry benchmark",
                      "compare with the industry average",
                      F.concat(F.lit("cpc "), fmt_money(c("cpc")), F.lit(", roas "), fmt_percent(c("roas"))),
                      "a high CPC can erode efficiency even with good ROAS",
                      F.lit("check ROAS and CPC against the industry average"), "easier performance explanation"),
        _issue_struct(c("insufficient"), 0, INSUFFICIENT_DATA_SCORE, media, ALL_ACCOUNTS, "insufficient data",
                      F.concat(F.lit("rows "), F.format_number(c("rows").cast("double"), 0), F.lit(", cost "),
                               fmt_money(c("cost"))),
                      "too little data to infer a cause",
                      F.when(zero_perf, no_data).otherwise(F.lit("upload recent data per media and re-run")),
                      "trustworthy analysis"),
    )
    found = F.transform(F.coalesce("hits", F.array().cast(state.schema["hits"].dataType)), from_hit)
    issues = state.select(*scope, F.inline(F.filter(F.concat(found, candidates), lambda x: x["_keep"]))).drop("_keep")
    w = Window.partitionBy(*scope).orderBy(F.desc("priority_score"), F.asc("_src"))
    return issues.withColumn("issue_rank", F.row_number().over(w)).drop("_src")


def top_issues(issues: DataFrame, scope: Sequence[str] = (), n: int = 3) -> DataFrame:
    return issues.where(F.col("issue_rank") <= n)


def health_score(fact: DataFrame, scope: Sequence[str] = (), anomaly_rows: DataFrame | None = None,
                 aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """0-100 account health from ROAS, CTR and anomaly counts; half-even rounding; good / fair / risk."""
    scope = list(scope)
    aggs = aggregates or rule_aggregates(fact, scope, platforms=False)
    a = anomaly_rows if anomaly_rows is not None else anomalies(fact, scope, aggregates=aggs)
    s = scope_state(fact, a, scope, aggs)
    c = F.col
    raw = (F.lit(float(HEALTH_BASE)) + F.least(c("roas") * HEALTH_ROAS_WEIGHT, F.lit(float(HEALTH_ROAS_CAP)))
           + F.least(c("ctr") * HEALTH_CTR_WEIGHT, F.lit(float(HEALTH_CTR_CAP)))
           + F.least(c("n_opportunity") * HEALTH_OPPORTUNITY_WEIGHT, F.lit(HEALTH_OPPORTUNITY_CAP)).cast("double")
           - c("n_high") * HEALTH_HIGH_PENALTY - c("n_medium") * HEALTH_MEDIUM_PENALTY)
    score = F.greatest(F.lit(0), F.least(F.bround(raw, 0), F.lit(100.0))).cast("int")
    return s.select(*scope, score.alias("health_score"),
                    F.when(score >= HEALTH_GOOD, "good").when(score >= HEALTH_FAIR, "fair").otherwise("risk")
                    .alias("health_label"), "n_high", "n_medium", "n_opportunity")


def industry_tier(summary: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """ROAS tier against the industry average and the CPC gap."""
    c = F.col
    tier = (F.when(c("roas") >= INDUSTRY_ROAS * INDUSTRY_TOP_FACTOR, "top_15_percent")
            .when(c("roas") >= INDUSTRY_ROAS, "above_average").otherwise("needs_check"))
    return summary.select(*scope, "roas", "cpc", (c("roas") - INDUSTRY_ROAS).alias("roas_gap"),
                          ((c("cpc") - INDUSTRY_CPC) / INDUSTRY_CPC).alias("cpc_gap"), tier.alias("tier"))
