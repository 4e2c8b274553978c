"""Golden numbers on the 12-row demo report (values computed independently, see FIXTURES.md §1)."""

import pytest
from pyspark.sql import functions as F

from adlens.operators import compare, issues, metrics, rules


def test_standardised_shape(demo_fact):
    cols = demo_fact.columns
    assert cols[:13] == ["date", "platform", "account_name", "campaign_name", "ad_group_name", "keyword",
                         "product_name", "impressions", "clicks", "cost", "conversions", "revenue", "orders"]
    # extras pass through after the canonical block, then the five row ratios
    assert {"status", "recommended_action", "report_include"} <= set(cols)
    assert cols[-5:] == ["ctr", "cpc", "cvr", "cpa", "roas"]


def test_summary(demo_fact):
    s = metrics.kpi_summary(demo_fact).collect()[0]
    assert s["rows"] == 12
    assert (s["impressions"], s["clicks"], s["cost"]) == (407_400, 10_262, 7_451_000)
    assert (s["conversions"], s["revenue"], s["orders"]) == (389, 36_810_000, 362)
    assert s["ctr"] == pytest.approx(0.025189003436426)
    assert s["cpc"] == pytest.approx(726.076788150458)
    assert s["cvr"] == pytest.approx(0.037906840771779)
    assert s["cpa"] == pytest.approx(19154.241645244216)
    assert s["roas"] == pytest.approx(4.940276472956650)


def test_platform_segment(demo_fact):
    rows = metrics.segment_table(demo_fact, "platform").collect()
    got = [(r["platform"], r["cost"], r["revenue"]) for r in rows]
    assert got == [("G마켓", 2_520_000, 7_430_000), ("네이버 검색광고", 2_398_000, 19_880_000),
                   ("옥션", 1_808_000, 8_600_000), ("11번가", 725_000, 900_000)]


def test_account_segment(demo_fact):
    rows = {r["account_name"]: (r["cost"], r["revenue"])
            for r in metrics.segment_table(demo_fact, "account_name").collect()}
    assert rows == {"샘플브랜드 B": (2_800_000, 19_800_000), "샘플스토어 A": (2_397_000, 11_870_000),
                    "샘플몰 C": (2_254_000, 5_140_000)}


def test_weekly_and_monthly(demo_fact):
    weekly = {r["period_label"]: (r["rows"], r["cost"], r["revenue"])
              for r in metrics.period_table(demo_fact, "weekly").collect()}
    assert weekly == {"2026년 23주차": (7, 4_417_000, 27_750_000), "2026년 24주차": (5, 3_034_000, 9_060_000)}
    monthly = metrics.period_table(demo_fact, "monthly").collect()
    assert [r["period_label"] for r in monthly] == ["2026년 06월"] and monthly[0]["cost"] == 7_451_000


def test_seven_grains_one_pass(demo_fact):
    p = metrics.periods_all(demo_fact)
    labels = {(r["grain"], r["period_label"]) for r in p.collect()}
    assert ("daily", "2026년 06월 01일") in labels
    assert ("quarterly", "2026년 2분기") in labels and ("half_year", "2026년 상반기") in labels
    assert ("yearly", "2026년") in labels and ("seasonal", "2026년 여름") in labels


def test_recent_comparison(demo_fact):
    rows = {r["metric"]: (r["previous"], r["current"]) for r in compare.recent_comparison(demo_fact).collect()}
    assert rows["impressions"] == (165_000, 242_400)
    assert rows["clicks"] == (4_650, 5_612)
    assert rows["cost"] == (3_477_000, 3_974_000)
    assert rows["conversions"] == (239, 150)
    assert rows["revenue"] == (23_270_000, 13_540_000)
    assert rows["orders"] == (221, 141)


def test_thresholds(demo_fact):
    t = rules.thresholds(demo_fact).collect()[0]
    assert t["no_conversion_cost_threshold"] == pytest.approx(512_000)
    assert t["high_impression_threshold"] == pytest.approx(45_200)
    assert t["low_ctr_threshold"] == pytest.approx(0.0215669755686605)


EXPECTED_ANOMALIES = {
    ("생활용품 오픈마켓 캠페인", "low_ctr_at_volume"): 88.16,
    ("브랜드 보호 캠페인", "scale_candidate"): 70.80,
    ("건강식품 오픈마켓 캠페인", "scale_candidate"): 69.40,
    ("브랜드 검색 캠페인", "scale_candidate"): 68.80,
    ("건강식품 프로모션 캠페인", "scale_candidate"): 67.80,
    ("오픈마켓 일반 캠페인", "low_ctr_at_volume"): 76.90,
    ("세트상품 캠페인", "scale_candidate"): 65.12,
}


def test_anomalies_and_issues(demo_fact):
    a = rules.anomalies(demo_fact)
    got = {(r["target"], r["rule_code"]) for r in a.collect()}
    assert got == set(EXPECTED_ANOMALIES)
    iss = issues.action_issues(demo_fact).collect()
    assert len(iss) == 7  # seven anomalies, so no supporting issues
    scores = {r["target"]: r["priority_score"] for r in iss}
    for (target, _), score in EXPECTED_ANOMALIES.items():
        assert scores[target] == pytest.approx(score)
    ranks = sorted(iss, key=lambda r: r["issue_rank"])
    assert ranks[0]["target"] == "생활용품 오픈마켓 캠페인"


def test_recommendations(demo_fact):
    recs = rules.recommendations(demo_fact).collect()
    assert len(recs) == 7
    assert {r["priority"] for r in recs} == {"P2"}


def test_health_score(demo_fact):
    h = issues.health_score(demo_fact).collect()[0]
    assert h["health_score"] == 96 and h["health_label"] == "good"


def test_scope_split_invariance(demo_fact):
    """Per-account run in one job == filter-then-run for each account."""
    scoped = {r["account_name"]: r for r in metrics.kpi_summary(demo_fact, ["account_name"]).collect()}
    for acct in scoped:
        alone = metrics.kpi_summary(demo_fact.where(F.col("account_name") == acct)).collect()[0]
        assert alone["cost"] == scoped[acct]["cost"] and alone["rows"] == scoped[acct]["rows"]
        assert alone["roas"] == pytest.approx(scoped[acct]["roas"])
    a_scoped = rules.anomalies(demo_fact, ["account_name"])
    for acct in scoped:
        alone = {(r["target"], r["rule_code"]) for r in
                 rules.anomalies(demo_fact.where(F.col("account_name") == acct)).collect()}
        mine = {(r["target"], r["rule_code"]) for r in a_scoped.where(F.col("account_name") == acct).collect()}
        assert alone == mine


def test_insufficient_data_issue(demo_fact):
    two = demo_fact.where(F.col("date") <= F.lit("2026-06-02").cast("timestamp_ntz"))
    iss = issues.action_issues(two).collect()
    assert len(iss) == 1 and iss[0]["priority_score"] == 1 and iss[0]["problem"] == "insufficient data"
    assert iss[0]["media"] == "네이버 검색광고"


def test_no_anomaly_gets_support_issues(demo_fact):
    # A single campaign with spend but no conversions anywhere and low CTR threshold not reached.
    one = demo_fact.where(F.col("campaign_name") == "생활용품 검색 캠페인")
    iss = issues.action_issues(one).collect()
    assert len(iss) == 1  # one row: insufficient data
    three = demo_fact.where(F.col("account_name") == "샘플몰 C")
    iss3 = sorted(issues.action_issues(three).collect(), key=lambda r: r["issue_rank"])
    assert iss3[-1]["priority_score"] in (4.0, 5.0, 10.0) or len(iss3) >= 3


def test_scoped_comparisons_equal_filter_then_run(demo_fact):
    scoped_p = {(r["account_name"], r["preset"]): (r["rows"], r["cost"])
                for r in compare.preset_kpis(demo_fact, ["account_name"]).collect()}
    scoped_c = {(r["account_name"], r["metric"]): (r["previous"], r["current"])
                for r in compare.recent_comparison(demo_fact, ["account_name"]).collect()}
    for acct in {k[0] for k in scoped_p}:
        one = demo_fact.where(F.col("account_name") == acct)
        for r in compare.preset_kpis(one).collect():
            assert scoped_p[(acct, r["preset"])] == (r["rows"], r["cost"])
        for r in compare.recent_comparison(one).collect():
            assert scoped_c[(acct, r["metric"])] == (r["previous"], r["current"])
