"""Property tests: segment sums equal the summary, periods cover every dated row, deltas add up."""

import datetime as dt

from hypothesis import given, settings, strategies as st

from adlens.operators import compare, metrics

ROW = st.tuples(
    st.one_of(st.none(), st.dates(min_value=dt.date(2025, 11, 1), max_value=dt.date(2026, 3, 31))),
    st.sampled_from(["naver", "gmarket", "auction"]),
    st.sampled_from(["acct1", "acct2"]),
    st.sampled_from(["c1", "c2", "c3", "c4"]),
    st.integers(0, 5000), st.integers(0, 300), st.integers(0, 100_000), st.integers(0, 20), st.integers(0, 500_000),
)
SCHEMA = ("date timestamp_ntz, platform string, account_name string, campaign_name string, impressions bigint, "
          "clicks bigint, cost bigint, conversions bigint, revenue bigint")


def _fact(spark, rows):
    data = [(dt.datetime.combine(r[0], dt.time()) if r[0] else None,) + r[1:] for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumns({"orders": df.conversions, "ad_group_name": df.campaign_name, "keyword": df.campaign_name,
                           "product_name": df.platform})


@settings(max_examples=5, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=40))
def test_scoped_rules_equal_filter_then_run(spark, rows):
    """Per-account anomalies and issues in one job == running each account alone."""
    from pyspark.sql import functions as F
    from adlens.operators import issues, rules
    f = _fact(spark, rows)
    a_all = rules.anomalies(f, ["account_name"]).collect()
    i_all = issues.action_issues(f, ["account_name"]).collect()
    for acct in {r[2] for r in rows}:
        one = f.where(F.col("account_name") == acct)
        alone = sorted((r["target"], r["rule_code"]) for r in rules.anomalies(one).collect())
        mine = sorted((r["target"], r["rule_code"]) for r in a_all if r["account_name"] == acct)
        assert alone == mine
        alone_i = sorted((r["issue_rank"], r["problem"], r["priority_score"]) for r in issues.action_issues(one).collect())
        mine_i = sorted((r["issue_rank"], r["problem"], r["priority_score"]) for r in i_all if r["account_name"] == acct)
        assert alone_i == mine_i


@settings(max_examples=8, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=30))
def test_sums_are_consistent(spark, rows):
    f = _fact(spark, rows)
    s = metrics.kpi_summary(f).collect()[0]
    seg = metrics.segments_all(f, limit=None)
    for name in ["platform", "campaign"]:
        part = [r for r in seg.collect() if r["segment"] == name]
        assert sum(r["cost"] for r in part) == s["cost"]
        assert sum(r["clicks"] for r in part) == s["clicks"]
    dated = [r for r in rows if r[0] is not None]
    periods = metrics.periods_all(f).collect()
    for grain in ["daily", "monthly", "seasonal"]:
        assert sum(r["rows"] for r in periods if r["grain"] == grain) == len(dated)
    by_acct = metrics.kpi_summary(f, ["account_name"]).collect()
    assert sum(r["revenue"] for r in by_acct) == s["revenue"]
    if dated:
        for r in compare.recent_comparison(f).collect():
            assert r["delta"] == r["current"] - r["previous"]
        cmp = {r["metric"]: r for r in compare.recent_comparison(f).collect()}
        assert cmp["cost"]["previous"] + cmp["cost"]["current"] == sum(r[6] for r in dated)
