"""The narrative's period tables take each row of the fact once and equal the grains' own tables."""

import datetime as dt
from decimal import Decimal

import pytest

from adlens.operators import metrics, report, rules
from adlens.plans.batch_run import narratives

COLUMNS = ("date timestamp_ntz, platform string, account_name string, campaign_name string, ad_group_name string, "
           "keyword string, product_name string, impressions bigint, clicks bigint, cost decimal(18,2), conversions bigint, "
           "revenue decimal(18,2), orders bigint")


@pytest.fixture()
def fact(spark, tmp_dir):
    # weeks over the ends of months and years, times of day, an undated row, an account without dates, a null account
    days = [dt.datetime(2024, 12, 28) + dt.timedelta(days=3 * i, hours=i % 5) for i in range(40)] + [None]
    rows = [(d, "p", a, f"c{i % 3}", "g", "k", "q", 100 * i, i, i, i % 4, 3 * i, 1)
            for a in ("x", "y", None) for i, d in enumerate(days) if a != "y" or i % 7 == 0]
    rows.append((None, "p", "z", "c0", "g", "k", "q", 1, 1, 1, 1, 1, 1))
    rows = [(*r[:9], Decimal(r[9]), r[10], Decimal(r[11]), r[12]) for r in rows]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_dir}/fact")
    return spark.read.parquet(f"{tmp_dir}/fact")


def test_narratives_scan_the_fact_once_for_both_grains(fact, tmp_dir):
    scope = ("account_name",)
    lines = narratives(fact, scope, aggregates=rules.rule_aggregates(fact, scope))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_dir}/fact") == 1


@pytest.mark.parametrize("scope", [(), ("account_name",)])
def test_month_week_periods_equal_the_grains_tables(fact, scope):
    both = metrics.month_week_periods(fact, scope)
    want = metrics.periods_all(fact, scope, ("monthly", "weekly")).select(*both.columns)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(both) == key(want) and both.dtypes == want.dtypes
    for rows in (fact, fact.where("false")):
        got = report.period_sections(metrics.month_week_periods(rows, scope), {"monthly": 5, "weekly": 6}, scope)
        for grain, no in (("monthly", 5), ("weekly", 6)):
            alone = report.period_markdown(metrics.period_table(rows, grain, scope), scope)
            assert key(got.where(f"section_no = {no}").drop("section_no")) == key(alone)
