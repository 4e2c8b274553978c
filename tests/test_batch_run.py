"""End-to-end run over a report folder (the demo fixture), per account and as one advertiser."""

import os
import shutil

from pyspark.sql import functions as F

from adlens.operators.sinks import read_scoped
from adlens.session import checkpoint_dir
from tests.conftest import FIXTURES
from adlens.plans.batch_run import run_batch


def test_one_aggregate_per_analysis(spark, monkeypatch):
    from adlens.operators import rules
    from adlens.plans.batch_run import analyze
    from adlens.sources import tables
    made, real = [], rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df, name="stage": made.append(name) or real(df, name))
    analyze(tables.ad_fact(spark, "/root/testdata/sf0.001"), ["account_name"])
    assert made == ["rule-aggregates"]


def narrative(spark, path, account):
    """The lines of one account's report, by its place in the manifest."""
    at = spark.read.parquet(f"{path}/manifest").where(F.col("account_name") == account).first()
    folder = f"{path}/rows/bucket={at['bucket']}"
    lines = [x for f in sorted(os.listdir(folder)) if f.startswith("part-")
             for x in open(f"{folder}/{f}", encoding="utf-8").read().split("\n")[:-1]]
    return lines[at["first"]:at["first"] + at["rows"]]


def test_batch_run_end_to_end(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "in")
    os.makedirs(inbox)
    shutil.copy(os.path.join(FIXTURES, "demo_ads.csv"), inbox)
    out = os.path.join(tmp_dir, "out")
    run_batch(spark, inbox, out, advertiser="demo")
    s = spark.read.parquet(f"{out}/summary").collect()[0]
    assert s["rows"] == 12 and s["cost"] == 7_451_000
    assert spark.read.parquet(f"{out}/anomalies").count() == 7
    assert spark.read.parquet(f"{out}/today_actions").count() == 7
    text = "".join(open(os.path.join(f"{out}/report_md", f), encoding="utf-8").read()
                   for f in sorted(os.listdir(f"{out}/report_md")) if f.startswith("part-"))
    assert text.startswith("# demo ad performance report")
    out2 = os.path.join(tmp_dir, "out2")
    tables = f"{checkpoint_dir(spark).removeprefix('file:')}/adlens-tables"
    before = set(os.listdir(tables))
    run_batch(spark, inbox, out2, scope=["account_name"])
    per = spark.read.parquet(f"{out2}/summary/rows")
    guide = {r["sheet"]: r["rows"] for r in spark.read.parquet(f"{out2}/guide").collect()}
    assert guide["summary"] == 3 and list(guide)[:3] == ["summary", "segments", "periods"] and len(guide) == 8
    for account in [r["account_name"] for r in per.collect()]:
        assert read_scoped(spark, f"{out2}/summary", account_name=account).count() == 1
        own = narrative(spark, f"{out2}/report_md", account)
        assert own[0] == f"# {account} ad performance report" and "## Weekly" in own and "## Column mapping" in own
        assert sum(x.startswith("# ") for x in own) == 1
    assert set(os.listdir(tables)) == before  # no temporary table stays
    assert per.count() == 3 and sum(r["cost"] for r in per.collect()) == 7_451_000
