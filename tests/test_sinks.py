"""Sinks and display helpers: log append + upsert-on-read, standard CSV, localisation, reports."""

import json
import os

from pyspark.sql import functions as F

from adlens.operators import collection as col
from adlens.operators import jsonstats as js
from adlens.operators import report


def test_append_then_resolve(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    first = spark.createDataFrame([("1", "failed"), ("2", "success")], "collection_id string, status string")
    col.append_log(first, path, seq=1)
    col.append_log(spark.createDataFrame([("1", "success")], "collection_id string, status string"), path, seq=2)
    got = {r["collection_id"]: r["status"] for r in col.resolve_latest(spark.read.parquet(path)).collect()}
    assert got == {"1": "success", "2": "success"}


def test_standard_csv(spark, tmp_dir):
    payload = {"data": [{"id": "c1", "impCnt": 10, "salesAmt": 100}]}
    docs = spark.createDataFrame(
        [(1, "adv1", json.dumps(payload), json.dumps({"ids": ["c1"], "timeRange": {"since": "2026-06-01"}}))],
        "doc_id long, advertiser string, payload string, request string")
    out = os.path.join(tmp_dir, "csv")
    js.write_standard_csv(js.shred_stats(docs), out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 1 and back.columns == js.STANDARD_COLUMNS + ["by_advertiser"]
    files = [os.path.join(d, f) for d, _, names in os.walk(out) for f in names if f.endswith(".csv")]
    assert [open(f, encoding="utf-8").readline().strip().split(",") for f in files] == [js.STANDARD_COLUMNS]
    assert back.collect()[0]["advertiser"] == "adv1"


def test_localize_and_plain_text(spark):
    df = spark.createDataFrame([("high", 1.0)], "severity string, priority_score double")
    loc = report.localize(df, {"severity": "Severity"}, {"severity": {"high": "urgent"}})
    assert loc.columns == ["Severity", "priority_score"] and loc.collect()[0]["Severity"] == "urgent"
    lines = spark.createDataFrame([(1, 0, "# **Title**")], "section_no int, line_no int, line string")
    assert report.plain_text(lines).collect()[0]["line"] == " Title"


def test_action_parts_and_titles(spark):
    df = spark.createDataFrame([("cut budget, add negatives / check landing.", "spend without conversions")],
                               "a string, p string")
    r = df.select(report.action_parts(F.col("a")).alias("parts"),
                  report.issue_title(F.col("p"), F.col("a")).alias("t"),
                  report.change_band(F.lit(0.1234)).alias("b"),
                  report.normalise_list(F.lit("a,\n b,, c")).alias("n")).collect()[0]
    assert r["parts"] == ["cut budget", "add negatives", "check landing"]
    assert r["t"] == "explain the conversion drop" and r["b"] == "+12.34%" and r["n"] == "a, b, c"
