"""Stats payloads of any shape and depth."""

import json

import pytest
from pyspark.sql import functions as F

from adlens.operators import jsonstats as js

WEEK = {"ids": ["shoes"], "timeRange": json.dumps({"since": "2025-03-03", "until": "2025-03-09"})}


def docs(spark, *payloads, request=WEEK):
    return spark.createDataFrame([(i, "seller", p if p is None or isinstance(p, str) else json.dumps(p), json.dumps(request))
                                  for i, p in enumerate(payloads)],
                                 "doc_id long, advertiser string, payload string, request string")


def shredded(spark, payload, request=WEEK):
    rows = js.shred_stats(docs(spark, payload, request=request)).orderBy("row_no").collect()
    return [(r["campaign"], r["date"], r["impressions"]) for r in rows]


def test_record_becomes_a_standard_row(spark):
    payload = {"data": [{"id": "shoes", "fields": {"impCnt": 640, "clkCnt": 32, "salesAmt": 4800, "ccnt": 4, "convAmt": 19200}}]}
    names = js.id_lookup(spark.createDataFrame([("shoes", "Spring shoes")], "nccCampaignId string, name string"),
                         spark.createDataFrame([], "nccAdgroupId string, nccCampaignId string, name string"),
                         spark.createDataFrame([], "nccKeywordId string, nccAdgroupId string, keyword string"))
    row, = js.shred_stats(docs(spark, payload), names).collect()
    assert row.asDict() | {"ctr": None} == {
        "doc_id": 0, "row_no": 1, "date": "2025-03-03", "advertiser": "seller", "media": row["media"], "campaign": "Spring shoes",
        "ad_group": "", "keyword": "", "product_name": "", "impressions": 640, "clicks": 32, "cost": 4800, "conversions": 4,
        "revenue": 19200, "roas": 4, "cpc": 150, "ctr": None, "orders": 4}
    assert row["ctr"] == pytest.approx(0.05) and list(row.asDict())[2:] == js.STANDARD_COLUMNS


def test_without_records_each_requested_id_gets_a_zero_row(spark):
    ask = {"ids": ["hats", "bags"], "timeRange": {"since": "2025-01-01"}}
    for payload in ({"data": []}, {}, [], None, "  ", {"response": {"response": {"items": []}}}):
        assert shredded(spark, payload, ask) == [("hats", "2025-01-01", 0), ("bags", "2025-01-01", 0)]
    total = js.collected_summary(js.shred_stats(docs(spark, {"data": []}))).first()
    assert total["all_zero"] is True and total["shortage_metrics"] == ["conversions", "revenue", "roas"]


@pytest.mark.parametrize("depth", [1, 5, 6, 9, 40])
def test_any_number_of_response_levels(spark, depth):
    payload = {"data": [{"id": "deep", "impCnt": 11}, {"id": "deeper", "impCnt": 12}]}
    for _ in range(depth):
        payload = {"response": payload}
    assert shredded(spark, payload) == [("deep", "2025-03-03", 11), ("deeper", "2025-03-03", 12)]
    assert docs(spark, payload).select(js.data_row_count(F.col("payload")).alias("n")).first()["n"] == 2


def test_lists_inside_lists(spark):
    payload = [[], [[{"id": "p", "impCnt": 4}], {"rows": [[[{"id": "q", "impCnt": 5}]]]}]]
    assert shredded(spark, payload) == [("p", "2025-03-03", 4), ("q", "2025-03-03", 5)]


def test_document_order(spark):
    payload = {"results": [{"response": {"items": [{"id": "second", "data": {"impCnt": 2}}]}, "id": "third", "impCnt": 3},
                           {"rows": [{"id": "fourth", "impCnt": 4}], "data": [{"id": "before fourth", "impCnt": 7}]}],
               "response": {"result": [{"id": "first", "impCnt": 1}]}}
    assert [x[0] for x in shredded(spark, payload)] == ["first", "second", "third", "before fourth", "fourth"]


def test_inner_values_and_number_text(spark):
    payload = [{"rows": [{"id": "k", "salesAmt": "2,500", "convAmt": "10,000", "ror": 0, "fields": {"clkCnt": 1e2, "salesAmt": None}}]}]
    row, = js.shred_stats(docs(spark, payload)).collect()
    assert (row["cost"], row["revenue"], row["clicks"]) == (0, 10000, 100)  # the inner null replaces the outer value
    payload = [{"rows": [{"id": "k", "impCnt": 5, "clkCnt": 6, "salesAmt": 7, "fields": {"impCnt": None, "clkCnt": [1], "salesAmt": 8}}]}]
    row, = js.shred_stats(docs(spark, payload)).collect()
    assert (row["impressions"], row["clicks"], row["cost"]) == (0, 0, 8)


def test_ids_attach_by_position(spark):
    payload = {"data": [{"statDt": "2025-02-01", "data": {"impCnt": 8}}, {"statDt": "2025-02-02", "data": {"impCnt": 9}}]}
    ask = {"ids": ["left", "right"], "timeRange": {"since": "2025-02-01"}}
    assert shredded(spark, payload, ask) == [("left", "2025-02-01", 8), ("right", "2025-02-02", 9)]


def test_broken_payloads_raise(spark):
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        js.shred_stats(docs(spark, '{"data": [')).collect()


def test_counts_ids_and_hashes(spark):
    d = docs(spark, {"response": {"data": [1, 2, 3]}}, {"data": []}, [7], {"a": {"b": [{"id": "m"}, {"id": ""}, [{"id": "n"}]]}})
    assert [r["n"] for r in d.orderBy("doc_id").select(js.data_row_count(F.col("payload")).alias("n")).collect()] == [3, 0, None, None]
    assert [r["id"] for r in js.collect_ids(d, "id").collect()] == ["m"]
    assert len(d.select(js.anonymised_id(F.lit("88")).alias("h")).first()["h"]) == 12


def test_one_narrow_pass(spark):
    src = spark.range(3).selectExpr("id AS doc_id", "'a' AS advertiser", "'{}' AS payload", "'{}' AS request")
    plan = js.shred_stats(src)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Exchange" not in plan and plan.count("Range (") == 1


def test_landed_files(spark, tmp_dir):
    import os
    with open(os.path.join(tmp_dir, "a.json"), "w", encoding="utf-8") as f:
        json.dump({"data": [{"id": "x", "impCnt": 1}]}, f, indent=2)
    row, = js.read_payloads(spark, tmp_dir).collect()
    assert json.loads(row["payload"])["data"][0]["id"] == "x" and row["path"].endswith("a.json")
