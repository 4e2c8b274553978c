"""Collection log (FIXTURES.md §5), date-range normaliser (§6) and stats JSON (§4)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from adlens.operators import collection as col

LOG_SCHEMA = ("collection_id string, advertiser_id string, media string, started_at string, finished_at string, "
              "status string, rows_collected bigint, file_count bigint, storage_used_mb double, error_code string, "
              "error_message string")


def _log(spark, rows):
    return spark.createDataFrame([r + (0, 0, 0.0, code, msg) for r, code, msg in rows], LOG_SCHEMA)


def test_recent_logs_order(spark):
    log = _log(spark, [(("1", "a", "gmarket", "2026-06-18 10:00:00", "2026-06-18 10:01:00", "success"), "", ""),
                       (("2", "a", "auction", "2026-06-18 11:00:00", "2026-06-18 11:01:00", "failed"), "E1", "boom")])
    got = [r["status"] for r in col.recent_logs(log).collect()]
    assert got == ["failed", "success"]


def test_success_then_failure_with_offset(spark):
    log = _log(spark, [
        (("1", "a", "gmarket", "2026-06-18T09:00:00+09:00", "2026-06-18T09:01:00+09:00", "success"), "", ""),
        (("2", "a", "gmarket", "2026-06-18T10:00:00+09:00", "2026-06-18T10:01:00+09:00", "failed"), "E", "bad"),
    ])
    h = col.media_health(log, dt.datetime(2026, 6, 19)).collect()[0]
    assert h["latest_status"] == "failed"
    assert h["last_success_at"] == dt.datetime(2026, 6, 18, 9, 1)
    assert h["last_failure_at"] == dt.datetime(2026, 6, 18, 10, 1)
    assert h["success_rate_30d"] == 50.0 and h["error_message"] == "bad"


def test_utc_offset_to_korean_wall_time(spark):
    df = spark.createDataFrame([("2026-06-18T00:05:00+00:00",), ("2026-06-18 00:05:00",), ("bad",), ("",)], "t string")
    got = [r["x"] for r in df.select(col.parse_log_time("t").alias("x")).collect()]
    assert got == [dt.datetime(2026, 6, 18, 9, 5), dt.datetime(2026, 6, 18, 0, 5), None, None]


def test_latest_event_times(spark):
    log = _log(spark, [
        (("1", "a", "gmarket", "2026-06-18 09:00:00", "2026-06-18 09:01:00", "success"), "", ""),
        (("2", "a", "auction", "2026-06-18 10:00:00", "2026-06-18 10:05:00", "success"), "", ""),
        (("3", "a", "auction", "2026-06-18 11:00:00", "2026-06-18 11:05:00", "no_data"), "", ""),
    ])
    t = col.latest_event_times(col.media_health(log, dt.datetime(2026, 6, 19))).collect()[0]
    assert t["last_success_at"] == dt.datetime(2026, 6, 18, 10, 5)
    assert t["last_failure_at"] == dt.datetime(2026, 6, 18, 11, 5)


def test_upsert_keeps_latest(spark):
    log = _log(spark, [(("1", "a", "m", "2026-06-18 09:00:00", "2026-06-18 09:01:00", "failed"), "E", "x")])
    a = log.withColumn("ingest_seq", F.lit(0))
    b = log.withColumn("status", F.lit("success")).withColumn("ingest_seq", F.lit(1))
    r = col.resolve_latest(a.unionByName(b)).collect()
    assert len(r) == 1 and r[0]["status"] == "success"


def test_run_classification(spark):
    df = spark.createDataFrame([("failed", 5, False, "success", "success"), ("success", 0, False, "success", "success"),
                                ("success", 5, False, "failed", "success"), ("success", 5, False, "success", "success")],
                               "s string, n int, z boolean, p string, r string")
    got = [r["x"] for r in df.select(col.classify_api_run(F.col("s"), F.col("n"), F.col("z"), F.col("p"), F.col("r"))
                                     .alias("x")).collect()]
    assert got == ["failed", "no_data", "partial", "success"]
    wl = spark.createDataFrame([("Success",), ("weird",)], "s string").select(col.whitelist_status(F.col("s")).alias("x"))
    assert [r["x"] for r in wl.collect()] == ["success", "failed"]


@pytest.mark.parametrize("today,start,end,expected", [
    (dt.date(2026, 6, 18), "", "", (dt.date(2026, 5, 19), dt.date(2026, 6, 17))),
    (dt.date(2026, 6, 18), "2026-06-10", "2026-06-01", (dt.date(2026, 6, 1), dt.date(2026, 6, 10))),
    (dt.date(2026, 6, 20), "2026-06-10", "2026-06-25", (dt.date(2026, 6, 10), dt.date(2026, 6, 19))),
    (dt.date(2026, 6, 20), "2026-06-25", "2026-06-30", (dt.date(2026, 6, 19), dt.date(2026, 6, 19))),
])
def test_date_range_normaliser(spark, today, start, end, expected):
    req = spark.createDataFrame([(start, end)], "raw_start string, raw_end string")
    r = col.normalise_date_ranges(req, today).collect()[0]
    assert (r["start_date"], r["end_date"]) == expected
