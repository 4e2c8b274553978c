"""Streaming = batch, folder watch exactly-once, and physical-plan properties."""

import os

from adlens.operators import metrics, rules
from adlens.plans.queries import all_queries
from adlens.sources import tables
from adlens.streaming import watch

SMOKE = "/root/testdata/sf0.001"


def _rows(df, key):
    return sorted((tuple(r) for r in df.select(*key).collect()))


def test_update_mode_media_health_over_several_triggers(spark, tmp_dir):
    """Three landed files, one per trigger: update-mode output + upsert on read == batch."""
    from pyspark.sql import functions as F
    from adlens.operators import collection
    from adlens.plans.collection_queries import AS_OF
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    land = os.path.join(tmp_dir, "landing")
    for i in range(3):
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{land}/part{i}")
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(land) for f in fs if f.endswith(".parquet"))
    flat = os.path.join(tmp_dir, "flat")
    os.makedirs(flat)
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"events_{i}.parquet"))
    stream = watch.stream_source(spark, flat, ev.schema, "*.parquet", max_files_per_trigger=1)
    got = watch.run_to_table(watch.media_health_stream(tables.collection_log_from(stream), AS_OF), "t_upd",
                             output_mode="update", key="media")
    want = collection.media_health(tables.collection_log_raw(spark, SMOKE), AS_OF)
    cols = ["media", "latest_status", "last_success_at", "last_failure_at", "success_count_30d", "total_count_30d"]
    assert _rows(got, cols) == _rows(want, cols)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_watch_folder_processes_each_file_once(spark, tmp_dir):
    inbox, out, ckpt = f"{tmp_dir}/inbox", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    _write(f"{inbox}/a.csv", "date,platform,cost,clicks\n2026-06-01,naver,100,4\n2026-06-02,naver,50,1\n")
    watch.watch_report_folder(spark, inbox, out, once=True, checkpoint=ckpt, analysis=False)
    assert spark.read.parquet(f"{out}/standardized").count() == 2
    _write(f"{inbox}/b.csv", "일자,매체,광고비\n2026-06-03,G마켓,\"1,000\"\n")
    watch.watch_report_folder(spark, inbox, out, once=True, checkpoint=ckpt, analysis=False)
    std = spark.read.parquet(f"{out}/standardized")
    assert std.count() == 3  # a.csv is not processed again
    assert sorted(r["cost"] for r in std.collect()) == [50.0, 100.0, 1000.0]
    assert spark.read.parquet(f"{out}/audit").count() == 2


def test_watch_counts_a_batch_once_that_failed_half_way(spark, tmp_dir, monkeypatch):
    import pytest
    inbox, out, ckpt = f"{tmp_dir}/inbox", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    _write(f"{inbox}/a.csv", "date,campaign,cost,clicks\n2026-06-01,c1,100,4\n2026-06-02,c2,50,1\n")
    right = watch.file_audit

    def broken(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(watch, "file_audit", broken)  # after the fact is written
    with pytest.raises(Exception, match="executor lost"):
        watch.watch_report_folder(spark, inbox, out, checkpoint=ckpt)
    assert spark.read.parquet(f"{out}/standardized").count() == 2
    monkeypatch.setattr(watch, "file_audit", right)
    watch.watch_report_folder(spark, inbox, out, checkpoint=ckpt)
    _write(f"{inbox}/b.csv", "date,campaign,cost\n2026-06-03,c3,7\n")
    watch.watch_report_folder(spark, inbox, out, checkpoint=ckpt, analysis=False)
    assert sorted(r["cost"] for r in spark.read.parquet(f"{out}/standardized").collect()) == [7, 50, 100]
    assert spark.read.parquet(f"{out}/audit").count() == 2
    summary = spark.read.parquet(f"{out}/analysis/batch_id=0/summary/rows")
    assert summary.count() == 1 and summary.first()["cost"] == 150
    assert os.path.isdir(f"{out}/analysis/batch_id=0/report_md")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_all_is_one_aggregation_exchange(spark):
    plan = _plan(metrics.segments_all(tables.ad_fact(spark, SMOKE)))
    assert "Expand" in plan
    # one hash-partitioned exchange for the grouping sets (plus the top-N window exchange)
    assert plan.count("Exchange hashpartitioning") <= 2


def test_core_queries_stay_jvm_side(spark):
    for df in [metrics.kpi_summary(tables.ad_fact(spark, SMOKE)), rules.anomalies(tables.ad_fact(spark, SMOKE))]:
        plan = _plan(df)
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_date_filter_reaches_the_scan(spark):
    df = all_queries()["ab_comparison"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" in plan.split("PushedFilters")[1][:400]


def test_hot_keys_are_combined_before_the_shuffle(spark):
    """Per-scope aggregates combine map-side: a hot scope ships partial rows, not raw rows."""
    from adlens.operators import collection
    from adlens.plans.collection_queries import AS_OF
    for df in [metrics.kpi_summary(tables.ad_fact(spark, SMOKE), ["account_name"]),
               metrics.segment_table(tables.ad_fact(spark, SMOKE), "keyword", ["account_name"]),
               collection.media_health(tables.collection_log_raw(spark, SMOKE), AS_OF)]:
        plan = _plan(df)
        assert "partial_" in plan  # partial aggregate below the exchange
    # per-scope top-N limits each map partition before its exchange
    topn = metrics.segment_table(tables.ad_fact(spark, SMOKE), "keyword", ["account_name"])
    topn.collect()
    final = topn._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" in final


def test_small_dimensions_broadcast_by_size(spark):
    plan = _plan(metrics.kpi_summary(tables.ad_fact(spark, SMOKE)))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_anomalies_are_found_once_for_scoped_issues(spark):
    """Issues and recommendations take a scope's hits from its state: one set of thresholds, platforms only for issues."""
    from adlens.operators import issues, rules
    from adlens.sources.tables import ad_fact
    fact = ad_fact(spark, "/root/testdata/sf0.001")
    assert rules.rule_aggregates(fact, ["account_name"], shared=False, platforms=False)[1] is None
    for build in (issues.action_issues, rules.recommendations, issues.health_score):
        plan = build(fact, ["account_name"])._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Window [" in line and "percentile" in line for line in plan.split("\n")) == 1


def test_whole_day_facts_are_not_read_again(spark):
    """Without a time of day the halves come from the written sums; with one, the fact is read once more."""
    from adlens.operators import compare
    from pyspark.sql import functions as F
    from adlens.sources.tables import monthly_account_fact
    fact = monthly_account_fact(spark, "/root/testdata/sf0.001")
    scans = lambda f: compare.recent_comparison(f, ["account_name"])._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    assert not scans(fact)
    assert scans(fact.withColumn("date", F.timestamp_add("HOUR", F.lit(5), "date")))
    same = compare.recent_comparison(fact, ["account_name"], whole_days=True)
    assert not compare.recent_comparison(fact, ["account_name"]).exceptAll(same).count()
