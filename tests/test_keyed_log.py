"""The keyed log: any order of arrival, repeated batches, compaction of touched buckets, interrupted writes."""

import os

from pyspark.sql import functions as F

from adlens.operators import compare, metrics
from adlens.operators.collection import resolve_latest
from adlens.sources import tables
from adlens.streaming import watch
from adlens.streaming.keyed_log import KeyedLog

SMOKE = "/root/testdata/sf0.001"


def _sum_log(spark, path, **options):
    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").cast("long").alias("n"))
    return KeyedLog(spark, path, ["k"], merge, buckets=8, **options)


def _rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, n long")


def _read(log):
    return {r["k"]: r["n"] for r in log.read().collect()}


def test_batches_count_once_and_compaction_keeps_the_sums(spark, tmp_dir):
    log = _sum_log(spark, f"{tmp_dir}/log", compact_every=None)
    assert log.read() is None and log.compact() == []
    log.append(_rows(spark, [("a", 1), ("b", 2)]), 0)
    log.append(_rows(spark, [("a", 10)]), 1)
    log.append(_rows(spark, [("a", 10)]), 1)  # runs again
    assert _read(log) == {"a": 11, "b": 2}
    log.compact()
    assert _read(log) == {"a": 11, "b": 2}
    log.append(_rows(spark, [("a", 10)]), 1)  # runs again after it was taken in
    log.append(_rows(spark, [("c", 5)]), 2)
    assert _read(log) == {"a": 11, "b": 2, "c": 5}
    log.append(_rows(spark, []), 3)
    assert _read(log) == {"a": 11, "b": 2, "c": 5}
    assert [r["n"] for r in log.read(k="a").collect()] == [11] and log.read(k="c").count() == 1


def test_compaction_rewrites_touched_buckets_only(spark, tmp_dir):
    log = _sum_log(spark, f"{tmp_dir}/log", compact_every=None)
    log.append(_rows(spark, [(str(i), i) for i in range(100)]), 0)
    assert len(log.compact()) == 8
    log.append(_rows(spark, [("7", 1)]), 1)
    touched = log.compact()
    assert len(touched) == 1
    assert sorted(os.path.basename(d) for d in os.listdir(f"{tmp_dir}/log/state/upto=1") if d.startswith("bucket=")) == [f"bucket={touched[0]}"]
    log.append(_rows(spark, [("8", 1)]), 2)
    log.compact()
    assert _read(log) == {str(i): i + (i in (7, 8)) for i in range(100)}


def test_an_interrupted_compaction_leaves_no_trace(spark, tmp_dir):
    log = _sum_log(spark, f"{tmp_dir}/log", compact_every=None)
    log.append(_rows(spark, [("a", 1)]), 0)
    log.append(_rows(spark, [("a", 2)]), 1)
    log.compact()
    os.remove(f"{tmp_dir}/log/state/upto=1/_SUCCESS")  # as if the job had died before its commit
    for f in os.listdir(f"{tmp_dir}/log/state/upto=1"):
        if f.endswith(".crc"):
            os.remove(f"{tmp_dir}/log/state/upto=1/{f}")
    assert _read(log) == {"a": 3}
    log.compact()
    assert _read(log) == {"a": 3}


def test_versions_of_records(spark, tmp_dir):
    log = KeyedLog(spark, f"{tmp_dir}/log", ["collection_id"], resolve_latest, compact_every=2)
    for n, rows in enumerate([[("x", "failed", 0), ("y", "ok", 0)], [("x", "ok", 1)], [("z", "ok", 2)], [("y", "failed", 3)]]):
        log.append(spark.createDataFrame(rows, "collection_id string, status string, ingest_seq long"), n)
    assert {tuple(r) for r in log.read().collect()} == {("x", "ok", 1), ("y", "failed", 3), ("z", "ok", 2)}


def test_daily_stream_keeps_rows_of_any_age(spark, tmp_dir):
    """Days in shuffled order over several triggers, then rows of a year before: equal to the batch."""
    events = spark.read.parquet(f"{SMOKE}/events.parquet")
    landing, path, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/log", f"{tmp_dir}/ckpt"
    events.repartition(5, F.xxhash64("event_id")).write.parquet(landing)
    late = events.limit(40).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 YEAR"))

    def run():
        source = watch.stream_source(spark, landing, events.schema, max_files_per_trigger=1)
        return watch.run_daily_kpi(tables.event_fact_from(source), (), path, ckpt, compact_every=2)

    def same(log, rows):
        got = watch.daily_table(log.read()).collect()
        want = metrics.period_table(tables.event_fact_from(rows), "daily").collect()
        cols = sorted(want[0].asDict())
        assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(tuple(r[c] for c in cols) for r in want)

    same(run(), events)
    assert os.path.isdir(f"{path}/state")  # compacted on the way
    late.coalesce(1).write.mode("append").parquet(landing)
    same(run(), events.unionByName(late))


def _halves(rows):
    """(previous, current) cost by the definition, over (timestamp, cost) rows."""
    import datetime as dt
    first, last = min(t for t, _ in rows), max(t for t, _ in rows)
    half = max(((last - first).days + 1) // 2, 1)
    split = last - dt.timedelta(days=half - 1)
    return sum(c for t, c in rows if t < split), sum(c for t, c in rows if t >= split)


def test_halves_split_inside_a_day(spark):
    import datetime as dt
    import random
    r = random.Random(1)
    rows = []
    for a in range(8):
        whole = a % 2 == 0
        days = r.randint(1, 9)
        for _ in range(r.randint(1, 40)):
            t = dt.datetime(2026, 1, 1 + r.randint(0, days)) + (dt.timedelta() if whole or r.random() < 0.3 else dt.timedelta(seconds=r.randint(1, 86399)))
            rows.append((t, f"a{a}", r.randint(1, 1000)))
    data = [(t, "p", a, "c", "g", "k", "n", 1, 1, float(c), 0, 0.0, 0) for t, a, c in rows]
    fact = spark.createDataFrame(data, "date timestamp_ntz, platform string, account_name string, campaign_name string, ad_group_name string, "
                                       "keyword string, product_name string, impressions long, clicks long, cost double, conversions long, revenue double, orders long")
    got = {r["account_name"]: (r["previous"], r["current"])
           for r in compare.recent_comparison(fact, ["account_name"]).where("metric = 'cost'").collect()}
    assert got == {a: _halves([(t, c) for t, b, c in rows if b == a]) for a in {a for _, a, _ in rows}}
    whole = compare.recent_comparison(fact).where("metric = 'cost'").first()
    assert (whole["previous"], whole["current"]) == _halves([(t, c) for t, _, c in rows])


def test_ranges_read_the_fact_once(spark):
    fact = tables.ad_fact(spark, SMOKE)
    for df in (compare.preset_kpis(fact), compare.preset_kpis(fact, ["account_name"]),
               compare.recent_comparison(fact, ["account_name"], whole_days=True), compare.recent_comparison(fact, whole_days=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1


def test_times_of_day_are_not_ignored_silently(spark):
    import pytest
    with pytest.raises(Exception, match="time of day"):
        compare.recent_comparison(tables.event_fact(spark, SMOKE), whole_days=True).collect()
