"""Registered queries for freshness, bounds, sheet union, evidence reasons and sample KPIs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adlens.operators import collection as col
from adlens.operators import compare, metrics, report
from adlens.plans import oracle_sql as o
from adlens.sources import tables

TODAY = dt.date(2002, 1, 1)


def _evidence(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et, v = F.col("event_type"), F.col("value")
    payload = F.to_json(F.struct(
        F.when(et == "signup", "needs_user_authentication").when(et == "view", "no_data").otherwise("")
        .alias("final_status"),
        F.when((et == "error") & (v > 250), "NETWORK_ACCESS_DENIED").when(et == "click", "DOWNLOAD_FILE_NOT_FOUND")
        .otherwise("").alias("error_code"),
        F.when((et == "error") & (v <= 250), F.concat(F.lit("timeout "), (F.col("user_id") % 3).cast("string")))
        .otherwise("").alias("error_message"),
        F.when(F.col("event_id") % 2 == 0, "ERR_NETWORK_ACCESS_DENIED").otherwise("").alias("detail"),
        F.when(et.isin("error", "purchase"), "failed").otherwise("ok").alias("status")))
    return ev.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("media"),
                     F.col("ts").cast("timestamp_ntz").alias("modificationTime"), payload.alias("payload"))


def _registry(spark, sf):
    from adlens.sources.tables import REGION_CHANNEL_GROUP
    n = tables.read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = tables.read_table(spark, sf, "region").select("r_regionkey", "r_name")
    group_map = F.create_map(*[x for kv in REGION_CHANNEL_GROUP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("channel_name"), F.coalesce(group_map[F.col("r_name")], F.col("r_name"))
        .alias("channel_group"), (k % 7).alias("display_order"), (k % 5 != 4).alias("is_active"))


def extra_queries() -> dict:
    from adlens.operators import channels, jsonstats, rules
    from adlens.plans.audit_queries import audit_queries
    from adlens.plans.collection_queries import collection_queries
    return {
        "status_required_fields": audit_queries()["audit_required_status"],
        "failure_digest": lambda spark, sf: collection_queries()["overall_status"](spark, sf).select(
            "overall_status", "failure_reason"),
        "top_signals": lambda spark, sf: rules.anomalies(tables.ad_fact(spark, sf)).orderBy(
            "base_rank", "rule_seq").limit(6),
        "active_channels": lambda spark, sf: channels.active_channels(_registry(spark, sf)),
        "stat_ids": lambda spark, sf: jsonstats.collect_ids(
            tables.stats_documents(spark, sf), "id"),
        "data_freshness": lambda spark, sf: col.data_freshness(tables.ad_fact(spark, sf), TODAY),
        "data_freshness_by_account": lambda spark, sf: col.data_freshness(tables.ad_fact(spark, sf), TODAY,
                                                                          ["account_name"]),
        "default_ranges": lambda spark, sf: compare.default_ranges(tables.ad_fact(spark, sf), ["account_name"]),
        "date_bounds": lambda spark, sf: metrics.date_bounds(tables.ad_fact(spark, sf)),
        "union_sheets": lambda spark, sf: report.union_sources({
            "lineitem": tables.ad_fact(spark, sf).drop("orders"), "events": tables.event_fact(spark, sf)}),
        "connection_reasons": lambda spark, sf: col.connection_reasons(_evidence(spark, sf)),
        "sample_kpis": lambda spark, sf: report.sample_kpis(
            tables.read_table(spark, sf, "documents"), "source", "n_chars", "lang", "en"),
    }


def extra_oracles() -> dict:
    fact = o.with_ctes(o.AD_FACT)
    fresh = """SELECT {sel}CAST(MIN(date) AS DATE) AS min_date, CAST(MAX(date) AS DATE) AS max_date,
       CAST(GREATEST(date_diff('day', CAST(MAX(date) AS DATE), DATE '2002-01-01'), 0) AS INTEGER) AS lag_days,
       CASE WHEN MAX(date) IS NULL THEN NULL
            WHEN GREATEST(date_diff('day', CAST(MAX(date) AS DATE), DATE '2002-01-01'), 0) <= 1 THEN '최신'
            WHEN GREATEST(date_diff('day', CAST(MAX(date) AS DATE), DATE '2002-01-01'), 0) <= 7 THEN '주의'
            ELSE '오래됨' END AS freshness,
       COUNT(*) FILTER (WHERE date IS NULL) AS undated_rows
FROM ad_fact{grp}"""
    reasons = """WITH e AS (
  SELECT 'm' || CAST(user_id % 5 AS VARCHAR) AS media, ts, event_id, user_id, event_type, value FROM events),
l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY media ORDER BY ts DESC, event_id DESC) AS rk FROM e) z
      WHERE rk = 1)
SELECT media,
  CASE WHEN event_type = 'error' AND value > 250 THEN 'ad centre blocked from this environment; re-check from a permitted browser'
       WHEN event_type = 'signup' THEN 'user login or authentication needed'
       WHEN event_type = 'view' THEN 'no ad data for the selected period'
       WHEN event_type = 'click' THEN 'download file not detected'
       WHEN event_type = 'error' THEN 'timeout ' || CAST(user_id % 3 AS VARCHAR)
       WHEN event_type = 'purchase' AND event_id % 2 = 0
         THEN 'network access denied on this machine; re-check after authentication'
       WHEN event_type = 'purchase' THEN 'ad centre connection check needed'
       ELSE 'awaiting verification' END AS reason
FROM l"""
    from adlens.plans.audit_queries import audit_oracles
    from adlens.plans.collection_queries import collection_oracles
    return {
        "status_required_fields": audit_oracles()["audit_required_status"],
        "failure_digest": f"WITH o AS ({collection_oracles()['overall_status']})\n"
                          "SELECT overall_status, failure_reason FROM o",
        "top_signals": f"WITH a AS ({o.anomalies()})\nSELECT * FROM a ORDER BY base_rank, rule_seq LIMIT 6",
        "active_channels": """SELECT n_name AS channel_name,
       CASE r_name WHEN 'AFRICA' THEN '광고매체' WHEN 'AMERICA' THEN '오픈마켓' WHEN 'ASIA' THEN '커머스 플랫폼'
                   WHEN 'EUROPE' THEN '글로벌 채널' ELSE r_name END AS channel_group,
       n_nationkey % 7 AS display_order, n_nationkey % 5 <> 4 AS is_active
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4""",
        "stat_ids": """SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'cmp-' WHEN 1 THEN 'grp-' ELSE 'kw-' END
                           || json_extract_string(props, '$.k') AS id
FROM events WHERE CAST(floor(event_id / 25) AS BIGINT) % 4 = 0""",
        "data_freshness": f"{fact}\n" + fresh.format(sel="", grp=""),
        "data_freshness_by_account": f"{fact}\n" + fresh.format(sel="account_name, ", grp=" GROUP BY account_name"),
        "default_ranges": f"""{fact},
b AS (SELECT account_name, CAST(MIN(date) AS DATE) AS lo, CAST(MAX(date) AS DATE) AS hi FROM ad_fact
      WHERE date IS NOT NULL GROUP BY account_name),
h AS (SELECT *, lo + CAST(greatest((hi - lo + 1) // 2, 1) - 1 AS INTEGER) AS mid FROM b)
SELECT account_name, lo AS first_start, mid AS first_end, least(mid + 1, hi) AS second_start, hi AS second_end FROM h""",
        "date_bounds": f"""{fact}
SELECT CAST(MIN(date) AS DATE) AS min_date, CAST(MAX(date) AS DATE) AS max_date,
       COUNT(*) FILTER (WHERE date IS NULL) AS undated_rows FROM ad_fact""",
        "union_sheets": f"""{o.with_ctes(o.AD_FACT, o.EVENT_FACT)}
SELECT * EXCLUDE (orders), CAST(NULL AS BIGINT) AS orders, 'lineitem' AS source_sheet FROM ad_fact
UNION ALL SELECT *, 'events' FROM event_fact""",
        "connection_reasons": reasons,
        "sample_kpis": """SELECT COUNT(*) AS rows, COUNT(DISTINCT source) AS entities, AVG(n_chars) AS mean_rating,
       COUNT(*) FILTER (WHERE lang = 'en') AS flagged FROM documents""",
    }
