"""Registered channel and date-range queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adlens.operators import channels as ch
from adlens.operators.collection import normalise_date_ranges
from adlens.sources import tables

RANGE_TODAY = dt.date(1999, 1, 1)


def _metrics(spark, sf):
    return tables.channel_metrics(spark, sf)


def _range_requests(spark, sf):
    o = tables.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    d = F.col("o_orderdate")
    style = F.col("o_orderkey") % 7
    start = (F.when(style == 0, F.lit("")).when(style == 1, F.lit("2026/06/01"))
             .otherwise(F.date_format(F.date_sub(d.cast("date"), (F.col("o_custkey") % 5).cast("int")), "yyyy-MM-dd")))
    end = (F.when(style == 0, F.lit("")).when(style == 2, F.lit(" "))
           .when(style == 3, F.date_format(F.date_sub(d.cast("date"), 40), "yyyy-MM-dd"))
           .otherwise(F.date_format(F.date_add(d.cast("date"), 3), "yyyy-MM-dd")))
    return o.select("o_orderkey", start.alias("raw_start"), end.alias("raw_end"))


def channel_queries() -> dict:
    return {
        "channel_kpis": lambda spark, sf: ch.integrated_kpis(_metrics(spark, sf)),
        "channel_group_rollup": lambda spark, sf: ch.group_rollup(_metrics(spark, sf)),
        "channel_benchmark": lambda spark, sf: ch.channel_benchmark(_metrics(spark, sf)),
        "channel_review": lambda spark, sf: ch.channel_review(_metrics(spark, sf)),
        "channel_revenue_bars": lambda spark, sf: ch.revenue_bars(_metrics(spark, sf)),
        "channel_display": lambda spark, sf: ch.channel_display(_metrics(spark, sf)),
        "date_range_normalise": lambda spark, sf: normalise_date_ranges(_range_requests(spark, sf), RANGE_TODAY),
    }


METRICS = """cm AS (
  WITH pc AS (
    SELECT c.c_nationkey, o.o_custkey, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS revenue,
           SUM(CAST(o.o_totalprice AS DECIMAL(18,2))
               * CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(0.18 AS DECIMAL(3,2))
                      ELSE CAST(0.09 AS DECIMAL(3,2)) END) AS ad_cost,
           COUNT(*) AS orders, COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS conversions
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, o.o_custkey),
  pn AS (
    SELECT c_nationkey, SUM(revenue) AS revenue, SUM(ad_cost) AS ad_cost, SUM(orders) AS orders,
           SUM(conversions) AS conversions, COUNT(*) AS new_customers, COUNT(*) FILTER (WHERE orders > 1) AS rep
    FROM pc GROUP BY c_nationkey)
  SELECT n.n_name AS channel_name,
         CASE r.r_name WHEN 'AFRICA' THEN '광고매체' WHEN 'AMERICA' THEN '오픈마켓' WHEN 'ASIA' THEN '커머스 플랫폼'
                       WHEN 'EUROPE' THEN '글로벌 채널' ELSE r.r_name END AS channel_group,
         CAST(pn.revenue AS DECIMAL(38,2)) AS revenue, CAST(pn.ad_cost AS DECIMAL(38,4)) AS ad_cost,
         CAST(orders AS BIGINT) AS orders,
         CAST(conversions AS BIGINT) AS conversions, CAST(new_customers AS BIGINT) AS new_customers,
         rep / new_customers AS repeat_purchase_rate,
         COALESCE(CAST(pn.revenue AS DOUBLE) / NULLIF(CAST(pn.ad_cost AS DOUBLE), 0), 0) AS roas
  FROM pn JOIN nation n ON pn.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

BENCH = """bd AS (SELECT channel_group, CAST(benchmark_roas AS DOUBLE) AS benchmark_roas FROM (VALUES ('광고매체', 4.2),
                 ('오픈마켓', 3.6), ('커머스 플랫폼', 3.9), ('글로벌 채널', 2.8)) t(channel_group, benchmark_roas))"""


def _money(x):
    return f"(format('{{:,.0f}}', CAST({x} AS DOUBLE)) || '원')"


def _count(x):
    return f"format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _pct(x):
    return f"(format('{{:,.2f}}', CAST({x} AS DOUBLE) * 100) || '%')"


def channel_oracles() -> dict:
    w = f"WITH {METRICS}"
    ds = "trim(COALESCE(raw_start, ''))"
    de = "trim(COALESCE(raw_end, ''))"
    ranges = f"""WITH rq AS (
  SELECT o_orderkey,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '2026/06/01'
         ELSE strftime(CAST(o_orderdate AS DATE) - CAST(o_custkey % 5 AS INTEGER), '%Y-%m-%d') END AS raw_start,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 2 THEN ' '
         WHEN 3 THEN strftime(CAST(o_orderdate AS DATE) - 40, '%Y-%m-%d')
         ELSE strftime(CAST(o_orderdate AS DATE) + 3, '%Y-%m-%d') END AS raw_end
  FROM orders),
p AS (SELECT *, CASE WHEN {ds} <> '' THEN CAST(try_strptime({ds}, '%Y-%m-%d') AS DATE) END AS ps,
             CASE WHEN {de} <> '' THEN CAST(try_strptime({de}, '%Y-%m-%d') AS DATE) END AS pe FROM rq),
q AS (SELECT *, COALESCE(ps, pe) AS s1, COALESCE(pe, ps) AS e1, (ps IS NULL AND pe IS NULL) AS dflt FROM p),
r AS (SELECT *, s1 > e1 AS swap, CASE WHEN s1 > e1 THEN e1 ELSE s1 END AS s2,
             CASE WHEN s1 > e1 THEN s1 ELSE e1 END AS e2 FROM q),
s AS (SELECT *, e2 > DATE '1998-12-31' AS clamp,
             CASE WHEN e2 > DATE '1998-12-31' THEN DATE '1998-12-31' ELSE e2 END AS e3 FROM r),
t AS (SELECT *, s2 > e3 AS fut, CASE WHEN s2 > e3 THEN e3 ELSE s2 END AS s3 FROM s)
SELECT o_orderkey, raw_start, raw_end,
  CASE WHEN dflt THEN DATE '1998-12-02' ELSE s3 END AS start_date,
  CASE WHEN dflt THEN DATE '1998-12-31' ELSE e3 END AS end_date,
  CASE WHEN dflt THEN 'default_30_days' ELSE 'requested' END AS range_source,
  list_concat(list_concat(list_concat(
    CASE WHEN {ds} <> '' AND ps IS NULL THEN ['invalid_start'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN {de} <> '' AND pe IS NULL THEN ['invalid_end'] ELSE CAST([] AS VARCHAR[]) END),
    list_concat(CASE WHEN NOT dflt AND ps IS NULL THEN ['start_missing'] ELSE CAST([] AS VARCHAR[]) END,
                CASE WHEN NOT dflt AND pe IS NULL THEN ['end_missing'] ELSE CAST([] AS VARCHAR[]) END)),
    list_concat(list_concat(CASE WHEN NOT dflt AND swap THEN ['swapped'] ELSE CAST([] AS VARCHAR[]) END,
                            CASE WHEN NOT dflt AND clamp THEN ['end_clamped'] ELSE CAST([] AS VARCHAR[]) END),
                CASE WHEN NOT dflt AND fut THEN ['all_future'] ELSE CAST([] AS VARCHAR[]) END)) AS warnings
FROM t"""
    return {
        "channel_kpis": f"""{w}
SELECT revenue, ad_cost, orders, conversions, new_customers, COALESCE(revenue / NULLIF(ad_cost, 0), 0) AS roas,
       COALESCE(revenue / NULLIF(orders, 0), 0) AS aov, COALESCE(ad_cost / NULLIF(new_customers, 0), 0) AS cac,
       COALESCE(revenue / NULLIF(orders, 0), 0) * 2.6 AS ltv, repeat_purchase_rate
FROM (SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(ad_cost) AS DOUBLE) AS ad_cost,
             CAST(SUM(orders) AS DOUBLE) AS orders, CAST(SUM(conversions) AS DOUBLE) AS conversions,
             CAST(SUM(new_customers) AS DOUBLE) AS new_customers, AVG(repeat_purchase_rate) AS repeat_purchase_rate
      FROM cm) t""",
        "channel_group_rollup": f"""{w}, {BENCH},
per AS (SELECT channel_group, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(ad_cost) AS DOUBLE) AS ad_cost,
               COUNT(*) AS channels FROM cm GROUP BY channel_group),
g AS (SELECT channel_group FROM bd UNION SELECT channel_group FROM per)
SELECT g.channel_group, COALESCE(revenue, 0.0) AS revenue, COALESCE(ad_cost, 0.0) AS ad_cost,
       CAST(COALESCE(channels, 0) AS BIGINT) AS channels FROM g LEFT JOIN per USING (channel_group)""",
        "channel_benchmark": f"""{w}, {BENCH}
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY gap DESC, channel_name) AS INTEGER) AS gap_rank FROM (
  SELECT channel_name, channel_group, roas AS current_roas, COALESCE(benchmark_roas, 3.5) AS benchmark_roas,
         roas - COALESCE(benchmark_roas, 3.5) AS gap,
         CASE WHEN roas >= COALESCE(benchmark_roas, 3.5) THEN 'above_benchmark' ELSE 'below_benchmark' END AS status
  FROM cm LEFT JOIN bd USING (channel_group)) t""",
        "channel_review": f"""{w}
SELECT arg_max(channel_name, (roas, channel_name)) AS best_channel, MAX(roas) AS best_roas,
       arg_min(channel_name, (roas, channel_name)) AS weak_channel, MIN(roas) AS weak_roas, AVG(roas) AS avg_roas,
       COUNT(*) AS active_channels FROM cm WHERE ad_cost > 0""",
        "channel_revenue_bars": f"""{w}
SELECT channel_name, CAST(revenue AS DOUBLE) AS revenue, CASE WHEN mx <= 0 THEN 0.0
       ELSE GREATEST(LEAST(CAST(revenue AS DOUBLE) / mx * 100, 100.0), 2.0) END AS bar_pct
FROM cm, (SELECT CAST(MAX(revenue) AS DOUBLE) AS mx FROM cm) m""",
        "channel_display": f"""{w}
SELECT channel_name, channel_group, {_money('revenue')} AS revenue, {_money('ad_cost')} AS ad_cost,
       {_count('orders')} AS orders, {_count('conversions')} AS conversions, {_count('new_customers')} AS new_customers,
       {_pct('repeat_purchase_rate')} AS repeat_purchase_rate, {_pct('roas')} AS roas FROM cm""",
        "date_range_normalise": ranges,
    }
