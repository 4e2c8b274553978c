"""Registered JSON-stats queries and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adlens.operators import jsonstats as js
from adlens.session import checkpoint_dir
from adlens.sources import tables


def _shred(spark, sf):
    docs = tables.stats_documents(spark, sf)
    lookup = js.id_lookup(*tables.stats_dimensions(spark, sf))
    return js.shred_stats(docs, lookup, "advertiser")


def _standard_csv(spark, sf):
    """The standard rows written as CSV files by advertiser and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/adlens-tables/stats-csv-{uuid.uuid4().hex}"
    rows = _shred(spark, sf).select(*js.STANDARD_COLUMNS)
    js.write_standard_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path).fillna("")  # an empty cell reads as null


def _rounded(df):
    # Sums of floating ratios depend on addition order; compare them at 4 decimals.
    return df.withColumns({m: F.round(m, 4) for m in
                           ["impressions", "clicks", "cost", "conversions", "revenue", "roas", "cpc", "ctr"]})


def json_queries() -> dict:
    return {
        "json_shred": _shred,
        "standard_csv": lambda spark, sf: _standard_csv(spark, sf).select(*js.STANDARD_COLUMNS),
        "json_zero_fallback": lambda spark, sf: _shred(spark, sf).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
            F.bool_and((F.col("impressions") + F.col("clicks") + F.col("cost") + F.col("conversions")
                        + F.col("revenue")) == 0).alias("all_zero")),
        "positional_ids": lambda spark, sf: _shred(spark, sf).select(
            "doc_id", "row_no", "campaign", "ad_group", "keyword"),
        "id_name_join": lambda spark, sf: js.id_lookup(*tables.stats_dimensions(spark, sf)),
        "json_collected_summary": lambda spark, sf: _rounded(js.collected_summary(_shred(spark, sf), ["advertiser"])),
        "json_data_row_count": lambda spark, sf: tables.stats_documents(spark, sf).select(
            "doc_id", js.data_row_count(F.col("payload")).alias("data_rows")),
        "anonymised_ids": lambda spark, sf: tables.read_table(spark, sf, "customer").select(
            "c_custkey", js.anonymised_id("c_custkey").alias("account_hash")),
    }


EV = """ev AS (
  SELECT event_id, CAST(floor(event_id / 25) AS BIGINT) AS doc_id, strftime(ts, '%Y-%m-%d') AS day,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE user_id % 3 WHEN 0 THEN 'cmp-' WHEN 1 THEN 'grp-' ELSE 'kw-' END
           || json_extract_string(props, '$.k') AS sid,
         CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS DOUBLE) AS impressions,
         CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS clicks,
         CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS cost,
         CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS conversions,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue
  FROM events)"""

LOOKUP = """ks AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
camp AS (SELECT 'cmp-' || CAST(k AS VARCHAR) AS id, 'c' || CAST(k AS VARCHAR) AS campaign_name, '' AS ad_group_name,
                '' AS keyword FROM ks WHERE k % 10 <> 0),
grp AS (SELECT 'grp-' || CAST(ks.k AS VARCHAR) AS id, COALESCE(camp.campaign_name, '') AS campaign_name,
               'g' || CAST(ks.k AS VARCHAR) AS ad_group_name, '' AS keyword
        FROM ks LEFT JOIN camp ON camp.id = 'cmp-' || CAST(ks.k AS VARCHAR) WHERE ks.k % 3 = 0),
kw AS (SELECT 'kw-' || CAST(ks.k AS VARCHAR) AS id, COALESCE(grp.campaign_name, '') AS campaign_name,
              COALESCE(grp.ad_group_name, '') AS ad_group_name, 'kw' || CAST(ks.k AS VARCHAR) AS keyword
       FROM ks LEFT JOIN grp ON grp.id = 'grp-' || CAST(ks.k AS VARCHAR) WHERE ks.k % 2 = 0),
lk AS (SELECT * FROM camp UNION ALL SELECT * FROM grp UNION ALL SELECT * FROM kw)"""

SHRED = f"""WITH {EV},
{LOOKUP},
docs AS (SELECT doc_id, MIN(day) AS since FROM ev GROUP BY doc_id),
live AS (SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY event_id) AS INTEGER) AS row_no,
                CASE WHEN doc_id % 4 = 1 THEN day ELSE day END AS date, sid, impressions, clicks, cost, conversions,
                revenue FROM ev WHERE doc_id % 4 <> 3),
zid AS (SELECT doc_id, sid, MIN(event_id) AS first_ev FROM ev WHERE doc_id % 4 = 3 GROUP BY doc_id, sid),
zero AS (SELECT z.doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY z.doc_id ORDER BY first_ev) AS INTEGER) AS row_no,
                d.since AS date, z.sid, CAST(0 AS DOUBLE) AS impressions, CAST(0 AS DOUBLE) AS clicks,
                CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS conversions, CAST(0 AS DOUBLE) AS revenue
         FROM zid z JOIN docs d USING (doc_id)),
r AS (SELECT * FROM live UNION ALL SELECT * FROM zero)
SELECT r.doc_id, r.row_no, r.date, 'adv' || CAST(r.doc_id % 3 AS VARCHAR) AS advertiser, '네이버 검색광고' AS media,
       COALESCE(NULLIF(lk.campaign_name, ''), r.sid) AS campaign, COALESCE(lk.ad_group_name, '') AS ad_group,
       COALESCE(lk.keyword, '') AS keyword, '' AS product_name, impressions, clicks, cost, conversions, revenue,
       COALESCE(revenue / NULLIF(cost, 0), 0) AS roas, COALESCE(cost / NULLIF(clicks, 0), 0) AS cpc,
       COALESCE(clicks / NULLIF(impressions, 0), 0) AS ctr, conversions AS orders
FROM r LEFT JOIN lk ON lk.id = r.sid"""


def json_oracles() -> dict:
    shred = f"WITH s AS ({SHRED})"
    return {
        "json_shred": SHRED,
        "standard_csv": f"{shred}\nSELECT {', '.join(js.STANDARD_COLUMNS)} FROM s",
        "json_zero_fallback": f"{shred}\nSELECT doc_id, COUNT(*) AS rows, MIN(date) AS first_date, "
                              "bool_and(impressions + clicks + cost + conversions + revenue = 0) AS all_zero "
                              "FROM s GROUP BY doc_id",
        "positional_ids": f"{shred}\nSELECT doc_id, row_no, campaign, ad_group, keyword FROM s",
        "id_name_join": f"WITH {LOOKUP}\nSELECT * FROM lk",
        "json_collected_summary": f"""{shred},
a AS (SELECT advertiser, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(cost) AS cost,
             SUM(conversions) AS conversions, SUM(revenue) AS revenue, SUM(roas) AS roas, SUM(cpc) AS cpc,
             SUM(ctr) AS ctr, bool_and(conversions = 0) AS zc, bool_and(revenue = 0) AS zr, bool_and(roas = 0) AS zo
      FROM s GROUP BY advertiser)
SELECT advertiser, round(impressions, 4) AS impressions, round(clicks, 4) AS clicks, round(cost, 4) AS cost,
       round(conversions, 4) AS conversions, round(revenue, 4) AS revenue, round(roas, 4) AS roas,
       round(cpc, 4) AS cpc, round(ctr, 4) AS ctr,
       (impressions <= 0 AND clicks <= 0 AND cost <= 0 AND conversions <= 0 AND revenue <= 0) AS all_zero,
       list_concat(list_concat(CASE WHEN zc THEN ['conversions'] ELSE CAST([] AS VARCHAR[]) END,
                               CASE WHEN zr THEN ['revenue'] ELSE CAST([] AS VARCHAR[]) END),
                   CASE WHEN zo THEN ['roas'] ELSE CAST([] AS VARCHAR[]) END) AS shortage_metrics FROM a""",
        "json_data_row_count": """WITH d AS (SELECT CAST(floor(event_id / 25) AS BIGINT) AS doc_id, COUNT(*) AS n
                                          FROM events GROUP BY 1)
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN NULL ELSE 0 END AS INTEGER) AS data_rows
FROM d""",
        "anonymised_ids": "SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS account_hash "
                          "FROM customer",
    }
