"""Registered ingest queries (standardisation of text reports) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions.columns import clean_dimension, clean_numeric, parse_date
from adlens.operators import ingest
from adlens.plans import oracle_sql as o
from adlens.sources import tables


def _standardize_text(spark, sf):
    raw = tables.raw_ad_report(spark, sf)
    fact, _ = ingest.standardize_layout(raw, "raw_ad_report")
    return fact


def _dirty_numbers(spark, sf):
    """Line items rendered as messy numeric text, eleven styles by line number / order key."""
    li = tables.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    style = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    raw = (F.when(style == 0, F.concat(F.format_number(price, 2), F.lit("원")))
           .when(style == 1, F.concat(F.lit(" "), price.cast("string"), F.lit(" ")))
           .when(style == 2, F.concat(price.cast("string"), F.lit("%")))
           .when(style == 3, F.lit("abc")).when(style == 4, F.lit("-")).when(style == 5, F.lit(""))
           .when(style == 6, F.lit("NA")).when(style == 7, F.lit("nan")).when(style == 8, F.lit("1d"))
           .when(style == 9, F.lit("1.5f")).otherwise(F.col("l_quantity").cast("bigint").cast("string")))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


def _numeric_clean(spark, sf):
    d = _dirty_numbers(spark, sf)
    return d.select("l_orderkey", "l_linenumber", "raw", clean_numeric("raw").alias("value"))


def _dimension_clean(spark, sf):
    p = tables.read_table(spark, sf, "part").select("p_partkey", "p_name")
    style = F.col("p_partkey") % 7
    raw = (F.when(style == 0, F.lit(None).cast("string")).when(style == 1, F.lit(""))
           .when(style == 2, F.lit("   ")).when(style == 3, F.lit("N/A"))
           .when(style == 4, F.concat(F.lit("  "), F.col("p_name"), F.lit("\t"))).when(style == 6, F.lit("\t"))
           .otherwise(F.col("p_name")))
    return p.select("p_partkey", raw.alias("raw"), clean_dimension(raw).alias("value"))


def _date_parse(spark, sf):
    li = tables.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    d = F.col("l_shipdate")
    style = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    raw = (F.when(style == 0, F.date_format(d, "yyyy-MM-dd")).when(style == 1, F.date_format(d, "yyyy/MM/dd"))
           .when(style == 2, F.date_format(d, "yyyy.M.d")).when(style == 3, F.date_format(d, "yyyyMMdd"))
           .when(style == 4, F.date_format(d, "yyyy년 M월 d일")).when(style == 5, F.date_format(d, "M/d/yyyy"))
           .when(style == 6, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(style == 8, F.date_format(d, "yyyy/MM/dd HH:mm"))
           .when(style == 9, F.date_format(d, "M/d/yyyy H:mm")).when(style == 10, F.date_format(d, "yyyy.MM.dd HH:mm:ss"))
           .otherwise(F.lit("bad")))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"), parse_date(raw).alias("date"))


def ingest_queries() -> dict:
    return {
        "standardize_text": _standardize_text,
        "numeric_clean": _numeric_clean,
        "dimension_clean": _dimension_clean,
        "date_parse": _date_parse,
    }


def ingest_oracles() -> dict:
    std = f"""{o.with_ctes(o.AD_FACT)},
f AS (SELECT date,
        CASE WHEN orders = 7 THEN '미분류' ELSE platform END AS platform, account_name, campaign_name, ad_group_name,
        CASE WHEN orders = 6 THEN '미분류' ELSE keyword END AS keyword, product_name,
        CAST(impressions AS DOUBLE) AS impressions, CAST(clicks AS DOUBLE) AS clicks, CAST(cost AS DOUBLE) AS cost,
        CAST(conversions AS DOUBLE) AS conversions, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS DOUBLE) AS orders,
        'dup' AS media, 'row ' || CAST(orders AS VARCHAR) AS memo FROM ad_fact)
SELECT *, {o.rates()} FROM f"""
    style = "(l_orderkey + l_linenumber) % 11"
    num = f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN {style} = 0 THEN format('{{:,.2f}}', CAST(l_extendedprice AS DECIMAL(18,2))) || '원'
       WHEN {style} = 1 THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' '
       WHEN {style} = 2 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '%'
       WHEN {style} = 3 THEN 'abc' WHEN {style} = 4 THEN '-' WHEN {style} = 5 THEN '' WHEN {style} = 6 THEN 'NA'
       WHEN {style} = 7 THEN 'nan' WHEN {style} = 8 THEN '1d' WHEN {style} = 9 THEN '1.5f'
       ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw,
  CASE WHEN {style} IN (0, 1, 2) THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)
       WHEN {style} = 10 THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) ELSE 0.0 END AS value
FROM lineitem"""
    dim = """SELECT p_partkey,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN 'N/A'
       WHEN 4 THEN '  ' || p_name || chr(9) WHEN 6 THEN chr(9) ELSE p_name END AS raw,
  CASE WHEN p_partkey % 7 IN (0, 1, 2, 3, 6) THEN '미분류' ELSE trim(p_name) END AS value
FROM part"""
    ds = "(l_orderkey + l_linenumber) % 11"
    dates = f"""SELECT l_orderkey, l_linenumber,
  CASE {ds} WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d')
       WHEN 2 THEN CAST(year(l_shipdate) AS VARCHAR) || '.' || CAST(month(l_shipdate) AS VARCHAR) || '.'
                   || CAST(day(l_shipdate) AS VARCHAR)
       WHEN 3 THEN strftime(l_shipdate, '%Y%m%d')
       WHEN 4 THEN CAST(year(l_shipdate) AS VARCHAR) || '년 ' || CAST(month(l_shipdate) AS VARCHAR) || '월 '
                   || CAST(day(l_shipdate) AS VARCHAR) || '일'
       WHEN 5 THEN CAST(month(l_shipdate) AS VARCHAR) || '/' || CAST(day(l_shipdate) AS VARCHAR) || '/'
                   || CAST(year(l_shipdate) AS VARCHAR)
       WHEN 6 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') WHEN 8 THEN strftime(l_shipdate, '%Y/%m/%d %H:%M')
       WHEN 9 THEN CAST(month(l_shipdate) AS VARCHAR) || '/' || CAST(day(l_shipdate) AS VARCHAR) || '/'
                   || CAST(year(l_shipdate) AS VARCHAR) || ' ' || CAST(hour(l_shipdate) AS VARCHAR) || strftime(l_shipdate, ':%M')
       WHEN 10 THEN strftime(l_shipdate, '%Y.%m.%d %H:%M:%S') ELSE 'bad' END AS raw,
  CASE WHEN {ds} = 7 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS date
FROM lineitem"""
    return {"standardize_text": std, "numeric_clean": num, "dimension_clean": dim, "date_parse": dates}
