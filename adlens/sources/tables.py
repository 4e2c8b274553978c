"""Readers for the driver's star-schema tables and the ad-report views built on them.

Each view is a lazy DataFrame: Catalyst prunes unread columns down to the Parquet
scan and pushes filters into it. Joins carry no broadcast hint; the planner
broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles (AQE can still
switch to a broadcast or split skewed partitions at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.constants import UNCLASSIFIED

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


_HANDLES: dict[tuple[int, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy handle on one table (kept per session, like a catalog entry; no data is cached)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), spark.sparkContext.applicationId, path)
    if key in _HANDLES:
        return _HANDLES[key]
    _HANDLES[key] = spark.read.parquet(path)
    return _HANDLES[key]


def _brand_no(brand_col: str = "p_brand"):
    return F.regexp_extract(F.col(brand_col), r"([0-9]+)$", 1).cast("int")


def ad_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ad fact over lineitem ⋈ part ⋈ supplier.

    date=ship date, platform=part type, account=supplier, campaign=brand,
    ad group=brand/type, keyword=part name, product='P'+partkey. Measures are exact
    (BIGINT counts, DECIMAL(18,2) money) so sums are order-independent.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    b = _brand_no()
    return j.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("date"),
        F.col("p_type").alias("platform"),
        F.col("s_name").alias("account_name"),
        F.col("p_brand").alias("campaign_name"),
        F.concat_ws("/", "p_brand", "p_type").alias("ad_group_name"),
        F.col("p_name").alias("keyword"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_name"),
        (F.col("l_quantity").cast("bigint") * 100 * F.when(b % 10 == 4, 3).otherwise(1)).cast("bigint").alias("impressions"),
        (F.col("l_linenumber") + F.round(F.col("l_discount") * 100).cast("bigint")).cast("bigint").alias("clicks"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        F.when((b % 8 == 0) | (F.col("l_returnflag") == "R"), 0).otherwise(F.col("l_linenumber")).cast("bigint")
        .alias("conversions"),
        (F.col("l_extendedprice") * F.round(F.col("l_tax") * 100)).cast("decimal(18,2)").alias("revenue"),
        F.col("l_linenumber").cast("bigint").alias("orders"),
    )


def unconverted_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad fact by year without a conversion; impressions and click-through rate grow with the brand's number.

    Many campaigns share a year's cost about equally and the large ones have the best rates, so no rule fires.
    """
    f = ad_fact(spark, sf_dir)
    kinds = dict(f.dtypes)
    brand = F.regexp_extract("campaign_name", "([0-9]+)$", 1).cast("bigint")
    shown = F.floor(F.col("impressions") / 100).cast("bigint")
    changed = {"account_name": F.year("date").cast("string"), "impressions": shown * 100 * brand, "clicks": shown * brand * brand,
               "conversions": F.lit(0).cast(kinds["conversions"]), "revenue": F.lit(0).cast(kinds["revenue"])}
    return f.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in f.columns])


def monthly_account_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad fact with one account per supplier and month: small scopes that reach every fallback rule.

    January and March have no performance at all (March on search-ads media), February no conversions.
    """
    f = ad_fact(spark, sf_dir)
    month, zero = F.month("date"), F.lit(0)
    quiet = lambda m, months: F.when(month.isin(*months), zero.cast(dict(f.dtypes)[m])).otherwise(F.col(m)).alias(m)
    return f.select(
        "date", F.when(month == 3, F.concat(F.lit("네이버 "), "platform")).otherwise(F.col("platform")).alias("platform"),
        F.concat("account_name", F.date_format("date", "/yyyy-MM")).alias("account_name"), "campaign_name", "ad_group_name",
        "keyword", "product_name", quiet("impressions", (1, 3)), quiet("clicks", (1, 3)), quiet("cost", (1, 3)),
        quiet("conversions", (1, 2, 3)), quiet("revenue", (1, 2, 3)), "orders")


def event_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad fact over the click-stream ``events`` table (100 campaigns, 5 accounts)."""
    return event_fact_from(read_table(spark, sf_dir, "events"))


def event_fact_from(events: DataFrame) -> DataFrame:
    """:func:`event_fact` over any (batch or streaming) ``events`` DataFrame."""
    ev = events.select("ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    money = F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    return ev.select(
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.when(F.col("user_id") % 2 == 0, "app").otherwise("web").alias("platform"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("account_name"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k")).alias("campaign_name"),
        F.lit(UNCLASSIFIED).alias("ad_group_name"),
        et.alias("keyword"),
        F.lit(UNCLASSIFIED).alias("product_name"),
        F.when(et == "view", 1).otherwise(0).cast("bigint").alias("impressions"),
        F.when(et == "click", 1).otherwise(0).cast("bigint").alias("clicks"),
        F.when(et == "click", money).otherwise(zero).alias("cost"),
        F.when(et == "purchase", 1).otherwise(0).cast("bigint").alias("conversions"),
        F.when(et == "purchase", money).otherwise(zero).alias("revenue"),
        F.when(et == "purchase", 1).otherwise(0).cast("bigint").alias("orders"),
    )


def collection_log_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection-attempt log over ``events`` with timestamps stored as text.

    Even event ids carry an explicit ``+00:00`` offset (converted to Korean wall
    time on read); odd ones are naive wall-clock text, kept as is.
    """
    return collection_log_from(read_table(spark, sf_dir, "events"))


def collection_log_from(events: DataFrame) -> DataFrame:
    """:func:`collection_log_raw` over any (batch or streaming) ``events`` DataFrame."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    status =(F.when(et == "error", "failed").when(et == "signup", "no_data").when(et == "view", "partial")
              .otherwise("success"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    suffix = F.when(F.col("event_id") % 2 == 0, F.lit("+00:00")).otherwise(F.lit(""))
    return ev.select(
        F.col("event_id").cast("string").alias("collection_id"),
        F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("advertiser_id"),
        # Mixed case and padding exercise the media-key normalisation.
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit(" M"), (F.col("user_id") % 5).cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"))).alias("media"),
        F.concat(F.date_format(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), fmt), suffix).alias("started_at"),
        F.concat(F.date_format("ts", fmt), suffix).alias("finished_at"),
        status.alias("status"),
        F.floor("value").cast("bigint").alias("rows_collected"),
        F.lit(1).cast("bigint").alias("file_count"),
        (F.col("value") / 100).alias("storage_used_mb"),
        F.when(et == "error", F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string"))).otherwise(F.lit(""))
        .alias("error_code"),
        F.when(et == "error", F.lit("collector timeout")).when(et == "signup", F.lit("")).otherwise(F.lit(""))
        .alias("error_message"),
    )


def channel_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel registry over ``nation``: one channel per nation, two media-key aliases each.

    Every fourth channel still needs a connection; the first alias wins when both
    have log rows, and channels whose aliases have no log keep their defaults.
    """
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    return n.select(
        F.col("n_name").alias("channel"), k.alias("display_order"),
        F.when(k % 4 == 3, F.lit("needs_connection")).otherwise(F.lit("entry_done")).alias("connection"),
        F.array(F.concat(F.lit("m"), (k % 7).cast("string")), F.concat(F.lit("m"), (k % 9).cast("string")))
        .alias("media_keys"))


def step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection step results over ``events``: media = user bucket, step = event type.

    error -> failed (detail = error code), signup -> blocked, everything else succeeds.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    et = F.col("event_type")
    return ev.select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("media"),
        F.col("event_id").alias("seq"), et.alias("step"),
        F.when(et == "error", "failed").when(et == "signup", "blocked").otherwise("success").alias("status"),
        F.when(et == "error", F.concat(F.lit("error E"), (F.col("user_id") % 4).cast("string")))
        .when(et == "signup", F.concat(F.lit("login required for u"), (F.col("user_id") % 3).cast("string")))
        .otherwise(F.concat(F.lit("ok "), et)).alias("detail"))


INVENTORY_CLOCK = "2024-06-30 12:00:00"
INVENTORY_FOLDERS = ["raw", "processed", "reports", "logs", "screenshots", "downloads", "other"]
INVENTORY_SUFFIXES = [".csv", ".xlsx", ".json", ".txt", ".png"]
DOWNLOAD_NAMES = ["report_{}.csv", "report_{}.xlsx", "REPORT_{}.XLSX", "report_{}.xlsx.crdownload", "demo_{}.csv",
                  "report_{}.tmp", "notes_{}.txt", "report_{}.xls"]


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata (path, length, modificationTime) for one stored file per document.

    Folder by doc id % 7, suffix by doc id % 5, size from the text length, age up to
    ~500 days before the inventory clock; the ``downloads`` folder holds finished,
    partial, demo and empty report downloads.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    i = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in INVENTORY_FOLDERS]), (i % 7 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in INVENTORY_SUFFIXES]), (i % 5 + 1).cast("int"))
    dl_name = F.element_at(F.array(*[F.lit(x) for x in DOWNLOAD_NAMES]), (i % 8 + 1).cast("int"))
    dl_name = F.replace(dl_name, F.lit("{}"), i.cast("string"))
    path = F.when(folder == "downloads", F.concat(F.lit("downloads/"), dl_name)).otherwise(
        F.concat(F.lit("data/"), folder, F.lit("/"), F.col("source"), F.lit("/doc_"), i.cast("string"), suffix))
    length = F.when((folder == "downloads") & (i % 13 == 0), F.lit(0)).otherwise(F.col("n_chars") * 4)
    mtime = (F.lit(INVENTORY_CLOCK).cast("timestamp_ntz") - F.make_interval(days=((i * 37) % 500).cast("int"))
             - F.make_interval(hours=(i % 24).cast("int")))
    return d.select(path.alias("path"), length.cast("bigint").alias("length"),
                    mtime.cast("timestamp_ntz").alias("modificationTime"))


STATS_DOC_SIZE = 25  # events per stats document (an API response page)


def _stat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k")
    et = F.col("event_type")
    return ev.select(
        "event_id", (F.col("event_id") / STATS_DOC_SIZE).cast("bigint").alias("doc_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("cmp-"), k))
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit("grp-"), k)).otherwise(F.concat(F.lit("kw-"), k)).alias("sid"),
        F.when(et == "view", 1).otherwise(0).alias("impCnt"),
        F.when(et == "click", 1).otherwise(0).alias("clkCnt"),
        F.when(et == "click", F.col("value")).otherwise(0.0).alias("salesAmt"),
        F.when(et == "purchase", 1).otherwise(0).alias("ccnt"),
        F.when(et == "purchase", F.col("value")).otherwise(0.0).alias("convAmt"))


def stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-ads stats API responses built from ``events``, 25 events per document.

    Four envelopes by ``doc_id % 4``: 0 ``{"response":{"data":[{id,date,fields{}}]}}`` with one to
    eight ``response`` levels;
    1 ``{"data":[{statDt,data{}}]}`` without ids (request ids attach by position);
    2 ``[{"rows":[{id,period,metrics...}]}]`` with comma-formatted money text, every other one in
    further lists;
    3 ``{"response":{"data":[]}}`` (empty: zero rows per requested id).
    """
    e = _stat_events(spark, sf_dir)
    shape = F.col("doc_id") % 4
    metrics = F.struct("impCnt", "clkCnt", "salesAmt", "ccnt", "convAmt")
    row = (F.when(shape == 0, F.to_json(F.struct(F.col("sid").alias("id"), F.col("day").alias("date"),
                                                   metrics.alias("fields"))))
           .when(shape == 1, F.to_json(F.struct(F.col("day").alias("statDt"), metrics.alias("data"))))
           .when(shape == 2, F.to_json(F.struct(F.col("sid").alias("id"), F.col("day").alias("period"), "impCnt",
                                                "clkCnt", F.format_number("salesAmt", 2).alias("salesAmt"), "ccnt",
                                                F.format_number("convAmt", 2).alias("convAmt")))))
    per_doc = e.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", row.alias("j"), "sid"))).alias("items"),
        F.min("day").alias("since"), F.max("day").alias("until"))
    body = F.array_join(F.transform("items", lambda s: s["j"]), ",")
    shp = F.col("doc_id") % 4
    deep = (F.col("doc_id") / 4).cast("int") % 8  # further envelope levels
    nested = F.col("doc_id") % 8 >= 4             # lists inside lists
    payload = (F.when(shp == 0, F.concat(F.repeat(F.lit('{"response":'), deep + 1), F.lit('{"data":['), body, F.lit("]}"),
                                         F.repeat(F.lit("}"), deep + 1)))
               .when((shp == 2) & nested, F.concat(F.lit('[[],[{"rows":[['), body, F.lit("]]}]]")))
               .when(shp == 1, F.concat(F.lit('{"data":['), body, F.lit("]}")))
               .when(shp == 2, F.concat(F.lit('[{"rows":['), body, F.lit("]}]")))
               .otherwise(F.lit('{"response":{"data":[]}}')))
    ids = F.transform("items", lambda s: s["sid"])
    req_ids = F.when(shp == 3, F.array_distinct(ids)).otherwise(ids)
    request = F.to_json(F.struct(req_ids.alias("ids"),
                                 F.to_json(F.struct(F.col("since"), F.col("until"))).alias("timeRange")))
    return per_doc.select("doc_id", F.concat(F.lit("adv"), (F.col("doc_id") % 3).cast("string")).alias("advertiser"),
                          payload.alias("payload"), request.alias("request"))


def stats_dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Campaign, ad-group and keyword lists for the campaigns seen in ``events``."""
    ks = (read_table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"))
          .distinct())
    ks_s = F.col("k").cast("string")
    camps = ks.where(F.col("k") % 10 != 0).select(F.concat(F.lit("cmp-"), ks_s).alias("nccCampaignId"),
                                                  F.concat(F.lit("c"), ks_s).alias("name"))
    groups = ks.where(F.col("k") % 3 == 0).select(F.concat(F.lit("grp-"), ks_s).alias("nccAdgroupId"),
                                                  F.concat(F.lit("cmp-"), ks_s).alias("nccCampaignId"),
                                                  F.concat(F.lit("g"), ks_s).alias("name"))
    kws = ks.where(F.col("k") % 2 == 0).select(F.concat(F.lit("kw-"), ks_s).alias("nccKeywordId"),
                                               F.concat(F.lit("grp-"), ks_s).alias("nccAdgroupId"),
                                               F.concat(F.lit("kw"), ks_s).alias("keyword"))
    return camps, groups, kws


# Region -> channel group used by the channel benchmark view (ours; unmatched groups fall back to the default).
REGION_CHANNEL_GROUP = {"AFRICA": "광고매체", "AMERICA": "오픈마켓", "ASIA": "커머스 플랫폼", "EUROPE": "글로벌 채널"}


def channel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales-channel metrics: one row per nation (channel) inside its region (group).

    revenue = Σ order totals, ad_cost = 18 % of revenue on urgent/high orders and 9 %
    otherwise, orders = #orders, conversions = #finished orders, new_customers =
    #distinct customers, repeat_purchase_rate = share of customers with > 1 order.
    """
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    group_map = F.create_map(*[x for kv in REGION_CHANNEL_GROUP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    price = F.col("o_totalprice").cast("decimal(18,2)")
    share = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(0.18).cast("decimal(3,2)")) \
        .otherwise(F.lit(0.09).cast("decimal(3,2)"))
    per_customer = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                    .groupBy("c_nationkey", "o_custkey")
                    .agg(F.sum(price).alias("revenue"),
                         F.sum(price * share).alias("ad_cost"),
                         F.count(F.lit(1)).alias("orders"),
                         F.count_if(F.col("o_orderstatus") == "F").alias("conversions")))
    per_nation = (per_customer.groupBy("c_nationkey")
                  .agg(F.sum("revenue").alias("revenue"), F.sum("ad_cost").alias("ad_cost"),
                       F.sum("orders").alias("orders"), F.sum("conversions").alias("conversions"),
                       F.count(F.lit(1)).alias("new_customers"),
                       F.count_if(F.col("orders") > 1).alias("repeat_customers")))
    j = per_nation.join(nation, per_nation.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey)
    return j.select(
        F.col("n_name").alias("channel_name"),
        F.coalesce(group_map[F.col("r_name")], F.col("r_name")).alias("channel_group"),
        # Money stays DECIMAL so sums over channels are exact and order-independent.
        F.col("revenue").cast("decimal(38,2)").alias("revenue"),
        F.col("ad_cost").cast("decimal(38,4)").alias("ad_cost"),
        F.col("orders").cast("bigint").alias("orders"),
        F.col("conversions").cast("bigint").alias("conversions"),
        F.col("new_customers").cast("bigint").alias("new_customers"),
        (F.col("repeat_customers") / F.col("new_customers")).alias("repeat_purchase_rate"),
        F.coalesce(F.try_divide(F.col("revenue").cast("double"), F.col("ad_cost").cast("double")), F.lit(0.0))
        .alias("roas"),
    )


# Header layout of the raw text report view: Korean and English aliases, one fuzzy
# header ('clickz', 'revenues') each, and a second platform header ('media') that
# loses to the first and passes through as an extra column.
RAW_REPORT_HEADERS = ["일자", "광고매체", "Account Name", "Campaign-Name", "광고그룹명", "검색어", "상품명", "노출수(회)",
                      "clickz", "광고비(원)", "전환수", "revenues", "주문수", "media", "memo"]


def raw_ad_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad fact rendered as a messy all-text media report.

    Dates in three layouts, thousands separators, a '원' suffix, '-' for zero,
    padded numbers, 'NA' and blank dimension cells. Standardising it must give
    back the ad fact (with 'NA'/blank dimensions as 'unclassified').
    """
    f = ad_fact(spark, sf_dir).withColumn("_o", F.col("orders"))
    d = F.col("date")
    date_txt = (F.when(F.col("_o") % 3 == 0, F.date_format(d, "yyyy/M/d"))
                .when(F.col("_o") % 3 == 1, F.date_format(d, "yyyy.MM.dd"))
                .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return f.select(
        date_txt.alias("일자"),
        F.when(F.col("_o") == 7, F.lit("NA")).otherwise(F.col("platform")).alias("광고매체"),
        F.col("account_name").alias("Account Name"),
        F.col("campaign_name").alias("Campaign-Name"),
        F.col("ad_group_name").alias("광고그룹명"),
        F.when(F.col("_o") == 6, F.lit("  ")).otherwise(F.col("keyword")).alias("검색어"),
        F.col("product_name").alias("상품명"),
        F.format_number(F.col("impressions").cast("double"), 0).alias("노출수(회)"),
        F.col("clicks").cast("string").alias("clickz"),
        F.concat(F.format_number(F.col("cost"), 2), F.lit("원")).alias("광고비(원)"),
        F.when(F.col("conversions") == 0, F.lit("-")).otherwise(F.col("conversions").cast("string")).alias("전환수"),
        F.col("revenue").cast("string").alias("revenues"),
        F.concat(F.lit(" "), F.col("orders").cast("string"), F.lit(" ")).alias("주문수"),
        F.lit("dup").alias("media"),
        F.concat(F.lit("row "), F.col("orders").cast("string")).alias("memo"),
    )
