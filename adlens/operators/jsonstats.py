"""Shredding search-ads stats JSON payloads into standard ad rows.

A payload document (one API response) is read by one Arrow function that walks the
parsed value to any depth and returns the stat records in document order, each a
``MAP<STRING,STRING>`` of its scalar values (numbers keep their text):

* a list yields the records of its items, however lists are nested;
* an object's ``response`` object is walked first, then the object itself;
* an object with a ``fields`` (or ``data``) object is one record: its own keys
  overlaid by the inner object's keys;
* an object with lists under ``data/rows/items/result/results`` yields their records;
* otherwise the object is a record when it carries an id or a core metric key.

Everything after that is ``posexplode`` and column expressions on the same row: the
position in the array is the record's number, so no document is joined back, windowed
or scanned again. Payloads that are not JSON raise; they never turn into zero rows.
"""

from __future__ import annotations

import json
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlens.constants import (SEARCH_ADS_MEDIA_NAME, STAT_DATE_KEYS, STAT_ID_KEYS, STAT_LIST_KEYS,
                              STAT_METRIC_KEYS, STAT_ROW_MARKERS)

MAP_T = "map<string,string>"
ARR_T = "array<string>"
STANDARD_COLUMNS = ["date", "advertiser", "media", "campaign", "ad_group", "keyword", "product_name", "impressions",
                    "clicks", "cost", "conversions", "revenue", "roas", "cpc", "ctr", "orders"]


def _is_obj(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _is_list(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def _parsed(text: str | None):
    """The value of a payload, numbers as their text; None for a null or blank one."""
    if text is None or not text.strip():
        return None
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=str)


def _scalars(own: dict, inner: dict | None = None) -> list[tuple[str, str | None]]:
    """Scalar entries as text. Whatever the inner object has for a key replaces the outer value; objects and lists count as null."""
    flat = {}
    for key, value in {**own, **(inner or {})}.items():
        if isinstance(value, (dict, list)):
            if inner and key in inner and key in own:
                flat[key] = None
            continue
        flat[key] = str(value).lower() if isinstance(value, bool) else value
    return list(flat.items())


def stat_records(value) -> list[list[tuple[str, str | None]]]:
    """The stat records of a parsed payload in document order."""
    records, todo = [], [value]  # a stack: what comes first in the document is on top
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # a record that had to wait for its object's response
            records.append(_scalars(*node))
        elif isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            inner = next((node[k] for k in ("fields", "data") if isinstance(node.get(k), dict)), None)
            lists = [node[k] for k in STAT_LIST_KEYS if isinstance(node.get(k), list)]
            if inner is not None:
                todo.append((node, inner))
            elif lists:
                todo.extend(reversed(lists))
            elif any(k in node for k in STAT_ROW_MARKERS):
                todo.append((node,))
            if isinstance(node.get("response"), dict):
                todo.append(node["response"])
    return records


def listed_values(value, key: str) -> list[str]:
    """Non-empty values of ``key`` in the objects of every list that is reached through objects alone."""
    found, todo = [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            todo.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            found += [str(x[key]) for x in node if isinstance(x, dict) and x.get(key)]
    return found


def records_of(payload: Column) -> Column:
    """The stat records of each payload, as an array of maps."""
    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([stat_records(_parsed(t)) for t in texts.to_pylist()], pa.list_(pa.map_(pa.string(), pa.string())))

    return F.arrow_udf(walk, "array<map<string,string>>")(payload)


def extract_stat_rows(docs: DataFrame, doc_key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """One row per stat record: doc key, ``row_no`` (document order), ``doc_rows`` and the ``fields`` map."""
    return (docs.select(doc_key, records_of(F.col(payload)).alias("_records"))
            .select(doc_key, F.size("_records").alias("doc_rows"), F.posexplode("_records").alias("_at", "fields"))
            .select(doc_key, (F.col("_at") + 1).alias("row_no"), "doc_rows", "fields"))


def field(key: str) -> Column:
    """Value of ``key`` in a record."""
    return F.col("fields")[key]


def present(key: str) -> Column:
    return F.map_contains_key(F.col("fields"), F.lit(key))


def numeric_value(*keys: str) -> Column:
    """First key present, non-empty and numeric (commas removed); else 0."""
    tries = [F.when(present(k) & (field(k) != ""), F.regexp_replace(F.trim(field(k)), ",", "").try_cast("double"))
             for k in keys]
    return F.coalesce(*tries, F.lit(0.0))


def _first_nonempty(keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(field(k), F.lit("")) for k in keys])


def id_lookup(campaigns: DataFrame, adgroups: DataFrame, keywords: DataFrame) -> DataFrame:
    """id -> (campaign_name, ad_group_name, keyword) over the three dimension lists.

    Campaign ids map to their name; ad-group ids inherit their campaign's name;
    keyword ids inherit their ad group's names. For an id present in several lists
    the later list wins (campaigns < ad groups < keywords).
    """
    camp = campaigns.where(F.coalesce(F.col("nccCampaignId"), F.lit("")) != "").select(
        F.col("nccCampaignId").alias("id"), F.coalesce("name", F.lit("")).alias("campaign_name"),
        F.lit("").alias("ad_group_name"), F.lit("").alias("keyword"), F.lit(0).alias("prio"))
    cnames = camp.select(F.col("id").alias("nccCampaignId"), F.col("campaign_name").alias("_cn"))
    grp = adgroups.where(F.coalesce(F.col("nccAdgroupId"), F.lit("")) != "").join(cnames, "nccCampaignId", "left")
    grp = grp.select(F.col("nccAdgroupId").alias("id"), F.coalesce("_cn", F.lit("")).alias("campaign_name"),
                     F.coalesce("name", F.lit("")).alias("ad_group_name"), F.lit("").alias("keyword"),
                     F.lit(1).alias("prio"))
    gnames = grp.select(F.col("id").alias("nccAdgroupId"), F.col("campaign_name").alias("_cn"),
                        F.col("ad_group_name").alias("_gn"))
    kw = keywords.where(F.coalesce(F.col("nccKeywordId"), F.lit("")) != "").join(gnames, "nccAdgroupId", "left")
    kw = kw.select(F.col("nccKeywordId").alias("id"), F.coalesce("_cn", F.lit("")).alias("campaign_name"),
                   F.coalesce("_gn", F.lit("")).alias("ad_group_name"), F.coalesce("keyword", F.lit("")).alias("keyword"),
                   F.lit(2).alias("prio"))
    allv = camp.unionByName(grp).unionByName(kw)
    best = F.max_by(F.struct("campaign_name", "ad_group_name", "keyword"), F.col("prio"))
    return allv.groupBy("id").agg(best.alias("n")).select("id", "n.*")


def request_fields(docs: DataFrame, request: str = "request") -> DataFrame:
    """ids (ARRAY<STRING>) and since date of each document's stats request."""
    r = F.from_json(F.col(request), MAP_T)
    ids_txt = r["ids"]
    ids = F.when(_is_list(ids_txt), F.from_json(ids_txt, ARR_T)) \
        .when(F.coalesce(ids_txt, F.lit("")) != "", F.array(ids_txt)).otherwise(F.array().cast(ARR_T))
    ids = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    tr = r["timeRange"]
    since = F.coalesce(F.when(_is_obj(tr), F.from_json(tr, MAP_T)["since"]), F.lit(""))
    return docs.select("*", ids.alias("req_ids"), since.alias("req_since"))


def shred_stats(docs: DataFrame, lookup: DataFrame | None = None, advertiser: str | Column = "advertiser",
                doc_key: str = "doc_id") -> DataFrame:
    """Stats documents -> standard ad rows (16 columns, plus ``doc_id`` and ``row_no``).

    Documents without any stat row fall back to one all-zero row per requested id.
    """
    adv = F.col(advertiser) if isinstance(advertiser, str) and advertiser in docs.columns else \
        (advertiser if isinstance(advertiser, Column) else F.lit(advertiser))
    d = request_fields(docs).select(doc_key, "req_ids", "req_since", adv.alias("_adv"),
                                    records_of(F.col("payload")).alias("_records"))
    empty = F.transform("req_ids", lambda i: F.create_map(F.lit("id"), i))
    d = d.select(doc_key, "req_ids", "req_since", "_adv", F.size("_records").alias("doc_rows"), F.posexplode(
        F.when(F.size("_records") > 0, F.col("_records")).otherwise(empty)).alias("_at", "fields"))
    rows = d.withColumn("row_no", F.col("_at") + 1)
    own_id = _first_nonempty(STAT_ID_KEYS)
    n_ids = F.size("req_ids")
    attached = (F.when(own_id.isNotNull(), own_id)
                .when(F.col("doc_rows") == n_ids, F.element_at("req_ids", F.col("row_no")))
                .when(n_ids == 1, F.element_at("req_ids", 1)))
    allrows = rows.select(
        doc_key, "row_no", "_adv",
        F.coalesce(attached, F.lit("")).alias("row_id"),
        F.coalesce(_first_nonempty(STAT_DATE_KEYS), F.col("req_since")).alias("date"),
        *[numeric_value(*keys).alias(f"_{m}") for m, keys in STAT_METRIC_KEYS.items()])
    if lookup is not None:
        allrows = allrows.join(lookup.withColumnRenamed("id", "row_id"), "row_id", "left")
    else:
        allrows = allrows.withColumns({"campaign_name": F.lit(None).cast("string"),
                                       "ad_group_name": F.lit(None).cast("string"),
                                       "keyword": F.lit(None).cast("string")})
    c = F.col
    ratio = lambda v, a, b: F.when(c(v) != 0, c(v)).otherwise(
        F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0)))
    return allrows.select(
        doc_key, "row_no", "date", c("_adv").alias("advertiser"), F.lit(SEARCH_ADS_MEDIA_NAME).alias("media"),
        F.coalesce(F.nullif(c("campaign_name"), F.lit("")), c("row_id")).alias("campaign"),
        F.coalesce(c("ad_group_name"), F.lit("")).alias("ad_group"),
        F.coalesce(c("keyword"), F.lit("")).alias("keyword"),
        F.lit("").alias("product_name"),
        c("_impressions").alias("impressions"), c("_clicks").alias("clicks"), c("_cost").alias("cost"),
        c("_conversions").alias("conversions"), c("_revenue").alias("revenue"),
        ratio("_roas", "_revenue", "_cost").alias("roas"), ratio("_cpc", "_cost", "_clicks").alias("cpc"),
        ratio("_ctr", "_clicks", "_impressions").alias("ctr"),
        c("_conversions").alias("orders"))


def collected_summary(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Σ of the 8 collected metrics (ratios summed naively), the all-zero guard and the
    labels of metrics that are 0 in every row (conversions, revenue, roas)."""
    metrics = ["impressions", "clicks", "cost", "conversions", "revenue", "roas", "cpc", "ctr"]
    agg = rows.groupBy(*scope).agg(
        *[F.sum(m).alias(m) for m in metrics],
        *[F.bool_and(F.col(m) == 0).alias(f"_z_{m}") for m in ["conversions", "revenue", "roas"]])
    zero = F.lit(True)
    for m in ["impressions", "clicks", "cost", "conversions", "revenue"]:
        zero = zero & (F.col(m) <= 0)
    labels = F.filter(F.array(*[F.when(F.col(f"_z_{m}"), F.lit(m)) for m in ["conversions", "revenue", "roas"]]),
                      lambda x: x.isNotNull())
    return agg.select(*scope, *metrics, zero.alias("all_zero"), labels.alias("shortage_metrics"))


def data_row_count(payload: Column) -> Column:
    """Length of ``data`` (directly or below any number of ``response`` objects) when it is a list, else null."""
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            node = _parsed(text)
            while isinstance(node, dict) and not isinstance(node.get("data"), list):
                node = node.get("response")
            out.append(len(node["data"]) if isinstance(node, dict) else None)
        return pa.array(out, pa.int32())

    return F.arrow_udf(count, "int")(payload)


def collect_ids(docs: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Distinct non-empty values of ``key`` in the listed objects of raw payloads."""
    def values(texts: pa.Array) -> pa.Array:
        return pa.array([listed_values(_parsed(t), key) for t in texts.to_pylist()], pa.list_(pa.string()))

    found = F.arrow_udf(values, "array<string>")(F.col(payload))
    return docs.select(F.explode(found).alias(key)).distinct()


def read_payloads(spark, root: str, glob: str = "*.json") -> DataFrame:
    """Landed JSON responses, one file each: path and payload."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")))


def write_standard_csv(rows: DataFrame, path: str, partition: Sequence[str] = ("advertiser",)) -> None:
    """Standard 16-column CSV (header row), one folder per advertiser.

    The folder key is a copy, so the files keep all 16 columns.
    """
    out = rows.select(*STANDARD_COLUMNS, *(F.col(c).alias(f"by_{c}") for c in partition))
    w = out.write.mode("overwrite").option("header", True)
    if partition:
        w = w.partitionBy(*(f"by_{c}" for c in partition))
    w.csv(path)


def anonymised_id(c) -> Column:
    """First 12 hex characters of SHA-256 of the id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.sha2(c.cast("string"), 256), 1, 12)
