"""Registered file-audit queries (over the derived report folder) and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adlens.constants import CANONICAL_COLUMNS, MARKETPLACE_MEDIA
from adlens.operators import audit, report
from adlens.operators.ingest import map_headers, missing_canonical
from adlens.plans import oracle_sql as o
from adlens.session import checkpoint_dir, materialize
from adlens.sources.reports import awkward_lines, derived_report_lines, list_files, read_report_lines, write_lines
from adlens.sources.tables import read_table
from adlens.streaming import watch

#: Triggers that the watched folder's files are spread over.
WATCH_TRIGGERS = 3


def _lines(spark, sf):
    return derived_report_lines(spark, sf)


def _unreadable(spark, sf):
    """One file without content per region."""
    r = read_table(spark, sf, "region").select("r_name")
    return r.select(F.concat(F.lit("reports/empty_"), F.lower("r_name"), F.lit(".csv")).alias("file"), F.lit(0).cast("long").alias("line_id"),
                    F.lit(True).alias("is_header"), F.array().cast("array<string>").alias("fields"), F.lit("empty file").alias("problem"))


def _status_columns(df):
    return df.select("file", "row_count", "column_count", "inferred_media", "advertiser",
                     *[F.col("required_status")[k].alias(f"status_{k}") for k in audit.STATUS_ORDER])


def _mapping(spark, sf):
    return map_headers(audit.header_catalog_from_lines(_lines(spark, sf)))


def _profiles(spark, sf):
    """Profile audits of two media, one per nation: what a medium's known layout says before any file arrived."""
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    medium = F.when(F.col("n_nationkey") % 2 == 0, MARKETPLACE_MEDIA[0]).otherwise(MARKETPLACE_MEDIA[1])
    return n.select(F.concat(F.lit("profile/"), "n_name").alias("file"), medium.alias("inferred_media"),
                    F.lit(0).cast("long").alias("row_count"))


def _csv_folder(spark, sf):
    """The derived reports with awkward shapes, written as CSV files and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/adlens-tables/csv-{uuid.uuid4().hex}"
    write_lines(awkward_lines(spark, sf), path)
    lines = materialize(read_report_lines(spark, path), "csv-lines")
    mapping = materialize(map_headers(audit.header_catalog_from_lines(lines)), "csv-mapping")
    fact = materialize(audit.standardize_lines(lines, mapping, keep_extras=True), "csv-fact")
    return _folder_totals(audit.file_audit(lines, with_issues=False, mapping=mapping, fact=fact), fact)


def _folder_totals(audits, fact):
    sums = fact.groupBy("file").agg(F.round(F.sum("cost"), 2).alias("cost"), F.sum("impressions").alias("impressions"),
                                    F.sum(F.size(F.filter(F.map_values("extras"), lambda v: v.isNotNull()))).alias("extra_cells"))
    name = F.regexp_extract("file", "([^/]+)$", 1)
    return audits.join(sums, "file", "left").select(
        name.alias("report"), "load_status", "row_count", "column_count", F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("impressions", F.lit(0.0)).alias("impressions"), F.coalesce("extra_cells", F.lit(0)).alias("extra_cells"))


def _watched_folder(spark, sf):
    """The same folder taken in by the folder watch in several triggers; a second run finds nothing new."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/adlens-tables/watch-{uuid.uuid4().hex}"
    write_lines(awkward_lines(spark, sf), f"{base}/in")
    files = list_files(spark, f"{base}/in", "*.csv").count()
    for _ in range(2):
        watch.watch_report_folder(spark, f"{base}/in", f"{base}/out", checkpoint=f"{base}/checkpoint",
                                  max_files_per_trigger=max(1, -(-files // WATCH_TRIGGERS)), analysis=False)
    return _folder_totals(spark.read.parquet(f"{base}/out/audit"), spark.read.parquet(f"{base}/out/standardized"))


def audit_queries() -> dict:
    return {
        "csv_folder": _csv_folder,
        "watched_folder": _watched_folder,
        "header_mapping": _mapping,
        "missing_canonical": lambda spark, sf: missing_canonical(_mapping(spark, sf)),
        "folder_extras": lambda spark, sf: audit.standardize_lines(_lines(spark, sf), _mapping(spark, sf), keep_extras=True)
        .select("file", "line_id", F.to_json("extras").alias("extras")),
        "file_audit": lambda spark, sf: audit.file_audit(_lines(spark, sf)),
        "file_audit_issues": lambda spark, sf: audit.file_audit(_lines(spark, sf)).select(
            "file", "action_issue_count", F.coalesce(F.array_join("action_issue_preview", " | "), F.lit("")).alias("preview"), "readiness",
            "load_status"),
        "audit_required_status": lambda spark, sf: _status_columns(audit.file_audit(_lines(spark, sf), False)),
        "standardize_folder": lambda spark, sf: (lambda ln: audit.standardize_lines(
            ln, map_headers(audit.header_catalog_from_lines(ln))))(_lines(spark, sf)),
        "alias_candidates": lambda spark, sf: audit.alias_candidates(
            map_headers(audit.header_catalog_from_lines(_lines(spark, sf)))),
        "media_validation": lambda spark, sf: audit.media_validation(
            audit.file_audit(_lines(spark, sf), False), MARKETPLACE_MEDIA),
        "media_validation_profiles": lambda spark, sf: audit.media_validation(
            audit.file_audit(_lines(spark, sf), False), MARKETPLACE_MEDIA, _profiles(spark, sf)),
        "audits_with_profiles": lambda spark, sf: audit.with_profile_audits(
            audit.file_audit(_lines(spark, sf), False).select("file", "inferred_media", "row_count"), _profiles(spark, sf)),
        "audit_report": lambda spark, sf: report.audit_report_lines(audit.file_audit(_lines(spark, sf), False)),
        "audit_report_full": lambda spark, sf: report.audit_report_lines(audit.with_profile_audits(
            audit.file_audit(_lines(spark, sf).unionByName(_unreadable(spark, sf))), _profiles(spark, sf))),
        "audit_profiles": lambda spark, sf: audit.file_audit(_lines(spark, sf), False).select(
            "file", "inferred_media", "report_version", "profile_label"),
    }


FILES = """li AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type, s.s_suppkey, s.s_name, CAST(s.s_suppkey % 4 AS INTEGER) AS lay,
         l.l_orderkey * 8 + l.l_linenumber + 1 AS line_id
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
f AS (SELECT s_suppkey, CAST(s_suppkey % 4 AS INTEGER) AS lay,
             'reports/' || CASE s_suppkey % 4 WHEN 3 THEN 'gmarket_ads_' WHEN 1 THEN 'naver_ads_' ELSE 'media_' END
             || CAST(s_suppkey AS VARCHAR) || '.csv' AS file FROM supplier)"""


def _exact(*pairs):
    return [(h, h.lower().replace("_", " "), c, "exact") for h, c in pairs]


# What the four layouts' headers must map to: (header, normalised, canonical, kind) in order.
_PLAIN = ("account_name", "campaign_name", "ad_group_name", "keyword", "product_name", "impressions", "clicks", "cost",
          "conversions", "revenue", "orders")
HEADER_CASES = [
    _exact(*((c, c) for c in ("date", "platform", *_PLAIN))),
    _exact(*zip(("일자", "광고매체", "계정명", "캠페인명", "광고그룹명", "검색어", "상품명", "노출수", "클릭수", "광고비", "전환수",
                 "매출", "주문수"), ("date", "platform", *_PLAIN)))
    + [("장바구니", "장바구니", None, "unmapped"), ("광고ID", "광고id", None, "unmapped")],
    _exact(("day", "date"), ("media", "platform"), ("advertiser", "account_name"), ("campaign", "campaign_name"),
           ("ad group", "ad_group_name"), ("impr", "impressions")) + [("clickz", "clickz", "clicks", "fuzzy")]
    + _exact(("spend", "cost"), ("conversion", "conversions")) + [("ROAS", "roas", None, "unmapped")]
    + _exact(("order", "orders")),
    _exact(("날짜", "date"), ("매체", "platform"), ("광고주", "account_name"), ("캠페인", "campaign_name"),
           ("그룹", "ad_group_name"), ("키워드", "keyword"), ("노출", "impressions"), ("클릭", "clicks"), ("비용", "cost"),
           ("전환", "conversions"), ("매출액", "revenue")) + [("클릭률", "클릭률", None, "unmapped")],
]


def audit_oracles() -> dict:
    ok = "'ok'"
    unk = "'cannot_judge'"
    fail = "'mapping_failed'"

    def num(sum_col):
        return f"CASE WHEN COALESCE({sum_col}, 0) = 0 THEN {unk} ELSE {ok} END"

    status = f"""
  CASE WHEN COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_date,
  CASE WHEN COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_account_name,
  CASE WHEN lay = 3 OR COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_platform,
  CASE WHEN COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_campaign_name,
  CASE WHEN COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_ad_group_name,
  CASE WHEN lay = 2 THEN {fail} WHEN COALESCE(row_count, 0) = 0 THEN {unk} ELSE {ok} END AS status_product_or_keyword,
  {num('si')} AS status_impressions, {num('sc')} AS status_clicks, {num('scost')} AS status_cost,
  CASE WHEN lay = 3 THEN {unk} ELSE {num('sconv')} END AS status_conversions,
  CASE WHEN lay = 2 THEN {fail} ELSE {num('srev')} END AS status_revenue,
  CASE WHEN lay = 1 AND COALESCE(scart, 0) > 0 THEN {ok} ELSE {unk} END AS status_cart_count,
  {num('scost')} AS status_roas, {num('sc')} AS status_cpc, {num('si')} AS status_ctr, {num('sc')} AS status_cvr"""
    name_media = ("CASE WHEN f.file LIKE '%naver%' THEN '네이버' WHEN f.file LIKE '%gmarket%' THEN 'G마켓' "
                  "WHEN f.file LIKE '%11%' THEN '11번가' ELSE '매체 미분류' END")
    required = f"""WITH {FILES},
a AS (SELECT s_suppkey, COUNT(*) AS row_count, SUM(CAST(l_quantity AS BIGINT) * 100) AS si,
             SUM(l_linenumber + CAST(round(l_discount * 100) AS BIGINT)) AS sc,
             SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS scost, SUM(l_linenumber) AS sconv,
             SUM(CAST(l_extendedprice * round(l_tax * 100) AS DECIMAL(18,2))) AS srev, SUM(l_linenumber % 3) AS scart,
             arg_min(p_type, (line_id, p_type)) AS first_type, arg_min(s_name, (line_id, s_name)) AS first_name
      FROM li GROUP BY s_suppkey)
SELECT f.file, CAST(COALESCE(row_count, 0) AS BIGINT) AS row_count,
  CAST(CASE lay WHEN 0 THEN 13 WHEN 1 THEN 15 WHEN 2 THEN 11 ELSE 12 END AS BIGINT) AS column_count,
  CASE WHEN lay <> 3 AND first_type IS NOT NULL THEN first_type ELSE {name_media} END AS inferred_media,
  COALESCE(first_name, regexp_replace(regexp_extract(f.file, '([^/]+)$', 1), '\\.[^.]*$', '')) AS advertiser,
  {status}
FROM f LEFT JOIN a USING (s_suppkey)"""
    std = f"""WITH {FILES}
SELECT f2.file, line_id, CAST(l_shipdate AS TIMESTAMP) AS date,
  CASE WHEN lay = 3 THEN '미분류' ELSE p_type END AS platform, s_name AS account_name, p_brand AS campaign_name,
  p_brand || '/' || p_type AS ad_group_name, CASE WHEN lay = 2 THEN '미분류' ELSE p_name END AS keyword,
  CASE WHEN lay IN (0, 1) THEN 'P' || CAST(l_partkey AS VARCHAR) ELSE '미분류' END AS product_name,
  CAST(CAST(l_quantity AS BIGINT) * 100 AS DOUBLE) AS impressions,
  CAST(l_linenumber + CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) AS clicks,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS cost,
  CASE WHEN lay = 3 THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS conversions,
  CASE WHEN lay = 2 THEN 0.0 ELSE CAST(CAST(l_extendedprice * round(l_tax * 100) AS DECIMAL(18,2)) AS DOUBLE) END
    AS revenue,
  CASE WHEN lay = 3 THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS orders
FROM li JOIN (SELECT s_suppkey, file FROM f) f2 USING (s_suppkey)"""
    file_fact = f"{FILES},\nad_fact AS ({std.removeprefix(f'WITH {FILES}')})"
    file_issues = f"""WITH r AS ({required}), i AS ({o.action_issues(("file",)).replace(o.AD_FACT, file_fact)}),
p AS (SELECT file, count(*) AS n, string_agg(problem || ' / ' || evidence, ' | ' ORDER BY issue_rank) FILTER (issue_rank <= 5) AS preview
      FROM i GROUP BY file)
SELECT r.file, CAST(coalesce(n, 0) AS BIGINT) AS action_issue_count, coalesce(preview, '') AS preview,
       CASE WHEN n IS NULL THEN 'limited' WHEN starts_with(preview, 'insufficient data') THEN 'data_shortage'
            WHEN {' AND '.join(f'status_{m} = {ok}' for m in audit.NUMERIC_FIELDS)} THEN 'possible' ELSE 'limited' END AS readiness,
       'loaded' AS load_status
FROM r LEFT JOIN p USING (file)"""
    std_rates = f"""WITH s AS ({std})
SELECT *, COALESCE(clicks / NULLIF(impressions, 0), 0) AS ctr, COALESCE(cost / NULLIF(clicks, 0), 0) AS cpc,
       COALESCE(conversions / NULLIF(clicks, 0), 0) AS cvr, COALESCE(cost / NULLIF(conversions, 0), 0) AS cpa,
       COALESCE(revenue / NULLIF(cost, 0), 0) AS roas FROM s"""
    cands = f"""WITH {FILES},
h AS (SELECT file, lay FROM f),
c AS (SELECT * FROM (VALUES (1, 13, '장바구니', 'cart_count'), (1, 14, '광고ID', 'metadata_hold'),
                            (2, 9, 'ROAS', 'roas'), (3, 11, '클릭률', 'metadata_hold'))
      t(lay, position, header, suggested_target))
SELECT h.file AS source, CAST(c.position AS INTEGER) AS position, c.header, c.suggested_target FROM h JOIN c USING (lay)"""
    media = f"""WITH {FILES},
a AS (SELECT s_suppkey, arg_min(p_type, (line_id, p_type)) AS first_type FROM li GROUP BY s_suppkey),
m AS (SELECT CASE WHEN lay <> 3 AND first_type IS NOT NULL THEN first_type ELSE {name_media} END AS inferred_media
      FROM f LEFT JOIN a USING (s_suppkey)),
w AS (SELECT * FROM (VALUES ('G마켓'), ('옥션'), ('G마켓/옥션')) t(inferred_media)),
h AS (SELECT inferred_media, COUNT(*) AS files FROM m GROUP BY inferred_media)
SELECT w.inferred_media, CAST(COALESCE(files, 0) AS BIGINT) AS files,
       CASE WHEN files > 0 THEN 'validated_real_file' ELSE 'pending_no_file' END AS validation_status
FROM w LEFT JOIN h USING (inferred_media)"""
    profiles = f"""WITH {FILES},
a AS (SELECT s_suppkey, arg_min(p_type, (line_id, p_type)) AS first_type FROM li GROUP BY s_suppkey),
m AS (SELECT f.file, CASE WHEN lay <> 3 AND first_type IS NOT NULL THEN first_type ELSE {name_media} END
               AS inferred_media,
             CASE WHEN f.file LIKE '%gmarket%' THEN 'gmarket_auction_legacy_candidate' ELSE 'unknown' END
               AS report_version
      FROM f LEFT JOIN a USING (s_suppkey))
SELECT file, inferred_media, report_version,
  CASE WHEN inferred_media IN ('G마켓', '옥션', 'G마켓/옥션') THEN 'marketplace_legacy_candidate'
       WHEN inferred_media IN ('네이버', '11번가') THEN 'real_file_auto_diagnosis'
       WHEN report_version <> 'unknown' THEN report_version ELSE 'generic_ad_file' END AS profile_label
FROM m"""
    folder = f"""WITH {FILES},
a AS (SELECT s_suppkey, COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost,
             SUM(CAST(l_quantity AS BIGINT) * 100) AS impressions FROM li GROUP BY s_suppkey),
r AS (SELECT regexp_extract(f.file, '([^/]+)$', 1) AS report, 'loaded' AS load_status, COALESCE(n, 0) AS n,
             CASE lay WHEN 0 THEN 13 WHEN 1 THEN 15 WHEN 2 THEN 11 ELSE 12 END AS cols,
             CASE lay WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS extras,
             CASE f.s_suppkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 70 ELSE 0 END AS more,
             COALESCE(cost, 0) AS cost, COALESCE(impressions, 0) AS impressions FROM f LEFT JOIN a USING (s_suppkey))
SELECT report, load_status, CAST(n AS BIGINT) AS row_count, CAST(cols + more AS BIGINT) AS column_count,
       CAST(cost AS DOUBLE) AS cost, CAST(impressions AS DOUBLE) AS impressions,
       CAST(n * (extras + more) AS BIGINT) AS extra_cells FROM r
UNION ALL
SELECT 'blank_' || CAST(s_suppkey AS VARCHAR) || '.csv', 'failed', 0, 0, 0.0, 0.0, 0 FROM supplier WHERE s_suppkey % 10 = 3"""
    extras = f"""WITH {FILES}
SELECT f2.file, line_id, CASE lay WHEN 0 THEN '{{}}'
  WHEN 1 THEN '{{"장바구니":"' || CAST(l_linenumber % 3 AS VARCHAR) || '","광고ID":"' || CAST(l_orderkey AS VARCHAR) || '"}}'
  WHEN 2 THEN '{{"ROAS":"0%"}}' ELSE '{{"클릭률":"1.5%"}}' END AS extras
FROM li JOIN (SELECT s_suppkey, file FROM f) f2 USING (s_suppkey)"""
    values = ",\n  ".join(f"({lay}, {i}, '{h}', '{norm}', {repr(c) if c else 'NULL'}, '{kind}')"
                          for lay, heads in enumerate(HEADER_CASES) for i, (h, norm, c, kind) in enumerate(heads))
    mapped = f"""WITH {FILES},
t AS (SELECT * FROM (VALUES {values}) v(lay, position, header, header_norm, canonical, match_kind))
SELECT f.file AS source, CAST(position AS INTEGER) AS position, header, header_norm, canonical, match_kind,
       CASE match_kind WHEN 'exact' THEN 1.0 WHEN 'fuzzy' THEN 2.0 * 5 / (6 + 5) END AS similarity
FROM f JOIN t USING (lay)"""
    names = ", ".join(f"('{c}')" for c in CANONICAL_COLUMNS)
    missing = f"""WITH m AS ({mapped}), c AS (SELECT * FROM (VALUES {names}) v(canonical)), s AS (SELECT DISTINCT source FROM m)
SELECT s.source, c.canonical FROM s CROSS JOIN c ANTI JOIN m ON m.source = s.source AND m.canonical = c.canonical"""
    profiled = f"""WITH m AS ({media}),
p AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN '{MARKETPLACE_MEDIA[0]}' ELSE '{MARKETPLACE_MEDIA[1]}' END AS pm FROM nation)
SELECT inferred_media, files, CASE WHEN files > 0 THEN 'validated_real_file' WHEN inferred_media IN (SELECT pm FROM p)
       THEN 'validated_profile' ELSE 'pending_no_file' END AS validation_status FROM m"""
    both = f"""WITH q AS ({required}),
p AS (SELECT 'profile/' || n_name AS file, CASE WHEN n_nationkey % 2 = 0 THEN '{MARKETPLACE_MEDIA[0]}'
             ELSE '{MARKETPLACE_MEDIA[1]}' END AS inferred_media FROM nation)
SELECT file, inferred_media, row_count, 'real_file' AS audit_source FROM q
UNION ALL SELECT file, inferred_media, CAST(0 AS BIGINT), 'profile' FROM p
WHERE inferred_media NOT IN (SELECT inferred_media FROM q)"""
    fields = ", ".join(f"CASE WHEN status_{k} = 'cannot_judge' THEN '{k}' END" for k in audit.STATUS_ORDER)
    report_sql = f"""WITH q AS ({required}),
l AS (SELECT *, CAST(regexp_extract(file, '([0-9]+)[.]csv$', 1) AS BIGINT) % 4 AS lay,
             array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), ', ') AS hold FROM q)
SELECT '' AS file, 0 AS line_no, '# Report audit' AS line
UNION ALL SELECT '', 1, '- files: ' || format('{{:,}}', COUNT(*)) || ', loaded: ' || format('{{:,}}', COUNT(*)) || ', failed: 0' FROM l
UNION ALL SELECT '', 2, '- ' || inferred_media || ': ' || format('{{:,}}', COUNT(*)) FROM l GROUP BY inferred_media
UNION ALL SELECT file, 0, '## ' || file FROM l
UNION ALL SELECT file, 1, '- rows: ' || format('{{:,}}', row_count) || ', columns: ' || CAST(column_count AS VARCHAR) FROM l
UNION ALL SELECT file, 2, '- media: ' || inferred_media || ', advertiser: ' || advertiser FROM l
UNION ALL SELECT file, 3, '- unmapped: ' || CASE lay WHEN 0 THEN '' WHEN 1 THEN '장바구니, 광고ID' WHEN 2 THEN 'ROAS'
                                                 ELSE '클릭률' END FROM l
UNION ALL SELECT file, 4, '- cannot judge: ' || hold FROM l
UNION ALL SELECT file, 5, '- load: loaded' FROM l"""
    unread = ("SELECT 'reports/empty_' || lower(r_name) || '.csv' AS file, 0 AS row_count, 0 AS column_count, '매체 미분류' AS inferred_media, "
              "'empty_' || lower(r_name) AS advertiser, '' AS unmapped, 'cart_count, roas, cpc, ctr, cvr' AS hold, 'failed (empty file)' AS load, "
              "0 AS issues, 'real_file' AS audit_source FROM region")
    full_sql = f"""WITH q AS ({required}), fi AS ({file_issues}), b AS ({both}),
l AS (SELECT q.file, row_count, column_count, inferred_media, advertiser,
             CASE CAST(regexp_extract(q.file, '([0-9]+)[.]csv$', 1) AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '장바구니, 광고ID' WHEN 2 THEN 'ROAS'
               ELSE '클릭률' END AS unmapped, array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), ', ') AS hold,
             'loaded' AS load, action_issue_count AS issues, 'real_file' AS audit_source FROM q JOIN fi USING (file)
      UNION ALL {unread}),
x AS (SELECT file, inferred_media, audit_source, load FROM l
      UNION ALL SELECT file, inferred_media, audit_source, NULL FROM b WHERE audit_source = 'profile')
SELECT '' AS file, 0 AS line_no, '# Report audit' AS line
UNION ALL SELECT '', 1, '- files: ' || format('{{:,}}', COUNT(*)) || ', loaded: ' || format('{{:,}}', COUNT(*) - COUNT(*) FILTER (load LIKE 'failed%'))
                        || ', failed: ' || format('{{:,}}', COUNT(*) FILTER (load LIKE 'failed%')) FROM x
UNION ALL SELECT '', 2, '- ' || inferred_media || ': ' || format('{{:,}}', COUNT(*)) FROM x GROUP BY inferred_media
UNION ALL SELECT '', 3, '- real files: ' || format('{{:,}}', COUNT(*) FILTER (audit_source = 'real_file')) || ', profiles: '
                        || format('{{:,}}', COUNT(*) FILTER (audit_source = 'profile')) FROM x
UNION ALL SELECT file, 0, '## ' || file FROM x
UNION ALL SELECT file, 1, '- rows: ' || format('{{:,}}', row_count) || ', columns: ' || CAST(column_count AS VARCHAR) FROM l
UNION ALL SELECT file, 2, '- media: ' || inferred_media || ', advertiser: ' || advertiser FROM l
UNION ALL SELECT file, 3, '- unmapped: ' || unmapped FROM l
UNION ALL SELECT file, 3, '- unmapped: ' FROM x WHERE audit_source = 'profile'
UNION ALL SELECT file, 4, '- cannot judge: ' || hold FROM l
UNION ALL SELECT file, 5, '- load: ' || load FROM l
UNION ALL SELECT file, 6, '- issues: ' || format('{{:,}}', issues) FROM l"""
    return {"audit_report_full": full_sql, "file_audit_issues": file_issues, "media_validation_profiles": profiled, "audits_with_profiles": both, "audit_report": report_sql, "csv_folder": folder, "watched_folder": folder, "folder_extras": extras, "header_mapping": mapped, "missing_canonical": missing,
            "audit_required_status": required, "standardize_folder": std_rates, "alias_candidates": cands,
            "media_validation": media, "audit_profiles": profiles}
