"""Standardiser edge cases (FIXTURES.md §3), CSV folder ingest and file detection (§7)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from adlens.constants import UNCLASSIFIED
from adlens.functions.columns import clean_dimension, clean_numeric, parse_date
from adlens.operators import audit, files, ingest
from adlens.sources.reports import list_files, read_report_lines


def test_numeric_cleaning(spark):
    vals = ["1,234원", " 12 ", "3.5%", "abc", "-", "", "NA", "nan", "1d", "1.5f", None, "1e3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["x"] for r in df.select(clean_numeric("v").alias("x")).collect()]
    assert got == [1234.0, 12.0, 3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0]


def test_dimension_cleaning(spark):
    df = spark.createDataFrame([("",), ("  ",), ("NA",), (None,), (" 캠페인 ",)], "v string")
    got = [r["x"] for r in df.select(clean_dimension("v").alias("x")).collect()]
    assert got == [UNCLASSIFIED] * 4 + ["캠페인"]


def test_date_parsing(spark):
    vals = ["2026-06-01", "2026/06/01", "2026.06.01", "20260601", "2026-06", "2026년 6월 1일", "6/1/2026", "bad", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["d"] for r in df.select(parse_date("v").alias("d")).collect()]
    assert got[:7] == [dt.datetime(2026, 6, 1)] * 7
    assert got[7:] == [None, None]


def test_header_mapping(spark):
    layouts = {
        "f1": ["노출수(회)", "Campaign-Name", "총전환매출액", "전환수량", "매체", "platform", "clickz"],
        "f2": ["impression", "광고노출수"],
        "f3": ["revenues"],
    }
    m = ingest.map_headers(ingest.header_catalog(spark, layouts))
    got = {(r["source"], r["header"]): (r["canonical"], r["match_kind"]) for r in m.collect()}
    assert got[("f1", "노출수(회)")] == ("impressions", "exact")
    assert got[("f1", "Campaign-Name")] == ("campaign_name", "exact")
    assert got[("f1", "총전환매출액")] == ("revenue", "fuzzy")
    assert got[("f1", "전환수량")] == (None, "unmapped")
    assert got[("f1", "매체")] == ("platform", "exact") and got[("f1", "platform")] == (None, "duplicate")
    assert got[("f1", "clickz")] == ("clicks", "fuzzy")
    assert got[("f2", "impression")] == ("impressions", "fuzzy")
    # an exact alias, but impressions is already claimed by the earlier column of that file
    assert got[("f2", "광고노출수")] == (None, "duplicate")
    assert got[("f3", "revenues")] == ("revenue", "fuzzy")
    missing = {r["canonical"] for r in ingest.missing_canonical(m).where("source = 'f1'").collect()}
    assert missing == {"date", "account_name", "ad_group_name", "keyword", "product_name", "cost", "conversions",
                       "orders"}


def test_standardize_missing_columns(spark):
    raw = spark.createDataFrame([("2026-06-01", "x", "10")], "`일자` string, memo string, `광고비` string")
    fact, _ = ingest.standardize_layout(raw)
    r = fact.collect()[0]
    assert r["cost"] == 10.0 and r["impressions"] == 0.0 and r["platform"] == UNCLASSIFIED and r["memo"] == "x"
    assert r["roas"] == 0.0


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_csv_folder_audit(spark, tmp_dir):
    _write(f"{tmp_dir}/in/a/gmarket_report.csv",
           "일자,광고매체,계정명,캠페인명,광고비,노출수,클릭수,전환수,매출,장바구니\n"
           "2026-06-01,,샘플,캠페인1,\"1,000\",100,5,1,5000,2\n2026-06-02,,샘플,캠페인2,2000,300,3,0,0,0\n")
    _write(f"{tmp_dir}/in/b/other.csv", "date,platform,cost\n2026-06-01,naver,100\n")
    lines = read_report_lines(spark, f"{tmp_dir}/in")
    a = {os.path.basename(r["file"]): r for r in audit.file_audit(lines).collect()}
    g = a["gmarket_report.csv"]
    assert g["row_count"] == 2 and g["column_count"] == 10
    assert g["inferred_media"] == "G마켓"  # media column is blank -> inferred from the file name
    st = g["required_status"]
    assert st["platform"] == "cannot_judge" and st["cost"] == "ok" and st["cart_count"] == "ok"
    assert st["product_or_keyword"] == "mapping_failed"
    o = a["other.csv"]
    assert o["inferred_media"] == "naver" and o["required_status"]["impressions"] == "mapping_failed"
    fact = audit.standardize_lines(lines, ingest.map_headers(audit.header_catalog_from_lines(lines)))
    assert sorted(r["cost"] for r in fact.collect()) == [100.0, 1000.0, 2000.0]


def _by_name(df):
    return {os.path.basename(r["file"]): r for r in df.collect()}


def test_csv_shapes(spark, tmp_dir):
    wide = [f"x{i}" for i in range(70)]
    _write(f"{tmp_dir}/in/gap.csv", "일자,,매체,캠페인,광고비,노출수,,\n2026-06-01,memo,NAVER,c1,1000,100,\n")
    _write(f"{tmp_dir}/in/blank.csv", "\n  \ndate,platform,cost\n\n2026-06-01,naver,5\n2026-06-02,naver,6\n")
    _write(f"{tmp_dir}/in/quoted.csv", "date,campaign,cost\r\n2026-06-01,\"two\nlines, \"\"quoted\"\"\",7\r\n")
    _write(f"{tmp_dir}/in/wide.csv", ",".join([*wide, "date", "cost"]) + "\n" + ",".join([*map(str, range(70)), "2026-06-01", "9"]) + "\n")
    _write(f"{tmp_dir}/in/empty.csv", "")
    _write(f"{tmp_dir}/in/only_blanks.csv", "\n \n")
    _write(f"{tmp_dir}/in/header_only.csv", "date,cost\n")
    with open(f"{tmp_dir}/in/bytes.csv", "wb") as f:
        f.write(b"date,cost\n\xff\xfe,1\n")
    lines = read_report_lines(spark, f"{tmp_dir}/in")
    fact = audit.standardize_lines(lines, ingest.map_headers(audit.header_catalog_from_lines(lines)), keep_extras=True)
    rows = {}
    for r in fact.orderBy("file", "line_id").collect():
        rows.setdefault(os.path.basename(r["file"]), []).append(r)
    gap, = rows["gap.csv"]
    assert (gap["platform"], gap["campaign_name"], gap["cost"], gap["impressions"]) == ("NAVER", "c1", 1000, 100)
    assert gap["extras"] == {"column_1": "memo"}
    assert [r["cost"] for r in rows["blank.csv"]] == [5, 6]
    quoted, = rows["quoted.csv"]
    assert quoted["campaign_name"] == 'two\nlines, "quoted"' and quoted["cost"] == 7
    one, = rows["wide.csv"]
    assert one["cost"] == 9 and one["date"] == dt.datetime(2026, 6, 1) and one["extras"]["x69"] == "69"
    audits = _by_name(audit.file_audit(lines))
    assert len(audits) == 8 and audits["wide.csv"]["column_count"] == 72 and audits["gap.csv"]["column_count"] == 6
    failed = {n: r["load_problem"] for n, r in audits.items() if r["load_status"] == "failed"}
    assert failed == {"empty.csv": "empty file", "only_blanks.csv": "empty file", "bytes.csv": "not UTF-8 text"}
    assert all(audits[n]["readiness"] == "fail" and audits[n]["row_count"] == 0 for n in failed)
    assert audits["header_only.csv"]["row_count"] == 0 and audits["header_only.csv"]["load_status"] == "loaded"


def test_repeated_extra_headers(spark, tmp_dir):
    _write(f"{tmp_dir}/in/a.csv", "date,memo,memo,,\n2026-06-01,p,q,r\n2026-06-02,p\n")
    lines = read_report_lines(spark, f"{tmp_dir}/in")
    fact = audit.standardize_lines(lines, ingest.map_headers(audit.header_catalog_from_lines(lines)), keep_extras=True)
    assert [r["extras"] for r in fact.orderBy("line_id").collect()] == [{"memo": "p", "memo.1": "q"}, {"memo": "p", "memo.1": None}]


def test_download_detection(spark, tmp_dir):
    d = f"{tmp_dir}/downloads"
    for name, body in [("report.csv", "x"), ("report.xlsx", "x"), ("REPORT.XLSX", "x"), ("empty.xlsx", ""),
                       ("report.xlsx.crdownload", "x"), ("demo_a.csv", "x"), ("notes.txt", "x")]:
        _write(f"{d}/{name}", body)
    listing = list_files(spark, d)
    names = {r["name"] for r in files.completed_downloads(listing).collect()}
    assert names == {"report.csv", "report.xlsx", "REPORT.XLSX"}
    with_demo = {r["name"] for r in files.completed_downloads(listing, include_demo=True).collect()}
    assert "demo_a.csv" in with_demo
    future = {r["name"] for r in files.completed_downloads(listing, after=dt.datetime(2999, 1, 1)).collect()}
    assert future == set()


def test_detection_cutoff(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 6, 1, 10, 0), True, 10), (dt.datetime(2026, 6, 1, 10, 0), True, -5),
                                (dt.datetime(2026, 6, 1, 10, 0), False, 10)],
                               "s timestamp_ntz, w boolean, m int")
    got = [r["c"] for r in df.select(files.detection_cutoff(F.col("s"), F.col("w"), F.col("m")).alias("c")).collect()]
    assert got == [dt.datetime(2026, 6, 1, 9, 50), dt.datetime(2026, 6, 1, 10, 0), dt.datetime(2026, 6, 1, 10, 0)]


def test_retention_plan(spark):
    now = dt.datetime(2026, 6, 30)
    inv = spark.createDataFrame([
        ("data/raw/a.csv", 1024 * 1024, dt.datetime(2026, 1, 1)),
        ("data/raw/b.csv", 1024 * 1024, dt.datetime(2026, 6, 1)),
        ("data/screenshots/s.png", 2 * 1024 * 1024, dt.datetime(2026, 5, 1)),
        ("data/raw/skip.png", 10, dt.datetime(2020, 1, 1)),
    ], "path string, length bigint, modificationTime timestamp_ntz")
    plan = {r["target"]: r for r in files.retention_plan(inv, now).collect()}
    assert plan["raw"]["file_count"] == 2 and plan["raw"]["delete_candidate_count"] == 1
    assert plan["screenshots"]["delete_candidate_mb"] == pytest.approx(2.0)
    assert plan["logs"]["file_count"] == 0
    assert plan[None]["file_count"] == 3


def test_likely_aliases_bound_the_ratio(spark):
    """No alias that reaches the similarity limit is left out, and headers far from all never reach Python."""
    import difflib
    import random
    from adlens.constants import MIN_HEADER_SIMILARITY
    from adlens.operators import ingest
    r = random.Random(4)
    aliases = ingest.alias_dimension(spark)
    known = [x["alias_norm"] for x in aliases.collect()]
    headers = set()
    for a in known:
        for _ in range(3):
            t = list(a)
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(t) + 1)
                t[k:k + r.randint(0, 1)] = r.choice(["x", "", "a", "수"])
            headers.add("".join(t))
    headers |= {"completely different words", "zzz", ""}
    df = spark.createDataFrame([(h,) for h in sorted(headers)], "header_norm string")
    got = {x["header_norm"]: {a["alias_norm"] for a in x["likely"]} for x in ingest.likely_aliases(df, aliases).collect()}
    for h in headers - {""}:
        reach = {a for a in known if difflib.SequenceMatcher(None, h, a).ratio() >= MIN_HEADER_SIMILARITY
                 or difflib.SequenceMatcher(None, a, h).ratio() >= MIN_HEADER_SIMILARITY}
        assert reach <= got.get(h, set())
    assert "completely different words" not in got and "" not in got


def test_similarity_bound_sees_each_distinct_header_once(spark):
    """The bound against the whole catalog stays above the grouping of the headers, however many files have them."""
    names = [("clickz", 0), ("Clickz", 1), ("memo", 2)]
    catalog = spark.createDataFrame([(f"f{i}", at, h) for i in range(500) for h, at in names], "source string, position int, header string")
    mapping = ingest.map_headers(catalog)
    plan = mapping._jdf.queryExecution().optimizedPlan().toString().split("\n")
    bound = [i for i, line in enumerate(plan) if "char_length" in line and "lambda" in line]
    exact = [i for i, line in enumerate(plan) if "Join LeftOuter" in line and "alias_norm" in line]
    assert bound and exact and max(bound) < max(exact)  # a plan's input lies below it
    got = {tuple(r) for r in mapping.groupBy("header", "canonical", "match_kind").agg(F.count(F.lit(1))).collect()}
    assert got == {("clickz", "clicks", "fuzzy", 500), ("Clickz", None, "duplicate", 500), ("memo", None, "unmapped", 500)}
