"""How often the audit of a folder reads its lines and its audits, and that cleaning is the same by either path."""

import re

from pyspark.sql import functions as F

from adlens.functions.columns import clean_numeric, parse_date
from adlens.operators import audit, report


def _counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


def _lines(spark, cart):
    head = (["date", "platform", "account_name", "cost"], ["date", "media", "spend", "장바구니"])[cart]
    rows = [(f"f{cart}.csv", 0, True, head, None)] + [
        (f"f{cart}.csv", n, False, ["2024-01-01", "m", "a", "1"] if not cart else ["2024-01-01", "m", "2", "1,000"], None) for n in range(1, 41)]
    return spark.createDataFrame(rows, "file string, line_id long, is_header boolean, fields array<string>, problem string")


def test_audit_standardises_lines_once(spark):
    source = _lines(spark, 0).unionByName(_lines(spark, 1))
    rows = {r["file"]: r for r in audit.file_audit(source, False).collect()}
    assert {f: (r["row_count"], r["required_status"]["cart_count"]) for f, r in rows.items()} == {
        "f0.csv": (40, audit.UNKNOWN), "f1.csv": (40, audit.OK)}
    # the other branches read header lines; the union has two tables, whose data lines are read once each
    plan = audit.file_audit(source, False)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("NOT is_header", plan)) == 2


def test_cart_totals_agree_with_a_given_fact(spark):
    lines = _lines(spark, 0).unionByName(_lines(spark, 1))
    mapping = audit.map_headers(audit.header_catalog_from_lines(lines))
    given = audit.file_audit(lines, False, mapping=mapping, fact=audit.standardize_lines(lines, mapping))
    key = lambda df: sorted((r["file"], sorted(r["required_status"].items())) for r in df.collect())
    assert key(given) == key(audit.file_audit(lines, False))


def test_profiles_and_report_read_audits_once(spark):
    audits = audit.file_audit(_lines(spark, 0).unionByName(_lines(spark, 1)), False).localCheckpoint()
    counted, seen = _counted(spark, audits)
    profiles = spark.createDataFrame([("profile/x", "G마켓", 0)], "file string, inferred_media string, row_count long")
    assert audit.with_profile_audits(counted, profiles).count() == 3
    assert seen.value == 2
    counted, seen = _counted(spark, audits)
    assert report.audit_report_lines(counted).count() == 3 + 2 * 6
    assert seen.value == 2


def test_bare_cells_are_cleaned_like_others(spark):
    numbers = ["12", "1.50", "-3", ".5", "1e3", "1\n", "1\x85", "7 ", "1d", "12%"]
    df = spark.createDataFrame([(v,) for v in numbers], "v string")
    assert [r[0] for r in df.select(clean_numeric("v")).collect()] == [12.0, 1.5, -3.0, 0.5, 1000.0, 1.0, 1.0, 0.0, 0.0, 12.0]
    dates = ["2024-02-29", "2024-02-30", "2024-02-29\x85", " 2024-02-29", "2024-02-29 10:00:00"]
    df = spark.createDataFrame([(v,) for v in dates], "v string")
    assert [r[0] for r in df.select(parse_date("v").cast("string")).collect()] == [
        "2024-02-29 00:00:00", None, "2024-02-29 00:00:00", "2024-02-29 00:00:00", "2024-02-29 10:00:00"]
    whole = df.select(F.transform(F.array("v"), parse_date)[0].cast("string"))
    assert [r[0] for r in whole.collect()] == [r[0] for r in df.select(parse_date("v").cast("string")).collect()]


def test_records_parse_unbroken_files_once(spark, tmp_dir, monkeypatch):
    """Each line goes to Python twice (where blocks begin, then records) unless a record of its file spans blocks."""
    import os

    from adlens.sources import csv_blocks, reports
    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write('date,note\n' + '2024-01-01,"two\nlines"\n' * 20)
    lines = reports._numbered(spark.read.option("lineSep", "\n").text(tmp_dir)).repartition(1).sortWithinPartitions("block").localCheckpoint()
    counted, seen = _counted(spark, lines)
    rows = csv_blocks.records(counted)
    assert rows.where("NOT is_header AND fields[1] = 'two\nlines'").count() == 20
    assert seen.value == 2 * lines.count()


def test_open_record_at_the_end_of_a_file_is_kept(spark, tmp_dir):
    import os

    from adlens.sources.reports import read_report_lines
    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write('date,note\n2024-01-01,x\n2024-01-02,"open\nstill')
    with open(os.path.join(tmp_dir, "b.csv"), "w") as f:
        f.write('date,note\n2024-01-03,y\n')
    got = {tuple(r["fields"]) for r in read_report_lines(spark, tmp_dir).where("NOT is_header").collect()}
    assert got == {("2024-01-01", "x"), ("2024-01-02", "open\nstill"), ("2024-01-03", "y")}
