"""The report folder's files: how they are written and listed, and that runs of lines parse as single lines do."""

import csv
import io
import os
import random
from urllib.parse import unquote

import pyarrow as pa
import pytest

from adlens.operators import audit, ingest
from adlens.sources import csv_blocks
from adlens.sources.csv_blocks import LINES
from adlens.sources.reports import path_of, read_report_lines, write_lines


def _files(root):
    return {os.path.basename(f): os.path.join(d, f) for d, _, names in os.walk(root) for f in names}


def test_write_lines_writes_one_named_file_a_report(spark, tmp_dir):
    rows = [("reports/a.csv", 2, False, ['say "x"', None, "two\nlines"], None), ("reports/a.csv", 0, True, ["h1", "h2", "h3"], None),
            ("reports/a.csv", 1, False, ["cell\x1fend", "", ","], None), ("reports/한 b%20.csv", 0, True, [], None)]
    root = f"{tmp_dir}/in put"
    write_lines(spark.createDataFrame(rows, LINES), root)
    files = _files(root)
    assert set(files) == {"a.csv", "한 b%20.csv"}  # one file each, nothing hidden or beside them
    with open(files["a.csv"], newline="", encoding="utf-8") as f:
        assert f.read() == '"h1","h2","h3"\n"cell\x1fend","",","\n"say ""x""","","two\nlines"\n'
    got = {(unquote(os.path.basename(r["file"])), r["problem"], tuple(r["fields"])) for r in read_report_lines(spark, root).collect()}
    assert got == {("a.csv", None, ("h1", "h2", "h3")), ("a.csv", None, ("cell\x1fend", None, ",")),
                   ("a.csv", None, ('say "x"', None, "two\nlines")), ("한 b%20.csv", "empty file", ())}


def test_files_without_a_byte_are_found_by_the_scans_listing(spark, tmp_dir):
    names = ["a b.csv", "50%.csv", "x%20y.csv", "한글.csv", "q?#+.CSV"]
    os.makedirs(f"{tmp_dir}/in/sub")
    for i, name in enumerate(names):
        open(f"{tmp_dir}/in/empty {name}", "w").close()
        with open(f"{tmp_dir}/in/sub/{name}", "w") as f:
            f.write("date,cost\n2024-01-01,1\n")
    rows = read_report_lines(spark, f"{tmp_dir}/in").collect()
    assert {(unquote(r["file"]), r["problem"]) for r in rows if not r["fields"]} == {(f"file:{tmp_dir}/in/empty {n}", "empty file") for n in names}
    assert {(unquote(r["file"]), r["is_header"]) for r in rows if r["fields"]} == {(f"file:{tmp_dir}/in/sub/{n}", h) for n in names for h in (True, False)}
    assert path_of("hdfs://nn:8020/a%20b") == "hdfs://nn:8020/a%20b" and path_of("file:///a") == "file:/a"


def _parsed(lines, runs):
    parser, out, at = csv_blocks._Parser("f", 0, False, False), [], 0
    for n in runs:
        out += parser.add(pa.array(lines[at:at + n], pa.binary()))
        at += n
    return [x["fields"] for b in out + parser.close() for x in b.to_pylist() if x["part"] is None]


@pytest.mark.parametrize("odd", [0, 0.02])
def test_runs_of_lines_parse_as_one_file(odd, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(csv_blocks, "LINES_OF_ODD_RUNS", 4)

    def cell():
        plain = "".join(r.choice("ab 한é.　\t") for _ in range(r.randint(0, 6)))
        if r.random() < 0.4:
            return '"' + plain.replace(".", '""') + r.choice(["", "\n", "\r\n", ",", '""', '\n""']) + '"'
        return f'p{plain}"x' if r.random() < odd else plain  # a quote inside a plain field is a character

    for _ in range(300):
        text = r.choice(["\n", "\r\n"]).join(",".join(cell() for _ in range(r.randint(1, 4))) for _ in range(r.choice([2, 30]))) + "\n"
        want = [csv_blocks.clean(c, False) for c in csv.reader(io.StringIO(text, newline=""))]
        lines = text.encode().split(b"\n")[:-1]
        k = r.randint(0, len(lines))
        assert _parsed(lines, [k, len(lines) - k]) == [x for x in want if x is not None]


def test_regular_runs_never_go_line_by_line(monkeypatch):
    seen = []
    monkeypatch.setattr(csv_blocks._Parser, "_line", lambda self, line: seen.append(line))
    got = _parsed(['"a","b ""q"""'.encode(), b'1,"two', b'lines"', b",,"] * 1000, [4000])
    assert got == [["a", 'b "q"'], ["1", "two\nlines"]] * 1000 and not seen


def test_extras_take_their_names_from_a_map_of_the_file(spark):
    rows = [("f.csv", 0, True, ["date", "memo", "", "memo"], None), ("f.csv", 1, False, ["2024-01-01", "x", "y"], None),
            ("g.csv", 0, True, ["date"], None), ("g.csv", 1, False, ["2024-01-02", "z"], None)]
    lines = spark.createDataFrame(rows, LINES)
    fact = audit.standardize_lines(lines, ingest.map_headers(audit.header_catalog_from_lines(lines)), keep_extras=True)
    assert {r["file"]: r["extras"] for r in fact.collect()} == {"f.csv": {"memo": "x", "column_2": "y", "memo.1": None}, "g.csv": {}}
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    assert "transform_values" in plan  # no map of a line's own is built, key by key


def test_watched_files_are_listed_by_few_tasks(spark, tmp_dir):
    """A trigger of 50 files lists them in four tasks a core at most, and the session's setting stays as it was."""
    from adlens.streaming import watch
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, seen, real = spark.conf.get(key), [], watch.lines_of_text
    os.makedirs(f"{tmp_dir}/in")
    for i in range(50):
        with open(f"{tmp_dir}/in/f{i}.csv", "w") as f:
            f.write(f"date,cost\n2024-01-01,{i}\n")

    def looked(batch):
        seen.append(batch.sparkSession.conf.get(key))
        return real(batch)

    watch.lines_of_text = looked
    try:
        watch.watch_report_folder(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", checkpoint=f"{tmp_dir}/c", analysis=False)
    finally:
        watch.lines_of_text = real
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(key) == before
    fact = spark.read.parquet(f"{tmp_dir}/out/standardized")
    assert {(r["file"], r["cost"]) for r in fact.collect()} == {(f"file:{tmp_dir}/in/f{i}.csv", i) for i in range(50)}
