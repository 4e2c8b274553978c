"""Files read in small blocks give the records that one reader of the whole file gives."""

import csv
import io
import os
import random

import pytest

from adlens.sources import csv_blocks
from adlens.sources.reports import any_case, read_report_lines


def whole(content: bytes):
    """(is_header, fields) by one csv reader over the whole file."""
    rows, header = [], True
    for cells in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")):
        fields = csv_blocks.clean(cells, header)
        if fields is not None:
            rows.append((header, fields))
            header = False
    return rows


def random_file(r, n):
    def cell():
        kind = r.random()
        plain = "".join(r.choice("abc 한é.") for _ in range(r.randint(0, 12)))
        if kind < 0.2:
            return '"' + plain.replace(".", '""') + r.choice(["", "\n", "\r\n", ",", '""', "\n\n"]) + plain + '"'
        if kind < 0.25:
            return plain + '"' + plain  # a quote inside a plain field is a character
        if kind < 0.27:
            return '"' + plain + '"' + "x"  # characters after a closing quote
        return plain
    lines = [",".join(cell() for _ in range(r.randint(1, 5))) for _ in range(n)]
    for k in range(0, n, 17):
        lines[k] = r.choice(["", ",,", "  ", '""'])
    return (r.choice(["", "﻿"]) + r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"])).encode()


def test_ends_inside_follows_the_reader():
    r = random.Random(1)
    for _ in range(3000):
        lines = ["".join(r.choice('a,"" ') for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4))]
        inside, done = False, 0
        for line in lines:
            inside = csv_blocks.ends_inside(line, inside)
            done += not inside
        assert len(list(csv.reader([x + "\n" for x in lines]))) == done + inside


def _read(spark, root, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = read_report_lines(spark, root).collect()
        parts = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["line_id"])):
        out.setdefault(os.path.basename(r["file"]), []).append((r["is_header"], list(r["fields"]), r["problem"]))
    return out, parts


@pytest.mark.parametrize("block", [64, 300, 5000])
def test_any_block_size_gives_the_whole_files_records(spark, tmp_dir, block):
    r = random.Random(block)
    os.makedirs(f"{tmp_dir}/in/sub")
    want = {}
    for k in range(6):
        content = random_file(r, r.choice([3, 40, 120]))
        name = f"sub/f{k}.CSV" if k % 2 else f"f{k}.csv"
        with open(f"{tmp_dir}/in/{name}", "wb") as fh:
            fh.write(content)
        want[os.path.basename(name)] = [(h, f, None) for h, f in whole(content)]
    got, parts = _read(spark, f"{tmp_dir}/in", block)
    assert got == {k: v or [(True, [], "empty file")] for k, v in want.items()}
    if block == 64:
        assert parts > 12  # large files are shared by many tasks


def test_long_quoted_fields_span_many_blocks(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    long = "\n".join(f'line {i} with ""quotes"", commas' for i in range(200))
    content = f'a,"b\nb",c\n1,"{long}",3\n4,"{long}\n",6\n7,8,"open at the end'.encode()
    with open(f"{tmp_dir}/in/x.csv", "wb") as fh:
        fh.write(content)
    got, _ = _read(spark, f"{tmp_dir}/in", 256)
    assert got["x.csv"] == [(h, f, None) for h, f in whole(content)]


def test_blank_blocks_and_unreadable_files(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for name, content in {"late.csv": b"\n" * 500 + b"h1,h2\n1,2\n", "blank.csv": b",,\n  \n" * 100, "none.csv": b"",
                          "bytes.csv": b"a,b\n" + b"1,2\n" * 100 + b"\xff\xfe,3\n"}.items():
        with open(f"{tmp_dir}/in/{name}", "wb") as fh:
            fh.write(content)
    got, _ = _read(spark, f"{tmp_dir}/in", 64)
    assert got == {"late.csv": [(True, ["h1", "h2"], None), (False, ["1", "2"], None)], "blank.csv": [(True, [], "empty file")],
                   "none.csv": [(True, [], "empty file")], "bytes.csv": [(True, [], "not UTF-8 text")]}


def test_globs_match_either_case():
    assert any_case("*.csv") == "*.[cC][sS][vV]" and any_case("r[a-z]*.txt") == "[rR][a-z]*.[tT][xX][tT]"
