"""CSV records of files that are read in blocks by many tasks.

A quoted field may hold line breaks, so a block of a file can't tell by itself whether its
first line begins a record. It can tell where it would end in either case: reading its lines
from *outside* quotes and from *inside* one gives two answers, and composing these answers
along the blocks of a file settles where every block begins. Then each block parses its own
records. Lines before its first record, and an open record at its end, are fragments; they
are put together by file and parsed as well.

Runs of lines are scanned and parsed as one array of bytes (:class:`_Marks`) where every quote
begins or ends a field or is doubled; other runs go line by line through ``csv``.

Files are read by Spark's text source, so any file system and any size will do. A task holds
a few thousand records, or one that spans blocks.
"""

from __future__ import annotations

import csv
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from adlens.session import materialize

LINES_AT_ONCE = 4096
LINES_OF_ODD_RUNS = 256
LINES = "file string, line_id long, is_header boolean, fields array<string>, problem string"
_ENDS = "file string, block long, outside boolean, inside boolean, some_outside boolean, some_inside boolean, valid boolean"
_PARSED = LINES + ", block long, part int, text string"
_SCHEMA = pa.schema([("file", pa.string()), ("line_id", pa.int64()), ("is_header", pa.bool_()), ("fields", pa.list_(pa.string())),
                     ("problem", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())])
_BOM = "﻿"
# A line of whole fields: without any quote, or quoted from the first character to the last.
_FIELD = r'(?:"[^"]*+"(?:"[^"]*+")*+|[^",\r]*+)'
_CLOSED = re.compile(f"{_FIELD}(?:,{_FIELD})*+\r?").fullmatch
TAIL, HEAD = 0, 1  # a block's lines before its first record, and its open record


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, given whether one was before it.

    A quote opens a field only as its first character; in a quoted field two quotes are one.
    """
    if not inside and ('"' not in line or _CLOSED(line)):
        return False
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at += not inside
            while True:
                at = line.find('"', at) + 1
                if not at:
                    return True
                if not line.startswith('"', at):
                    break
                at += 1
            inside = False
        comma, back = line.find(",", at), line.find("\r", at)
        at = min(x for x in (comma, back, len(line)) if x >= 0) + 1
        if at > len(line):
            return False


_QUOTE, _COMMA, _BREAK, _RETURN = b'",\n\r'


class _Marks:
    """The quotes, commas and line ends of ``lines``, whole lines that begin outside quotes.

    ``regular``: a quote that opens a field is its first character, one that closes it is its last, others
    are doubled, and a carriage return outside quotes ends its line. Then a byte is inside quotes after an odd
    number of them, as for ``csv``.
    """

    def __init__(self, lines: pa.Array):
        text = pc.binary_join_element_wise(lines, b"", b"\n")
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int32)[text.offset:text.offset + len(text) + 1]
        self.data = d = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
        self.at = np.flatnonzero((d == _QUOTE) | (d == _COMMA) | (d == _BREAK) | (d == _RETURN))
        self.kind = d[self.at]
        self.quote = self.kind == _QUOTE
        self.after = (np.cumsum(self.quote, dtype=np.uint8) & 1).astype(bool)
        self.before = self.after ^ self.quote
        quotes, returns = self.at[self.quote], self.at[(self.kind == _RETURN) & ~self.before]
        left, right = d[quotes[::2] - 1], d[quotes[1::2] + 1]  # the byte before the first is the last, a line break
        self.regular = bool(np.all((left == _COMMA) | (left == _BREAK) | (left == _QUOTE)) and np.all(d[returns + 1] == _BREAK)
                            and np.all((right == _COMMA) | (right == _BREAK) | (right == _QUOTE) | (right == _RETURN)))

    @property
    def inside(self) -> bool:
        """Whether a field is open after the last line."""
        return bool(self.after[-1])

    def records(self) -> tuple[int, pa.Array]:
        """How many lines the complete records take, and these records' cells: null if empty, without blank records."""
        whole = (self.kind == _BREAK) & ~self.after
        n = len(whole) - int(np.argmax(whole[::-1])) if whole.any() else 0
        at, kind, quote, before = self.at[:n], self.kind[:n], self.quote[:n], self.before[:n]
        data = self.data[:at[-1] + 1 if n else 0]
        ends = ~before & ((kind == _COMMA) | (kind == _BREAK))
        doubled = quote & ~before & (data[at - 1] == _QUOTE)  # the second of two, which stays
        gone = (~before & ~doubled) | (quote & before)
        kept = np.ones(len(data), bool)
        kept[at[gone]] = False
        content = data[kept]
        cells = np.concatenate([[0], (at - np.cumsum(gone, dtype=np.int32) + gone)[ends]]).astype(np.int32)
        rows = np.concatenate([[0], np.flatnonzero(kind[ends] == _BREAK) + 1]).astype(np.int32)
        full = np.diff(cells) > 0
        values = pa.StringArray.from_buffers(len(full), pa.py_buffer(cells), pa.py_buffer(content),
                                             pa.py_buffer(np.packbits(full, bitorder="little")))
        lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values)
        return int(np.count_nonzero(kind == _BREAK)), _without_blanks(lists, content, cells[rows])


def _without_blanks(records: pa.Array, content: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The records with a character that isn't white space; ``ends`` are the places of their content."""
    keep = np.diff(ends) > 0
    first = content[ends[:-1][keep]]
    for i in np.flatnonzero(keep)[(first <= 32) | (first >= 127)]:
        keep[i] = bool(content[ends[i]:ends[i + 1]].tobytes().decode("utf-8").strip())
    return records if keep.all() else records.filter(pa.array(keep))


def _cells(lines: list[str]):
    """The records of complete lines."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader([line + "\n" for line in lines])


def _has_record(lines: list[str]) -> bool:
    return any(any(c.strip() for c in cells) for cells in _cells(lines))


class _End:
    """Where a block ends that begins inside, or outside, a quoted field, and whether a record begins in it."""

    def __init__(self, inside: bool):
        self.inside, self.leading, self.some, self.open = inside, inside, False, []

    def add(self, line: str, inside: bool) -> None:
        """Take a line in that ends ``inside`` a quoted field or not."""
        was, self.inside = self.inside, inside
        if self.leading:
            self.leading = self.inside
        elif not self.some:
            self.open = self.open + [line] if was else [line]
            if self.inside:
                self.some = bool(self.open[0].strip(', \t\r"'))
            else:
                self.some = _has_record(self.open)


def _blocks(batches):
    """(file, block, lines) of runs of one block's lines, in order; a block comes in several runs."""
    for b in batches:
        if not b.num_rows:
            continue
        files, blocks = pc.run_end_encode(b.column(0)), pc.run_end_encode(b.column(1))
        values, at = b.column(2).cast(pa.binary()), 0
        for to in sorted({*files.run_ends.to_pylist(), *blocks.run_ends.to_pylist()}):
            yield b.column(0)[at].as_py(), b.column(1)[at].as_py(), values.slice(at, to - at)
            at = to


def _decoded(lines: pa.Array) -> list[str]:
    return [x.decode("utf-8") for x in lines.to_pylist()]


def _without_mark(lines: pa.Array) -> pa.Array:
    """The first lines of a file without its byte order mark."""
    first = lines[0].as_py()
    if not first.startswith(_BOM.encode()):
        return lines
    return pa.concat_arrays([pa.array([first.removeprefix(_BOM.encode())], pa.binary()), lines.slice(1)])


def _is_utf8(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _read_ends(out: _End, in_: _End, lines: pa.Array) -> None:
    """Take lines of a block in, for its beginning outside quotes and inside them (the same if the file begins with it)."""
    at, n, step = 0, len(lines), len(lines)
    while at < n:
        run, together = lines.slice(at, step), out.inside == in_.inside
        if out.some and in_.some and together and not out.inside:
            marks = _Marks(run)
            if marks.regular:
                out.inside = in_.inside = marks.inside
                at += len(run)
                continue
            step = LINES_OF_ODD_RUNS
            run = lines.slice(at, step)
        elif out.some and not out.inside and in_.inside and in_.leading and not pc.any(pc.match_substring(lines.slice(at), '"')).as_py():
            return  # without a quote, the field that may be open stays open
        else:
            run = lines.slice(at, 1)
        for t in _decoded(run):
            same, inside = out.inside == in_.inside, ends_inside(t, out.inside)  # once both agree, they stay together
            if in_ is not out:
                in_.add(t, inside if same else ends_inside(t, in_.inside))
            out.add(t, inside)
        at += len(run)


def block_ends(lines: DataFrame) -> DataFrame:
    """One row per block of (file, block, value) lines: how it ends, from outside and from inside a quoted field."""
    def run(batches):
        now, pair, valid = None, None, True

        def row():
            out, in_ = pair
            return pa.RecordBatch.from_pylist([{
                "file": now[0], "block": now[1], "outside": out.inside, "inside": in_.inside, "some_outside": out.some,
                "some_inside": in_.some, "valid": valid}])

        for file, block, values in _blocks(batches):
            if now != (file, block):
                if now:
                    yield row()
                now, valid = (file, block), True
                pair = (_End(False), _End(True)) if block else (_End(False),) * 2  # a file begins outside
                if not block:
                    values = _without_mark(values)
            valid = valid and _is_utf8(values)
            if valid:
                _read_ends(*pair, values)
        if now:
            yield row()

    return lines.mapInArrow(run, _ENDS)


def block_starts(ends: DataFrame) -> DataFrame:
    """(file, block, inside, header, valid, open): whether the block begins, and the file ends, inside a quoted field.

    ``header`` is the file's first block with a record.
    """
    blocks = F.array_sort(F.collect_list(F.struct("block", "outside", "inside", "some_outside", "some_inside")))
    first = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("long").alias("header"),
                     F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("starts"))

    def step(acc, b):
        some = F.when(acc["inside"], b["some_inside"]).otherwise(b["some_outside"])
        return F.struct(F.when(acc["inside"], b["inside"]).otherwise(b["outside"]).alias("inside"),
                        F.coalesce(acc["header"], F.when(some, b["block"])).alias("header"),
                        F.array_append(acc["starts"], F.struct(b["block"].alias("block"), acc["inside"].alias("inside"))).alias("starts"))

    per = ends.groupBy("file").agg(blocks.alias("b"), F.bool_and("valid").alias("valid"))
    folded = per.select("file", "valid", F.aggregate("b", first, step).alias("f"))
    return folded.select("file", "valid", F.col("f.header").alias("header"), F.col("f.inside").alias("open"), F.inline("f.starts"))


class _Parser:
    """The records of one block, as batches of rows."""

    def __init__(self, file: str, block: int, inside: bool, header: bool):
        self.file, self.block, self.header = file, block, header
        self.inside, self.leading, self.number = inside, inside, 0
        self.tail, self.open, self.ready = [], [], []

    def _row(self, cells: list[str]) -> dict | None:
        fields = clean(cells, self.header and not self.number)
        if fields is None:
            return None
        self.number += 1
        return {"file": self.file, "line_id": self.block + self.number - 1, "is_header": self.header and self.number == 1, "fields": fields}

    def _rows(self) -> list[pa.RecordBatch]:
        rows = [r for r in map(self._row, _cells(self.ready)) if r] if self.ready else []
        self.ready = []
        return [pa.RecordBatch.from_pylist(rows, _SCHEMA)] if rows else []

    def _data_rows(self, fields: pa.Array) -> pa.RecordBatch:
        n, first = len(fields), self.block + self.number
        self.number += n
        given = {"file": pa.repeat(self.file, n), "line_id": pa.array(np.arange(first, first + n)),
                 "is_header": pa.repeat(False, n), "fields": fields}
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def _line(self, line: str) -> None:
        self.inside = ends_inside(line, self.inside)
        if self.leading:
            self.tail.append(line)
            self.leading = self.inside
        else:
            self.open.append(line)
            if not self.inside:
                self.ready += self.open
                self.open = []

    def add(self, lines: pa.Array) -> list[pa.RecordBatch]:
        out, at, step = [], 0, len(lines)
        while at < len(lines):
            if self.header and not self.number:
                out += self._rows()
            if self.inside or (self.header and not self.number):
                run = lines.slice(at, 1)
            else:
                run = lines.slice(at, step)
                marks = _Marks(run)
                if marks.regular:
                    out += self._rows()
                    taken, fields = marks.records()
                    out.append(self._data_rows(fields))
                    run = run.slice(taken, 1)  # begins the record that is open at the end, if any
                    at += taken
                else:
                    step = LINES_OF_ODD_RUNS
                    run = lines.slice(at, step)
            for line in _decoded(run):
                self._line(line)
            at += len(run)
            if len(self.ready) >= LINES_AT_ONCE:
                out += self._rows()
        return out

    def close(self) -> list[pa.RecordBatch]:
        out, rest = self._rows(), []
        if self.tail:
            rest.append({"file": self.file, "block": self.block, "part": TAIL, "text": "\n".join(self.tail)})
        if self.open:
            rest.append({"file": self.file, "line_id": self.block + self.number, "is_header": self.header and not self.number,
                         "block": self.block, "part": HEAD, "text": "\n".join(self.open)})
        return out + ([pa.RecordBatch.from_pylist(rest, _SCHEMA)] if rest else [])


def clean(cells: list[str], is_header: bool) -> list[str | None] | None:
    """The cells of a record, None if it is blank: headers lose blank cells at the end, empty data cells are null."""
    if not any(c.strip() for c in cells):
        return None
    if not is_header:
        return [c if c else None for c in cells]
    while not cells[-1].strip():
        cells.pop()
    return cells


def records(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, block, value) lines of whole files -> the ``lines`` table of :mod:`adlens.sources.reports`.

    ``files`` names all files; those without any line are empty.

    ``line_id`` grows along a file: the block's first byte and the number of the record in the block.
    The lines are read twice: for where blocks begin (written, a row per block) and for the records;
    once more only for files with a record that spans blocks or is open at the end.
    """
    spark = lines.sparkSession
    starts = materialize(block_starts(block_ends(lines)), "block-starts")
    # blocks that begin otherwise than outside quotes, with the header in the first one: a small part of all blocks
    usual = F.col("valid") & ~F.col("inside") & F.col("header").isNotNull() & ((F.col("header") == 0) | (F.col("block") > F.col("header")))
    odd = {(r["file"], r["block"]): (r["inside"], r["header"] is not None and r["block"] == r["header"], r["valid"])
           for r in starts.where(~F.coalesce(usual, F.lit(False))).collect()}
    known = spark.sparkContext.broadcast(odd)
    # files with fragments of records: a small part of all files
    broken = {r["file"] for r in starts.where(F.col("valid") & (F.col("inside") | F.col("open"))).select("file").distinct().collect()}
    parts_of = spark.sparkContext.broadcast(broken)

    def run_broken(batches):
        return run(b.filter(pa.array([f in parts_of.value for f in b.column("file").to_pylist()], pa.bool_())) for b in batches)

    def run(batches):
        now, parser = None, None
        pending: list[pa.RecordBatch] = []
        for file, block, values in _blocks(batches):
            if now != (file, block):
                if parser:
                    pending += parser.close()
                inside, header, valid = known.value.get((file, block), (False, block == 0, True))
                now, parser = (file, block), _Parser(file, block, inside, header) if valid else None
                if not block:
                    values = _without_mark(values)
            if parser:
                pending += parser.add(values)
            if sum(x.num_rows for x in pending) >= LINES_AT_ONCE:
                yield pa.concat_batches(pending)
                pending = []
        if parser:
            pending += parser.close()
        if pending:
            yield pa.concat_batches(pending)

    parsed = lines.mapInArrow(run, _PARSED)
    names = ("file", "line_id", "is_header", "fields", "problem")
    out = parsed.where("part IS NULL").select(*names)
    if broken:
        out = out.unionByName(_spanning(lines.mapInArrow(run_broken, _PARSED).where("part IS NOT NULL")))
    failed = starts.where(~F.col("valid") | F.col("header").isNull()).groupBy("file").agg(F.bool_and("valid").alias("valid"))
    if files is not None:
        failed = failed.unionByName(files.join(starts, "file", "left_anti").withColumn("valid", F.lit(True)))
    return out.unionByName(failed.select("file", F.lit(0).cast("long").alias("line_id"), F.lit(True).alias("is_header"),
                                         F.array().cast("array<string>").alias("fields"),
                                         F.when(F.col("valid"), F.lit("empty file")).otherwise(F.lit("not UTF-8 text")).alias("problem")))


def _spanning(parts: DataFrame) -> DataFrame:
    """The records whose lines lie in several blocks."""
    order = Window.partitionBy("file").orderBy("block", "part")
    numbered = parts.withColumn("record", F.sum("part").over(order))  # every open record begins a new number
    whole = numbered.groupBy("file", "record").agg(
        F.max("line_id").alias("line_id"), F.coalesce(F.bool_or("is_header"), F.lit(False)).alias("is_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"]), "\n").alias("text"))

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                *lines, last = r["text"].split("\n")
                for k, cells in enumerate(csv.reader([x + "\n" for x in lines] + [last])):  # the last may be open
                    fields = clean(cells, r["is_header"] and not k)
                    if fields:
                        rows.append({"file": r["file"], "line_id": r["line_id"], "is_header": r["is_header"] and not k, "fields": fields})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_SCHEMA)[:5]))

    return whole.mapInArrow(run, LINES)
