"""Folders of raw media reports with differing header layouts, as one ``lines`` table.

``lines``: (file STRING, line_id BIGINT, is_header BOOLEAN, fields ARRAY<STRING>, problem STRING).
Every file keeps its own header line, so thousands of files with different
layouts are mapped and standardised in one job (see ``operators.audit``). A file that is
empty or can't be read is one header line without fields that names the problem.
"""

from __future__ import annotations

import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.session import few_listing_tasks
from adlens.sources import csv_blocks
from adlens.sources.tables import read_table

DATA_SUFFIXES = ["csv", "txt", "tsv"]


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive file listing (path, name, length, modificationTime); file content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", any_case(glob))
    df = reader.load(root)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "modificationTime")


def any_case(glob: str) -> str:
    """A file glob whose letters match either case (suffixes are written ``.csv`` and ``.CSV``)."""
    out, in_class = "", False
    for c in glob:
        in_class = c == "[" or (in_class and c != "]")
        out += f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() and not in_class else c
    return out


def _numbered(text: DataFrame) -> DataFrame:
    """(file, block, value): the lines as bytes, with their file and the first byte of the block they were read in."""
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("value"))


def read_report_lines(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Read every matching CSV under ``root`` (recursively, whatever the case of the name) into the ``lines`` table.

    Large files are read in blocks by many tasks (:mod:`adlens.sources.csv_blocks`).
    """
    with few_listing_tasks(spark):
        text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(glob)).option("lineSep", "\n").text(root)
    return csv_blocks.records(_numbered(text), _input_files(text))


def _input_files(text: DataFrame) -> DataFrame:
    """(file) of every file of a scan, as its listing has them: those without a byte, which no task reads, too."""
    files = [(path_of(uri),) for uri in text.inputFiles()]
    return text.sparkSession.createDataFrame(files, "file string")


def path_of(uri: str) -> str:
    """A file's URI as ``_metadata.file_path`` writes it: without the slashes of an empty authority."""
    return re.sub("^([^:/]+):///", r"\1:/", uri)


def stream_report_text(spark: SparkSession, root: str, glob: str, **options) -> DataFrame:
    """A stream of the lines of new files, for :func:`lines_of_text` of each micro-batch."""
    reader = spark.readStream.format("text").option("pathGlobFilter", any_case(glob)).option("lineSep", "\n")
    for key, value in options.items():
        reader = reader.option(key, value)
    return _numbered(reader.load(root))


def lines_of_text(text: DataFrame) -> DataFrame:
    """The ``lines`` table of a micro-batch of :func:`stream_report_text`; files arrive whole."""
    return csv_blocks.records(text)


# Four header layouts used by the derived report folder (index = supplier key % 4).
LAYOUTS = [
    ["date", "platform", "account_name", "campaign_name", "ad_group_name", "keyword", "product_name", "impressions",
     "clicks", "cost", "conversions", "revenue", "orders"],
    ["일자", "광고매체", "계정명", "캠페인명", "광고그룹명", "검색어", "상품명", "노출수", "클릭수", "광고비", "전환수", "매출",
     "주문수", "장바구니", "광고ID"],
    ["day", "media", "advertiser", "campaign", "ad group", "impr", "clickz", "spend", "conversion", "ROAS", "order"],
    ["날짜", "매체", "광고주", "캠페인", "그룹", "키워드", "노출", "클릭", "비용", "전환", "매출액", "클릭률"],
]


def derived_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad fact split into one report file per supplier, rendered in four layouts.

    Layout 0 uses canonical headers; 1 Korean aliases plus a cart-count column and
    an id column; 2 English aliases without keyword, product and revenue (and a
    fuzzy 'clickz'); 3 files named after a marketplace with a blank media column
    and zero conversions.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    layout = (F.col("s_suppkey") % 4).cast("int")
    d = F.date_format("l_shipdate", "yyyy-MM-dd")
    impr = (F.col("l_quantity").cast("bigint") * 100).cast("string")
    clicks = (F.col("l_linenumber") + F.round(F.col("l_discount") * 100).cast("bigint")).cast("string")
    cost = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    conv = F.col("l_linenumber").cast("string")
    rev = (F.col("l_extendedprice") * F.round(F.col("l_tax") * 100)).cast("decimal(18,2)").cast("string")
    orders = F.col("l_linenumber").cast("string")
    prod = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    grp = F.concat_ws("/", "p_brand", "p_type")
    rows = {
        0: F.array(d, F.col("p_type"), F.col("s_name"), F.col("p_brand"), grp, F.col("p_name"), prod, impr, clicks,
                   cost, conv, rev, orders),
        1: F.array(d, F.col("p_type"), F.col("s_name"), F.col("p_brand"), grp, F.col("p_name"), prod, impr, clicks,
                   cost, conv, rev, orders, (F.col("l_linenumber") % 3).cast("string"),
                   F.col("l_orderkey").cast("string")),
        2: F.array(d, F.col("p_type"), F.col("s_name"), F.col("p_brand"), grp, impr, clicks, cost, conv,
                   F.lit("0%"), orders),
        3: F.array(d, F.lit(""), F.col("s_name"), F.col("p_brand"), grp, F.col("p_name"), impr, clicks, cost,
                   F.lit("0"), rev, F.lit("1.5%")),
    }
    fields = F.when(layout == 0, rows[0]).when(layout == 1, rows[1]).when(layout == 2, rows[2]).otherwise(rows[3])
    file = report_file_name(F.col("s_suppkey"))
    data = j.select(file.alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 1).alias("line_id"),
                    F.lit(False).alias("is_header"), fields.alias("fields"))
    heads_src = supp.select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("_lay"))
    head_fields = F.when(F.col("_lay") == 0, F.array(*[F.lit(h) for h in LAYOUTS[0]])) \
        .when(F.col("_lay") == 1, F.array(*[F.lit(h) for h in LAYOUTS[1]])) \
        .when(F.col("_lay") == 2, F.array(*[F.lit(h) for h in LAYOUTS[2]])) \
        .otherwise(F.array(*[F.lit(h) for h in LAYOUTS[3]]))
    heads = heads_src.select(report_file_name(F.col("s_suppkey")).alias("file"), F.lit(0).cast("bigint").alias("line_id"),
                             F.lit(True).alias("is_header"), head_fields.alias("fields"))
    return heads.unionByName(data).withColumn("problem", F.lit(None).cast("string"))


#: Folders that the files of :func:`write_lines` are dealt to.
FOLDERS = 32


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a ``lines`` table as CSV text below ``path``: one file of ordered lines per report, under the report's own name.

    Every cell is quoted, so cells may hold anything; a header without fields is a blank line. Tasks write
    the files themselves, each under a hidden name first: Spark's writer takes a folder for each report, and on
    a file system without Hadoop's native library it runs several processes to create one.
    """
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.when(F.size("fields") == 0, F.lit("")).when(  # cells without a quote are quoted all at once
        ~F.contains(F.array_join("fields", "", ""), F.lit('"')), F.concat(F.lit('"'), F.array_join("fields", '","', ""), F.lit('"'))).otherwise(
            F.array_join(F.transform("fields", cell), ","))
    rows = lines.select(F.substring_index("file", "/", -1).alias("name"), "line_id", F.concat(text, F.lit("\n")).alias("value"))
    ordered = rows.repartition("name").sortWithinPartitions("name", "line_id").select("name", "value")
    ordered.mapInArrow(_file_writer(path), "name string").write.format("noop").mode("overwrite").save()


def _file_writer(path: str):
    """A function of batches of (name, value) in order of ``name`` that writes the values of each name to a file."""
    def run(batches):
        fs, root = FileSystem.from_uri(path if path.startswith("/") else quote(path, safe=":/"))
        now = folder = hidden = out = None

        def finish():
            out.close()
            fs.move(hidden, f"{folder}/{now}")

        for b in batches:
            names, values = b.column(0), b.column(1).cast(pa.string())
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
            data, at = memoryview(values.buffers()[2] or b""), 0
            runs = pc.run_end_encode(names)
            for name, to in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != now:
                    if out:
                        finish()
                        yield pa.RecordBatch.from_pydict({"name": [now]})
                    now, folder = name, f"{root}/folder={zlib.crc32(name.encode()) % FOLDERS}"
                    fs.create_dir(folder)
                    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden)
                out.write(data[ends[at]:ends[to]])
                at = to
        if out:
            finish()
            yield pa.RecordBatch.from_pydict({"name": [now]})

    return run


def awkward_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`derived_report_lines` with the shapes that real folders have, by supplier key.

    Every fifth file has a blank line first; every fifth an unnamed column of quoted line
    breaks after its first; every fifth 70 further columns; every tenth has a blank twin.
    """
    lines = derived_report_lines(spark, sf_dir)
    key = F.regexp_extract("file", r"([0-9]+)\.csv$", 1).cast("long")
    more = F.array(*[F.lit(f"more {i}") for i in range(70)])
    fields = F.when(F.col("_key") % 5 == 1, F.concat(F.slice("fields", 1, 1), F.array(
        F.when(F.col("is_header"), F.lit("")).otherwise(F.lit('two\nlines, "quoted"'))),
        F.slice("fields", 2, 1000))).when(F.col("_key") % 5 == 2, F.concat("fields", more)).otherwise(F.col("fields"))
    heads = lines.filter("is_header")
    blank = heads.filter(key % 5 == 0).withColumns({"line_id": F.lit(-1).cast("long"), "fields": F.array().cast("array<string>")})
    twins = heads.filter(key % 10 == 3).withColumns({
        "file": F.concat(F.lit("blank_"), key.cast("string"), F.lit(".csv")), "fields": F.array().cast("array<string>")})
    return lines.withColumn("_key", key).withColumn("fields", fields).drop("_key").unionByName(blank).unionByName(twins)


def report_file_name(suppkey):
    lay = suppkey % 4
    return F.concat(F.lit("reports/"),
                    F.when(lay == 3, F.lit("gmarket_ads_")).when(lay == 1, F.lit("naver_ads_"))
                    .otherwise(F.lit("media_")), suppkey.cast("string"), F.lit(".csv"))
