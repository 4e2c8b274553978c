"""Helpers shared by the training-data operators: written tables, binary record files."""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlens.session import checkpoint_dir

#: Upper bound of the text bytes that one call of an in-task helper works on.
CHUNK_CHARS = 1 << 20
#: More partitions of one shuffle than this for each core only add overhead.
PARTITIONS_PER_CORE = 16


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/adlens-tables/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back (survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_path`."""
    if "/adlens-tables/llm-" not in path:
        raise ValueError(f"not a folder of this module: {path}")
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions of about ``rows_each`` rows, but not more than the cluster has use for."""
    useful = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    return max(1, min(math.ceil(rows / rows_each), useful))


def hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def write_records(df: DataFrame, column: str, path: str, records_per_file: int, compression: str = "none") -> None:
    """Write one binary record per row: its length (unsigned 32-bit little-endian), the bytes, a line feed.

    Spark's own text sink and commit protocol write the bytes, so any file system Spark
    knows will do and a retried task leaves no half file. A file holds at most
    ``records_per_file`` records, so readers that take whole files stay bounded.
    """
    (df.select(F.col(column).cast("string").alias("value"))
       .write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file)
       .option("compression", compression).text(path))


def framed(body: bytes) -> bytes:
    return struct.pack("<I", len(body)) + body


def records(content: bytes):
    """The records of one file written by :func:`write_records` (of framed bytes)."""
    at, view = 0, memoryview(content)
    while at < len(content):
        n, = struct.unpack_from("<I", content, at)
        body = view[at + 4:at + 4 + n]
        if len(body) != n or content[at + 4 + n:at + 5 + n] != b"\n":
            raise ValueError("cut-off record")
        yield body
        at += n + 5


def column_chunks(column, limit: int = CHUNK_CHARS):
    """(first position, texts) of runs of an Arrow string column of about ``limit`` bytes at most, one text at least.

    Only one run at a time becomes Python strings; a null is an empty text.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def text_chunks(texts, limit: int = CHUNK_CHARS):
    """Runs of consecutive positions whose texts hold about ``limit`` characters at most (one at least)."""
    run, size = [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += n
    if run:
        yield run
