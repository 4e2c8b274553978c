"""File-inventory operators: completed downloads, latest files, retention plan.

Input is a file-metadata table (path, length, modificationTime) — e.g. the
``binaryFile`` listing of ``sources.reports.list_files`` with the content column
pruned — so the same code plans over millions of files without reading them.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlens.constants import (PARTIAL_DOWNLOAD_SUFFIXES, REPORT_DOWNLOAD_SUFFIXES, RETENTION_DAYS,
                              RETENTION_SUFFIXES)
from adlens.functions.columns import ntz_lit

MB = 1024.0 * 1024.0


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def completed_downloads(files: DataFrame, after: dt.datetime | None = None, include_demo: bool = False) -> DataFrame:
    """Report downloads that finished: report suffix (any case), not partial, non-empty,
    modified at/after ``after``, not ``demo_*`` unless asked."""
    name = _name(F.col("path"))
    suf = F.lower(_suffix(name))
    cond = suf.isin(REPORT_DOWNLOAD_SUFFIXES) & ~suf.isin(PARTIAL_DOWNLOAD_SUFFIXES) & (F.col("length") > 0)
    if after is not None:
        cond = cond & (F.col("modificationTime").cast("timestamp_ntz") >= ntz_lit(after))
    if not include_demo:
        cond = cond & ~F.lower(name).startswith("demo_")
    return files.where(cond).select("path", name.alias("name"), "length", "modificationTime")


def newest_downloads(files: DataFrame, n: int = 20, **options) -> DataFrame:
    """The ``n`` newest of :func:`completed_downloads`, newest first (ties by path)."""
    return completed_downloads(files, **options).orderBy(F.desc("modificationTime"), "path").limit(n)


def detection_cutoff(started_at: Column, watch_downloads_only: Column, lookback_minutes: Column) -> Column:
    """Download detection cutoff: the attempt start, or start − max(0, look-back) minutes."""
    back = F.greatest(lookback_minutes, F.lit(0))
    return F.when(watch_downloads_only, F.timestamp_add("MINUTE", -back, started_at)).otherwise(started_at)


def latest_files(files: DataFrame, group: Sequence[str], suffixes: Sequence[str] | None = None) -> DataFrame:
    """Latest modification time and its path per group (ties by path)."""
    df = files
    if suffixes:
        df = df.where(F.lower(_suffix(_name(F.col("path")))).isin([s.lower() for s in suffixes]))
    return df.groupBy(*group).agg(F.max("modificationTime").alias("latest_mtime"),
                                  F.max_by("path", F.struct("modificationTime", "path")).alias("latest_path"),
                                  F.count(F.lit(1)).alias("files"))


def evidence_rollup(files: DataFrame, group: Sequence[str]) -> DataFrame:
    """Count and size (MB) of existing output files per group."""
    return files.groupBy(*group).agg(F.count(F.lit(1)).alias("file_count"),
                                     (F.sum("length") / MB).alias("storage_mb"))


def _target_of(path: Column) -> Column:
    """Retention target whose folder (``.../data/<target>/...``) and suffix match the file."""
    name = _name(path)
    suf = _suffix(name)
    out = F.lit(None).cast("string")
    for target, sufs in reversed(list(RETENTION_SUFFIXES.items())):
        under = path.contains(f"data/{target}/") | path.startswith(f"{target}/")
        out = F.when(under & suf.isin(sufs), F.lit(target)).otherwise(out)
    return out


def retention_candidates(files: DataFrame, now: dt.datetime) -> DataFrame:
    """Files older than their target's retention limit (age in days, size in MB)."""
    limit = F.create_map(*[x for k, v in RETENTION_DAYS.items() for x in (F.lit(k), F.lit(v))])
    age = F.timestamp_diff("MICROSECOND", F.col("modificationTime").cast("timestamp_ntz"), ntz_lit(now)) \
        / 86_400_000_000.0
    t = files.select("path", "length", _target_of(F.col("path")).alias("target"), age.alias("age_days"))
    t = t.where(F.col("target").isNotNull()).withColumn("retention_days", limit[F.col("target")])
    return t.withColumn("due", F.col("age_days") > F.col("retention_days"))


def retention_plan(files: DataFrame, now: dt.datetime) -> DataFrame:
    """Per target and grand total (``target`` null): file count, MB, due count and due MB.

    Targets without files are reported with zeros (left join from the fixed target list).
    """
    cand = retention_candidates(files, now)
    rolled = cand.rollup("target").agg(
        F.count(F.lit(1)).alias("file_count"), (F.sum("length") / MB).alias("storage_mb"),
        F.count_if("due").alias("delete_candidate_count"),
        F.coalesce(F.sum(F.when(F.col("due"), F.col("length"))) / MB, F.lit(0.0)).alias("delete_candidate_mb"),
        F.grouping("target").alias("_total"))
    spark = files.sparkSession
    targets = spark.createDataFrame([(k, v) for k, v in RETENTION_DAYS.items()], "target string, retention_days int")
    per = targets.join(rolled.where(F.col("_total") == 0), "target", "left")
    total = rolled.where(F.col("_total") == 1).select(F.lit(None).cast("string").alias("target"),
                                                      F.lit(None).cast("int").alias("retention_days"),
                                                      "file_count", "storage_mb", "delete_candidate_count",
                                                      "delete_candidate_mb")
    per = per.select("target", "retention_days", "file_count", "storage_mb", "delete_candidate_count",
                     "delete_candidate_mb")
    out = per.unionByName(total).fillna({"file_count": 0, "storage_mb": 0.0, "delete_candidate_count": 0,
                                         "delete_candidate_mb": 0.0})
    before = F.date_sub(F.lit(now.date()), F.col("retention_days"))
    return out.withColumn("delete_before", F.when(F.col("retention_days").isNotNull(), before))
