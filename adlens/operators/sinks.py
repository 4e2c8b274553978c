"""Tables and reports of many scopes in few files, with a manifest that says where each scope is.

One folder for every advertiser or file path makes more folders than a file system likes.
Rows are dealt to hash buckets of the scope instead, in scope order inside a bucket, and one
job writes all of them. The manifest has a row per scope: its bucket, the place of its first
row there and how many it has; a reader of one scope opens one bucket.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKETS = 32


def bucket_of(*values: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*(v.cast("string") for v in values)), F.lit(buckets)).cast("int")


def _ordered(df: DataFrame, scope: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    keyed = df.withColumn("bucket", bucket_of(*(F.col(k) for k in scope), buckets=buckets))
    return keyed.repartition("bucket").sortWithinPartitions("bucket", *scope, *order)


def manifest(df: DataFrame, scope: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(scope..., bucket, first, rows) of every scope of ``df``."""
    per = df.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows")).withColumn("bucket", bucket_of(*(F.col(k) for k in scope), buckets=buckets))
    before = Window.partitionBy("bucket").orderBy(*scope).rowsBetween(Window.unboundedPreceding, -1)  # a row per scope
    return per.select(*scope, "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows")


def write_scoped(df: DataFrame, path: str, scope: Sequence[str], order: Sequence[str] = (), text: str | None = None,
                 buckets: int = BUCKETS) -> None:
    """Write ``df`` below ``path``: ``rows`` by bucket (as Parquet, or the column ``text`` as lines) and ``manifest``.

    The manifest is written last, so readers that start from it never see half a table.
    """
    ordered = _ordered(df, scope, order, buckets)
    if text:
        ordered.select(F.col(text).alias("value"), "bucket").write.mode("overwrite").partitionBy("bucket").text(f"{path}/rows")
    else:
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    manifest(df, scope, buckets).write.mode("overwrite").parquet(f"{path}/manifest")


def read_scoped(spark: SparkSession, path: str, **scope) -> DataFrame:
    """The rows of one scope of a Parquet table of :func:`write_scoped`; one bucket is read."""
    found = F.lit(True)
    for k, v in scope.items():
        found = found & F.col(k).eqNullSafe(F.lit(v))
    at = spark.read.parquet(f"{path}/manifest").where(found).select("bucket").first()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("bucket") == (at["bucket"] if at else -1)).where(found).drop("bucket")
