"""Attaching per-scope statistics (one row per scope) back to detail rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def attach(df: DataFrame, stats: DataFrame, scope: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-scope ``stats`` onto ``df``.

    With a scope this is an equi-join on the scope keys; the planner broadcasts
    ``stats`` only when its measured size is under the broadcast threshold and
    AQE splits skewed scope partitions. With ``scope=[]`` ``stats`` is a global
    aggregate of exactly one row, attached as one scalar subquery (no join).
    """
    scope = list(scope)
    if scope:
        return df.join(stats, scope, how)
    cols = stats.columns
    packed = stats.select(F.struct(*cols).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])
