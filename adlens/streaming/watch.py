"""Structured Streaming: watched report folders and incrementally maintained KPIs.

* ``watch_report_folder`` — a file-stream source over a landing folder; each
  micro-batch turns its new files into the ``lines`` table and runs the same
  standardisation, audit and analysis as batch (``foreachBatch``). The checkpoint records
  which files were processed and outputs are keyed by batch, so a restart neither skips nor
  repeats a file, even after a batch that failed half-way;
  ``once=True`` is ``trigger(availableNow=True)``; ``max_file_age`` ignores
  stale files.
* ``run_daily_kpi`` — per-day KPI table maintained as rows arrive, equal to the batch daily
  period table whatever order the days come in: each trigger appends partial sums per day to
  a ``KeyedLog``, so no watermark has to drop late rows and the stream keeps no state.
* ``media_health_stream`` — per-media health maintained with ``max_by`` /
  filtered aggregates in update mode.

Checkpoints and logs live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlens.constants import MEASURES
from adlens.functions.calendar import period_label
from adlens.functions.columns import with_rates
from adlens.operators.audit import file_audit, header_catalog_from_lines, standardize_lines
from adlens.operators.collection import log_view, media_health
from adlens.operators.ingest import map_headers
from adlens.session import checkpoint_dir, few_listing_tasks, materialize, scratch_tables
from adlens.sources.reports import lines_of_text, stream_report_text
from adlens.streaming.keyed_log import KeyedLog


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = checkpoint_dir(spark).rstrip("/")
    tag = f"{name}-{uuid.uuid4().hex}"
    return f"{base}/adlens-streams/{tag}", f"{base}/adlens-stream-out/{tag}"


def watch_report_folder(spark: SparkSession, in_dir: str, out_dir: str, glob: str = "*.csv", once: bool = True,
                        max_file_age: str | None = None, checkpoint: str | None = None,
                        processing_time: str = "30 seconds", max_files_per_trigger: int = 100, analysis: bool = True):
    """Stream new report files from ``in_dir``; write facts, audits and every file's whole analysis to ``out_dir``.

    Files arrive whole, so a file's header is its first line whatever its size. Everything a
    micro-batch writes lies under its own ``batch_id`` and replaces what an earlier try of
    that batch left, so a batch that failed half-way and runs again counts once. With
    ``analysis``, KPIs, anomalies, issues and the narrative of each of the trigger's files come
    from the same jobs, by file, below ``analysis/batch_id=...`` (``operators.sinks``).

    Returns the ``StreamingQuery`` (already finished when ``once``).
    """
    options = {"maxFilesPerTrigger": max_files_per_trigger} | ({"maxFileAge": max_file_age} if max_file_age else {})
    src = stream_report_text(spark, in_dir, glob, **options)
    ckpt = checkpoint or _paths(spark, "watch")[0]

    def process(batch: DataFrame, batch_id: int) -> None:
        with scratch_tables(spark):
            lines = materialize(lines_of_text(batch), "watch-lines")
            mapping = materialize(map_headers(header_catalog_from_lines(lines)), "watch-mapping")
            fact = standardize_lines(lines, mapping, keep_extras=True)
            fact.write.mode("overwrite").parquet(f"{out_dir}/standardized/batch_id={batch_id}")
            written = spark.read.parquet(f"{out_dir}/standardized/batch_id={batch_id}")
            file_audit(lines, with_issues=False, mapping=mapping, fact=written).write.mode("overwrite").parquet(
                f"{out_dir}/audit/batch_id={batch_id}")
            if analysis:
                from adlens.plans.batch_run import write_analysis
                write_analysis(written, mapping, f"{out_dir}/analysis/batch_id={batch_id}", ["file"])

    writer = src.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=processing_time)
    with few_listing_tasks(spark):  # every trigger lists the files it reads; a query keeps the settings it starts with
        query = writer.start()
    if once:
        query.awaitTermination()
    return query


def daily_partials(fact: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., day, first, last, rows, measure sums) of some rows; sums keep their exact types."""
    day = F.col("date").cast("date")
    return fact.where(F.col("date").isNotNull()).groupBy(*scope, day.alias("day")).agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("rows"),
        *[F.sum(m).alias(m) for m in MEASURES])


def merged_partials(partials: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per scope and day from several partial ones; the columns and their types stay."""
    kinds = dict(partials.dtypes)
    total = lambda c: F.sum(c).cast(kinds[c]).alias(c)
    return partials.groupBy(*scope, "day").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                               total("rows"), *[total(m) for m in MEASURES])


def daily_table(merged: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The daily period table from :func:`merged_partials`."""
    out = merged.select(*scope, period_label("daily", F.col("day")).alias("period_label"),
                        F.col("first").cast("date").alias("period_start"), F.col("last").cast("date").alias("period_end"), "rows",
                        *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in MEASURES])
    return with_rates(out)


def run_daily_kpi(stream_fact: DataFrame, scope: Sequence[str] = (), path: str | None = None, checkpoint: str | None = None,
                  compact_every: int = 20) -> KeyedLog:
    """Take in all that has arrived (``availableNow``); the log's rows are :func:`merged_partials` of everything so far.

    Days may come in any order and at any time. ``path`` and ``checkpoint`` name a log to go on with.
    """
    spark = stream_fact.sparkSession
    own_checkpoint, own_path = _paths(spark, "daily-kpi")
    log = KeyedLog(spark, path or own_path, [*scope, "day"], lambda rows: merged_partials(rows, scope), compact_every=compact_every)

    def sink(batch: DataFrame, batch_id: int) -> None:
        log.append(daily_partials(batch, scope), batch_id)

    query = (stream_fact.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or own_checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return log


def media_health_stream(stream_log: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Streaming per-media health over an append-only collection log."""
    return media_health(log_view(stream_log), as_of)


def run_to_table(stream_df: DataFrame, name: str, output_mode: str = "complete",
                 key: str | None = None) -> DataFrame:
    """Run a streaming aggregate to completion (availableNow) into Parquet; return it as a batch table.

    complete: each micro-batch carries the whole result and replaces the previous one.
    update (needs ``key``): each micro-batch carries only the groups that changed; they
    are appended with the batch id and the table is read back keeping the latest row
    per key (upsert on read), so a trigger's cost follows the changed groups only.
    """
    from adlens.operators.collection import resolve_latest
    spark = stream_df.sparkSession
    ckpt, out = _paths(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out)

    q = (stream_df.writeStream.outputMode(output_mode).foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    table = spark.read.parquet(out)
    if output_mode == "update" and key:
        table = resolve_latest(table, key=key, seq="_batch").drop("_batch")
    return table


def stream_source(spark: SparkSession, folder: str, schema, glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """File-stream source over a landing folder (optionally only files matching ``glob``)."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def streamed(build: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, glob: str,
             name: str, output_mode: str = "complete", key: str | None = None) -> DataFrame:
    """Apply ``build`` to a streaming read of ``folder/glob`` and materialise the final result."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{glob}").schema
    return run_to_table(build(stream_source(spark, folder, schema, glob)), name, output_mode, key)
