"""Registered streaming queries: run to completion over the events table, read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adlens.plans import oracle_sql as o
from adlens.plans.collection_queries import AS_OF, HEALTH, HEALTH_COLS, LOG_RAW, LOG_VIEW
from adlens.session import checkpoint_dir
from adlens.sources import tables
from adlens.streaming import watch


#: Files the events land in, one for each trigger, and triggers between compactions.
LANDED_FILES, COMPACT_EVERY = 6, 4


def _daily_kpi(spark, sf: str, scope):
    """The events land in shuffled order, so every trigger but the first brings rows of days long past."""
    events = tables.read_table(spark, sf, "events")
    landing = f"{checkpoint_dir(spark).rstrip('/')}/adlens-landing/{uuid.uuid4().hex}"
    events.repartition(LANDED_FILES, F.xxhash64("event_id")).write.parquet(landing)
    source = watch.stream_source(spark, landing, events.schema, max_files_per_trigger=1)
    log = watch.run_daily_kpi(tables.event_fact_from(source), scope, compact_every=COMPACT_EVERY)
    return watch.daily_table(log.read(), scope)


def stream_queries() -> dict:
    return {
        "stream_daily_kpi": lambda spark, sf: _daily_kpi(spark, sf, ()),
        "stream_daily_kpi_by_account": lambda spark, sf: _daily_kpi(spark, sf, ("account_name",)),
        # update mode: a trigger emits only the media that changed (upsert on read)
        "stream_media_health": lambda spark, sf: watch.streamed(
            lambda s: watch.media_health_stream(tables.collection_log_from(s), AS_OF), spark, sf, "events.parquet",
            "media_health", output_mode="update", key="media"),
    }


def stream_oracles() -> dict:
    return {
        # A stream over the whole table must equal the batch results.
        "stream_daily_kpi": o.period("daily", o.EVENT_FACT, "event_fact"),
        "stream_daily_kpi_by_account": o.period("daily", o.EVENT_FACT, "event_fact", ("account_name",)),
        "stream_media_health": f"WITH {LOG_RAW},\n{LOG_VIEW},\n{HEALTH}\nSELECT {HEALTH_COLS} FROM h",
    }
