"""Collection log: upsert-on-read, per-media health, channel status and freshness.

The log is append-only Parquet (``MERGE`` is not available on plain Parquet);
a re-recorded ``collection_id`` is resolved on read by keeping the row with the
highest ``ingest_seq`` (``max_by`` — a partial aggregate, so a hot id costs one
row per map task in the shuffle). Per-media health is one ``groupBy`` with
``max_by`` / filtered aggregates; nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import (FRESH_HOURS, STATUS_DISCONNECTED, STATUS_FRESH, STATUS_STALE, STATUS_WARN,
                              SUCCESS_WINDOW_DAYS, WARN_HOURS)
from adlens.functions.columns import ntz_lit

OFFSET_SUFFIX = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
MIN_TS = "0001-01-01 00:00:00"
NEEDS_CONNECTION = "needs_connection"
CONNECTED = "connected"


KST_OFFSET_MINUTES = 9 * 60  # Korea has no daylight saving time


def parse_log_time(c) -> Column:
    """ISO text -> TIMESTAMP_NTZ wall time in Korea; offset-free text is kept as is; bad -> null.

    Wall-clock arithmetic only (no session time zone involved): the offset is read
    from the text and the wall time moved to UTC+9.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c)
    has_offset = text.rlike(OFFSET_SUFFIX)
    off = F.regexp_extract(text, OFFSET_SUFFIX, 1)
    digits = F.regexp_replace(off, "[^0-9]", "")
    minutes = F.when(off == "Z", F.lit(0)).otherwise(
        F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    naive = F.regexp_replace(text, OFFSET_SUFFIX, "").try_cast("timestamp_ntz")
    shifted = F.timestamp_add("MINUTE", F.lit(KST_OFFSET_MINUTES) - minutes, naive)
    return F.when(has_offset, shifted).otherwise(text.try_cast("timestamp_ntz"))


def half_even_tenths(num: Column, den: Column) -> Column:
    """round(num / den, 1) with exact half-even rounding, from integer arithmetic."""
    scaled = num.cast("bigint") * 10
    q = F.floor(scaled / den).cast("bigint")
    rem = scaled - q * den
    up = (rem * 2 > den) | ((rem * 2 == den) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)) / 10.0


def log_view(raw: DataFrame) -> DataFrame:
    """Typed view of the raw log: media key, parsed times, event time, lower-case status."""
    started = parse_log_time("started_at")
    finished = parse_log_time("finished_at")
    return raw.select(
        "*",
        F.lower(F.trim(F.col("media"))).alias("media_key"),
        started.alias("started_ts"),
        finished.alias("finished_ts"),
        F.coalesce(finished, started).alias("event_ts"),
        F.lower(F.coalesce(F.col("status"), F.lit(""))).alias("status_l"),
    )


def append_log(records: DataFrame, path: str, seq: int | None = None) -> None:
    """Append attempt records to the Parquet log (upsert semantics come from ``resolve_latest``).

    ``ingest_seq`` orders re-recordings of the same ``collection_id``; by default it is
    the wall-clock microsecond of the append.
    """
    import time
    seq = seq if seq is not None else int(time.time() * 1_000_000)
    records.withColumn("ingest_seq", F.lit(seq).cast("bigint")).write.mode("append").parquet(path)


def resolve_latest(log: DataFrame, key: str = "collection_id", seq: str = "ingest_seq") -> DataFrame:
    """Read-side upsert: one row per ``key``, the one with the highest ``seq``."""
    others = [c for c in log.columns if c != key]
    packed = F.max_by(F.struct(*others), F.col(seq)).alias("_row")
    return log.groupBy(key).agg(packed).select(key, "_row.*")


def media_health(log: DataFrame, as_of: dt.datetime, window_days: int = SUCCESS_WINDOW_DAYS) -> DataFrame:
    """Per media: latest attempt, last success / failure, error of the latest, 30-day success rate.

    Blank media are dropped; the latest attempt is ordered by event time (finished,
    else started; unparseable last), ties by collection id.
    """
    v = log_view(log) if "media_key" not in log.columns else log
    v = v.where(F.col("media_key") != "")
    order_key = F.struct(F.coalesce(F.col("event_ts"), F.lit(MIN_TS).cast("timestamp_ntz")),
                         F.col("collection_id"))
    window_start = ntz_lit(as_of - dt.timedelta(days=window_days))
    in_window = F.coalesce(F.col("event_ts"), F.lit(MIN_TS).cast("timestamp_ntz")) >= window_start
    latest = F.max_by(F.struct(F.col("status_l").alias("status"), F.col("event_ts").alias("ts"),
                               F.coalesce(F.col("error_code"), F.lit("")).alias("error_code"),
                               F.coalesce(F.col("error_message"), F.lit("")).alias("error_message")), order_key)
    agg = v.groupBy("media_key").agg(
        latest.alias("_l"),
        F.max(F.when(F.col("status_l") == "success", F.col("event_ts"))).alias("last_success_at"),
        F.max(F.when(~F.col("status_l").isin("", "success"), F.col("event_ts"))).alias("last_failure_at"),
        F.count_if(in_window & (F.col("status_l") == "success")).alias("success_count_30d"),
        F.count_if(in_window).alias("total_count_30d"))
    return agg.select(
        F.col("media_key").alias("media"),
        F.col("_l.status").alias("latest_status"), F.col("_l.ts").alias("latest_finished_at"),
        "last_success_at", "last_failure_at",
        F.col("_l.error_code").alias("error_code"), F.col("_l.error_message").alias("error_message"),
        "success_count_30d", "total_count_30d",
        F.when(F.col("total_count_30d") > 0,
               half_even_tenths(F.col("success_count_30d") * 100, F.col("total_count_30d")))
        .alias("success_rate_30d"))


def latest_event_times(health: DataFrame) -> DataFrame:
    """Latest success and latest failure over all media (one row)."""
    return health.agg(F.max("last_success_at").alias("last_success_at"),
                      F.max("last_failure_at").alias("last_failure_at"))


def recent_logs(log: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most recent attempts by started-at text (ties by id): a top-k report."""
    return log.orderBy(F.desc("started_at"), F.desc("collection_id")).limit(n)


def freshness(last_at: Column, connected: Column, success: Column, as_of: dt.datetime) -> Column:
    """≤24 h fresh, ≤72 h warn, else stale; not connected / failed / never -> disconnected."""
    age_h = F.timestamp_diff("MICROSECOND", last_at, ntz_lit(as_of)) / 3.6e9
    return (F.when(~connected | ~success | last_at.isNull(), F.lit(STATUS_DISCONNECTED))
            .when(age_h <= FRESH_HOURS, F.lit(STATUS_FRESH)).when(age_h <= WARN_HOURS, F.lit(STATUS_WARN))
            .otherwise(F.lit(STATUS_STALE)))


def channel_status(channels: DataFrame, health: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Apply the log to a channel registry.

    ``channels``: channel, display_order, connection, media_keys (ARRAY<STRING>, in
    priority order). The first key with log rows wins (``min_by`` over the exploded
    keys); a success sets connected/fresh-by-age, partial -> warn, otherwise
    disconnected, with the log's message, code or a default as the reason.
    """
    keys = channels.select("channel", F.posexplode("media_keys").alias("key_pos", "media"))
    hits = keys.join(health, "media")
    best = hits.groupBy("channel").agg(F.min_by(F.struct(*[F.col(c) for c in health.columns]), F.col("key_pos"))
                                       .alias("h"))
    j = channels.join(best, "channel", "left")
    c = F.col
    has = c("h").isNotNull()
    st = c("h.latest_status")
    ok = has & (st == "success")
    connection = F.when(ok, F.lit(CONNECTED)).otherwise(c("connection"))
    success = F.when(has, ok).otherwise(F.lit(False))
    last_at = F.when(ok, F.coalesce(c("h.last_success_at"), c("h.latest_finished_at"))) \
        .when(has, c("h.last_success_at")).otherwise(F.lit(None).cast("timestamp_ntz"))
    msg = F.nullif(F.trim(c("h.error_message")), F.lit(""))
    code = F.nullif(F.trim(c("h.error_code")), F.lit(""))
    reason = (F.when(~has, F.lit("no collection log"))
              .when(ok, F.lit("-"))
              .when(st == "partial", F.coalesce(msg, F.lit("only part of the data was collected")))
              .when(st == "no_data", F.coalesce(msg, F.lit("no data collected for the period")))
              .otherwise(F.coalesce(msg, code, F.lit("latest collection failed"))))
    override = (F.when(has & ~ok & (st == "partial"), F.lit(STATUS_WARN))
                .when(has & ~ok, F.lit(STATUS_DISCONNECTED)))
    out = j.select(
        "channel", "display_order", connection.alias("connection"), success.alias("success"),
        last_at.alias("last_at"), c("h.latest_finished_at").alias("last_check_at"),
        F.when(has, F.when(c("h.success_rate_30d").isNotNull(),
                           F.concat(F.format_number(c("h.success_rate_30d"), 1), F.lit("%")))
               .otherwise(F.lit("no record"))).otherwise(F.lit("no record")).alias("success_rate"),
        reason.alias("failure_reason"), override.alias("_override"))
    status = F.coalesce(c("_override"), freshness(c("last_at"), c("connection") != NEEDS_CONNECTION, c("success"),
                                                  as_of))
    return out.withColumn("status", status).drop("_override")


def overall_status(status: DataFrame, log_times: DataFrame | None = None) -> DataFrame:
    """One row: overall status, latest success / failure time, failure digest.

    all disconnected -> disconnected; any connected stale -> stale; any connected warn
    or any disconnected -> warn; all connected fresh -> fresh; else warn.
    """
    c = F.col
    connected = c("connection") != NEEDS_CONNECTION
    failing = status.where(~c("success")).select(
        "display_order", F.concat(c("channel"), F.lit(": "), c("failure_reason")).alias("line"))
    w = Window.orderBy("display_order")  # bounded: one row per registered channel
    firsts = failing.withColumn("_rk", F.row_number().over(w))
    digest = firsts.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("_rk") <= 2, F.struct("_rk", "line")))),
                                 lambda s: s["line"]), " / ").alias("first2"))
    agg = status.agg(
        F.bool_and(c("status") == STATUS_DISCONNECTED).alias("all_disc"),
        F.coalesce(F.bool_or(connected & (c("status") == STATUS_STALE)), F.lit(False)).alias("any_stale"),
        F.coalesce(F.bool_or(connected & (c("status") == STATUS_WARN)), F.lit(False)).alias("any_warn"),
        F.coalesce(F.bool_or(c("status") == STATUS_DISCONNECTED), F.lit(False)).alias("any_disc"),
        F.coalesce(F.bool_and(F.when(connected, c("status") == STATUS_FRESH)), F.lit(True)).alias("all_fresh"),
        F.max(F.when(c("success"), c("last_at"))).alias("ch_success"),
        F.max(F.when(~c("success"), c("last_check_at"))).alias("ch_failure"))
    overall = (F.when(c("all_disc"), F.lit(STATUS_DISCONNECTED)).when(c("any_stale"), F.lit(STATUS_STALE))
               .when(c("any_warn") | c("any_disc"), F.lit(STATUS_WARN)).when(c("all_fresh"), F.lit(STATUS_FRESH))
               .otherwise(F.lit(STATUS_WARN)))
    d = digest.select(F.struct("n", "first2").alias("d")).scalar()
    res = agg.select(overall.alias("overall_status"), "ch_success", "ch_failure", d.alias("d"))
    if log_times is not None:
        lt = log_times.select(F.struct("last_success_at", "last_failure_at").alias("t")).scalar()
        res = res.withColumn("t", lt)
        succ = F.greatest(c("ch_success"), c("t.last_success_at"))
        fail = F.greatest(c("ch_failure"), c("t.last_failure_at"))
    else:
        succ, fail = c("ch_success"), c("ch_failure")
    reason = (F.when(c("d.n") == 0, F.lit("-"))
              .when(c("d.n") > 2, F.concat(c("d.first2"), F.lit(" (+"), (c("d.n") - 2).cast("string"),
                                           F.lit(" more)")))
              .otherwise(c("d.first2")))
    return res.select("overall_status", succ.alias("last_success_at"), fail.alias("last_failure_at"),
                      reason.alias("failure_reason"))


def needs_attention(status: DataFrame) -> DataFrame:
    return status.where(F.col("status").isin(STATUS_WARN, STATUS_STALE, STATUS_DISCONNECTED))


# --- collection step results ------------------------------------------------------

def step_verdicts(steps: DataFrame, required: Sequence[str], group: str = "media") -> DataFrame:
    """Per media: required-step pivot, verdict and reason, first three distinct failures.

    ``steps``: media, seq, step, status ('success' | 'failed' | 'blocked'), detail.
    verdict: every required step succeeded -> validated; any success -> partial;
    else conditional. reason: first blocker, else first failure, else a default.
    """
    c = F.col
    ok = c("status") == "success"
    pivots = [F.coalesce(F.bool_or((c("step") == s) & ok), F.lit(False)).alias(f"ok_{s}") for s in required]
    agg = steps.groupBy(group).agg(
        *pivots,
        F.count_if(ok).alias("success_steps"),
        F.min_by(c("detail"), F.when(c("status") == "blocked", c("seq"))).alias("_blocker"),
        F.min_by(c("detail"), F.when(c("status") == "failed", c("seq"))).alias("_failure"))
    all_ok = F.lit(True)
    for s in required:
        all_ok = all_ok & c(f"ok_{s}")
    verdict = (F.when(all_ok, F.lit("validated")).when(c("success_steps") > 0, F.lit("partial"))
               .otherwise(F.lit("conditional")))
    reason = F.coalesce(c("_blocker"), c("_failure"), F.lit("verify with a real account first"))
    distinct_fail = (steps.where(c("status").isin("failed", "blocked")).groupBy(group, "detail")
                     .agg(F.min("seq").alias("first_seq")))
    w = Window.partitionBy(group).orderBy("first_seq", "detail")
    top3 = (distinct_fail.withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= 3)
            .groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "detail"))),
                                                         lambda s: s["detail"]), " / ").alias("failure_digest")))
    out = agg.select(group, *[f"ok_{s}" for s in required], all_ok.alias("required_ok"), verdict.alias("verdict"),
                     reason.alias("reason"))
    return out.join(top3, group, "left")


def classify_api_run(stats_status: Column, response_rows: Column, zero_guard: Column, pipeline_status: Column,
                     report_status: Column) -> Column:
    """API collection run -> failed / no_data / success / partial."""
    return (F.when(stats_status.isNull() | stats_status.isin("failed", "blocked"), F.lit("failed"))
            .when((response_rows == 0) | zero_guard, F.lit("no_data"))
            .when((pipeline_status == "success") & (report_status == "success"), F.lit("success"))
            .otherwise(F.lit("partial")))


def classify_file_run(detected_files: Column, pipeline_status: Column, audit_status: Column) -> Column:
    """File (download) collection run -> success / partial / failed."""
    return (F.when((detected_files > 0) & (pipeline_status == "success"), F.lit("success"))
            .when((detected_files > 0) & (audit_status == "success"), F.lit("partial"))
            .otherwise(F.lit("failed")))


def connection_reasons(evidence: DataFrame, fallback: str = "awaiting verification") -> DataFrame:
    """Per media: the reason text implied by its latest evidence document.

    ``evidence``: media, modificationTime, payload (JSON with final_status,
    error_code, error_message, detail, status). Ordered rules: blocked environment,
    needs authentication, no data, download missing, the document's own message,
    failed on network denial, failed, else the fallback.
    """
    latest = evidence.groupBy("media").agg(
        F.max_by("payload", F.struct("modificationTime", "payload")).alias("payload"))
    p = F.from_json(F.col("payload"), "map<string,string>")

    def g(k: str) -> Column:
        return F.coalesce(p[k], F.lit(""))

    reason = (F.when((g("final_status") == "blocked_by_environment") | (g("error_code") == "NETWORK_ACCESS_DENIED"),
                     F.lit("ad centre blocked from this environment; re-check from a permitted browser"))
              .when(g("final_status") == "needs_user_authentication", F.lit("user login or authentication needed"))
              .when(g("final_status") == "no_data", F.lit("no ad data for the selected period"))
              .when(g("error_code") == "DOWNLOAD_FILE_NOT_FOUND", F.lit("download file not detected"))
              .when(g("error_message") != "", g("error_message"))
              .when((g("status") == "failed") & g("detail").contains("ERR_NETWORK_ACCESS_DENIED"),
                    F.lit("network access denied on this machine; re-check after authentication"))
              .when(g("status") == "failed", F.lit("ad centre connection check needed"))
              .otherwise(F.lit(fallback)))
    return latest.select("media", reason.alias("reason"))


def data_freshness(fact: DataFrame, today: dt.date, scope: Sequence[str] = ()) -> DataFrame:
    """Last data day, lag in days (≥ 0) and fresh (≤ 1) / warn (≤ 7) / stale, plus undated rows."""
    from adlens.constants import FRESH_LAG_DAYS, WARN_LAG_DAYS
    b = fact.groupBy(*scope).agg(F.min("date").cast("date").alias("min_date"),
                                 F.max("date").cast("date").alias("max_date"),
                                 F.count_if(F.col("date").isNull()).alias("undated_rows"))
    lag = F.greatest(F.datediff(F.lit(today), F.col("max_date")), F.lit(0))
    status = (F.when(F.col("max_date").isNull(), F.lit(None).cast("string"))
              .when(lag <= FRESH_LAG_DAYS, F.lit(STATUS_FRESH)).when(lag <= WARN_LAG_DAYS, F.lit(STATUS_WARN))
              .otherwise(F.lit(STATUS_STALE)))
    return b.select(*scope, "min_date", "max_date", lag.alias("lag_days"), status.alias("freshness"), "undated_rows")


def whitelist_status(status: Column) -> Column:
    """Unknown log statuses are recorded as failed."""
    s = F.lower(F.trim(status))
    return F.when(s.isin("success", "partial", "no_data", "failed"), s).otherwise(F.lit("failed"))


def normalise_date_ranges(requests: DataFrame, today: dt.date, start: str = "raw_start",
                          end: str = "raw_end") -> DataFrame:
    """Collection date-range requests -> (start_date, end_date, source, warnings).

    Both blank -> the previous 30 days ending yesterday. A missing side copies the
    other; reversed sides swap; an end after yesterday is clamped to yesterday;
    a range entirely in the future collapses to yesterday. Unparseable text is
    ignored with a warning.
    """
    c = F.col
    ds, de = F.trim(F.coalesce(c(start), F.lit(""))), F.trim(F.coalesce(c(end), F.lit("")))
    ps = F.when(ds != "", F.try_to_date(ds, "yyyy-M-d"))
    pe = F.when(de != "", F.try_to_date(de, "yyyy-M-d"))
    d_end = F.lit(today - dt.timedelta(days=1))
    d_start = F.lit(today - dt.timedelta(days=30))
    s1, e1 = F.coalesce(ps, pe), F.coalesce(pe, ps)
    swap = s1 > e1
    s2 = F.when(swap, e1).otherwise(s1)
    e2 = F.when(swap, s1).otherwise(e1)
    clamp = e2 > d_end
    e3 = F.when(clamp, d_end).otherwise(e2)
    future = s2 > e3
    s3 = F.when(future, e3).otherwise(s2)
    use_default = ps.isNull() & pe.isNull()
    warnings = F.array_compact(F.array(
        F.when((ds != "") & ps.isNull(), F.lit("invalid_start")),
        F.when((de != "") & pe.isNull(), F.lit("invalid_end")),
        F.when(~use_default & ps.isNull(), F.lit("start_missing")),
        F.when(~use_default & pe.isNull(), F.lit("end_missing")),
        F.when(~use_default & swap, F.lit("swapped")),
        F.when(~use_default & clamp, F.lit("end_clamped")),
        F.when(~use_default & future, F.lit("all_future"))))
    return requests.select(
        "*",
        F.when(use_default, d_start).otherwise(s3).alias("start_date"),
        F.when(use_default, d_end).otherwise(e3).alias("end_date"),
        F.when(use_default, F.lit("default_30_days")).otherwise(F.lit("requested")).alias("range_source"),
        warnings.alias("warnings"))
