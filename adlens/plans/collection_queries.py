"""Registered collection-log queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from adlens.operators import collection as col
from adlens.session import checkpoint_dir
from adlens.sources import tables
from adlens.streaming.keyed_log import KeyedLog

# Clock used by the freshness / 30-day-window queries (an explicit parameter, never the wall clock).
AS_OF = dt.datetime(2024, 1, 31, 6, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 06:00:00'"
REQUIRED_STEPS = ["view", "click", "purchase"]


def _log(spark, sf):
    return tables.collection_log_raw(spark, sf)


def _recorded(spark, sf):
    """The log's records, and a re-run of every tenth as a success."""
    base = _log(spark, sf).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    rerun = (base.where(F.col("collection_id").cast("bigint") % 10 == 0)
             .withColumns({"status": F.lit("success"), "error_code": F.lit(""), "error_message": F.lit(""),
                           "ingest_seq": F.lit(1).cast("bigint")}))
    return base, rerun


def _upserted(spark, sf):
    """Append a re-run batch and resolve on read."""
    base, rerun = _recorded(spark, sf)
    return col.resolve_latest(base.unionByName(rerun))


def _compacted(spark, sf):
    """The same records appended in four batches (re-runs first) and compacted after the second and third."""
    base, rerun = _recorded(spark, sf)
    half = F.pmod(F.xxhash64("collection_id"), F.lit(2))
    log = KeyedLog(spark, f"{checkpoint_dir(spark).rstrip('/')}/adlens-logs/{uuid.uuid4().hex}", ["collection_id"],
                   col.resolve_latest, compact_every=None)
    for n, rows in enumerate((rerun, base.where(half == 0), base.where(half == 1), rerun.where(half == 0))):
        log.append(rows, n)
        if n in (1, 2):
            log.compact()
    return log.read()


def _health(spark, sf):
    return col.media_health(_log(spark, sf), AS_OF)


def _channel_status(spark, sf):
    return col.channel_status(tables.channel_registry(spark, sf), _health(spark, sf), AS_OF)


def _api_runs(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("user_id", "event_type")
    runs = ev.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.count_if(F.col("event_type") == "purchase").alias("response_rows"),
        F.count_if(F.col("event_type") == "click").alias("n_click"),
        F.count_if(F.col("event_type") == "signup").alias("n_signup"))
    c = F.col
    stats = F.when(c("n_error") > 16, F.lit("failed")).otherwise(F.lit("success"))
    pipeline = F.when(c("n_click") >= 13, F.lit("success")).otherwise(F.lit("failed"))
    report = F.when(c("n_signup") >= 13, F.lit("success")).otherwise(F.lit("failed"))
    return runs.select("user_id", col.classify_api_run(stats, c("response_rows"), c("response_rows") == 0, pipeline,
                                                       report).alias("api_status"),
                       col.classify_file_run(c("n_click"), pipeline, report).alias("file_status"))


def collection_queries() -> dict:
    return {
        "log_time_parse": lambda spark, sf: col.log_view(_log(spark, sf)).select(
            "collection_id", "started_at", "finished_at", "started_ts", "finished_ts", "event_ts"),
        "log_upsert": _upserted,
        "log_upsert_compacted": _compacted,
        "media_health_30d": _health,
        "latest_event_times": lambda spark, sf: col.latest_event_times(_health(spark, sf)),
        "recent_logs": lambda spark, sf: col.recent_logs(_log(spark, sf), 20),
        "channel_status": _channel_status,
        "channel_attention": lambda spark, sf: col.needs_attention(_channel_status(spark, sf)),
        "overall_status": lambda spark, sf: col.overall_status(_channel_status(spark, sf),
                                                               col.latest_event_times(_health(spark, sf))),
        "step_verdicts": lambda spark, sf: col.step_verdicts(tables.step_results(spark, sf), REQUIRED_STEPS),
        "run_status": _api_runs,
    }


LOG_RAW = """log_raw AS (
  SELECT CAST(event_id AS VARCHAR) AS collection_id, 'a' || CAST(user_id % 3 AS VARCHAR) AS advertiser_id,
         CASE WHEN user_id % 7 = 0 THEN ' M' || CAST(user_id % 5 AS VARCHAR) || ' '
              ELSE 'm' || CAST(user_id % 5 AS VARCHAR) END AS media,
         strftime(ts - INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '+00:00' ELSE '' END
           AS started_at,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '+00:00' ELSE '' END AS finished_at,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'no_data' WHEN 'view' THEN 'partial'
              ELSE 'success' END AS status,
         CAST(floor(value) AS BIGINT) AS rows_collected, CAST(1 AS BIGINT) AS file_count,
         value / 100 AS storage_used_mb,
         CASE WHEN event_type = 'error' THEN 'E' || CAST(user_id % 4 AS VARCHAR) ELSE '' END AS error_code,
         CASE WHEN event_type = 'error' THEN 'collector timeout' ELSE '' END AS error_message
  FROM events)"""


def _parse(x: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({x}), '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') "
            f"THEN timezone('Asia/Seoul', TRY_CAST(trim({x}) AS TIMESTAMPTZ)) ELSE TRY_CAST(trim({x}) AS TIMESTAMP) END")


LOG_VIEW = f"""lv AS (
  SELECT *, lower(trim(media)) AS media_key, {_parse('started_at')} AS started_ts,
         {_parse('finished_at')} AS finished_ts, COALESCE({_parse('finished_at')}, {_parse('started_at')}) AS event_ts,
         lower(COALESCE(status, '')) AS status_l FROM log_raw)"""

HEALTH = f"""hl AS (
  SELECT media_key AS media,
    arg_max(status_l, (COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00'), collection_id)) AS latest_status,
    arg_max(event_ts, (COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00'), collection_id)) AS latest_finished_at,
    MAX(CASE WHEN status_l = 'success' THEN event_ts END) AS last_success_at,
    MAX(CASE WHEN status_l NOT IN ('', 'success') THEN event_ts END) AS last_failure_at,
    arg_max(COALESCE(error_code, ''), (COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00'), collection_id))
      AS error_code,
    arg_max(COALESCE(error_message, ''), (COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00'), collection_id))
      AS error_message,
    COUNT(*) FILTER (WHERE COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00') >= {AS_OF_SQL} - INTERVAL 30 DAY
                       AND status_l = 'success') AS success_count_30d,
    COUNT(*) FILTER (WHERE COALESCE(event_ts, TIMESTAMP '0001-01-01 00:00:00') >= {AS_OF_SQL} - INTERVAL 30 DAY)
      AS total_count_30d
  FROM lv WHERE media_key <> '' GROUP BY media_key),
h AS (
  SELECT *, CASE WHEN total_count_30d > 0 THEN
      (q + CASE WHEN rem * 2 > total_count_30d OR (rem * 2 = total_count_30d AND q % 2 = 1) THEN 1 ELSE 0 END) / 10.0
    END AS success_rate_30d
  FROM (SELECT *, CAST(floor(success_count_30d * 1000 / total_count_30d) AS BIGINT) AS q,
               success_count_30d * 1000 - CAST(floor(success_count_30d * 1000 / total_count_30d) AS BIGINT)
                 * total_count_30d AS rem FROM hl WHERE total_count_30d > 0
        UNION ALL SELECT *, NULL, NULL FROM hl WHERE total_count_30d = 0) z)"""

HEALTH_COLS = ("media, latest_status, latest_finished_at, last_success_at, last_failure_at, error_code, error_message, "
               "success_count_30d, total_count_30d, success_rate_30d")

CHANNELS = f"""ch AS (
  SELECT n_name AS channel, n_nationkey AS display_order,
         CASE WHEN n_nationkey % 4 = 3 THEN 'needs_connection' ELSE 'entry_done' END AS connection,
         ['m' || CAST(n_nationkey % 7 AS VARCHAR), 'm' || CAST(n_nationkey % 9 AS VARCHAR)] AS media_keys
  FROM nation),
ks AS (SELECT channel, generate_subscripts(media_keys, 1) AS key_pos, unnest(media_keys) AS media FROM ch),
best AS (SELECT channel, arg_min(media, key_pos) AS media FROM ks JOIN (SELECT {HEALTH_COLS} FROM h) hh USING (media)
         GROUP BY channel),
j AS (SELECT ch.channel, ch.display_order, ch.connection AS conn0, hh.* EXCLUDE (media),
             (best.channel IS NOT NULL) AS has
      FROM ch LEFT JOIN best USING (channel) LEFT JOIN (SELECT {HEALTH_COLS} FROM h) hh ON hh.media = best.media),
s0 AS (
  SELECT channel, display_order,
    CASE WHEN has AND latest_status = 'success' THEN 'connected' ELSE conn0 END AS connection,
    CASE WHEN has THEN latest_status = 'success' ELSE false END AS success,
    CASE WHEN has AND latest_status = 'success' THEN COALESCE(last_success_at, latest_finished_at)
         WHEN has THEN last_success_at ELSE NULL END AS last_at,
    latest_finished_at AS last_check_at,
    CASE WHEN has AND success_rate_30d IS NOT NULL THEN format('{{:,.1f}}', success_rate_30d) || '%'
         ELSE 'no record' END AS success_rate,
    CASE WHEN NOT has THEN 'no collection log' WHEN latest_status = 'success' THEN '-'
         WHEN latest_status = 'partial' THEN COALESCE(NULLIF(trim(error_message), ''),
                                                      'only part of the data was collected')
         WHEN latest_status = 'no_data' THEN COALESCE(NULLIF(trim(error_message), ''), 'no data collected for the period')
         ELSE COALESCE(NULLIF(trim(error_message), ''), NULLIF(trim(error_code), ''), 'latest collection failed') END
      AS failure_reason,
    CASE WHEN has AND latest_status <> 'success' AND latest_status = 'partial' THEN '주의'
         WHEN has AND latest_status <> 'success' THEN '연결 안됨' END AS override
  FROM j),
st AS (
  SELECT * EXCLUDE (override), COALESCE(override,
    CASE WHEN connection = 'needs_connection' OR NOT success OR last_at IS NULL THEN '연결 안됨'
         WHEN (epoch_us({AS_OF_SQL}) - epoch_us(last_at)) / 3.6e9 <= 24 THEN '최신'
         WHEN (epoch_us({AS_OF_SQL}) - epoch_us(last_at)) / 3.6e9 <= 72 THEN '주의' ELSE '오래됨' END) AS status
  FROM s0)"""


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def collection_oracles() -> dict:
    base = _ctes(LOG_RAW, LOG_VIEW)
    health = _ctes(LOG_RAW, LOG_VIEW, HEALTH)
    chan = _ctes(LOG_RAW, LOG_VIEW, HEALTH, CHANNELS)
    overall = f"""{chan},
fl AS (SELECT display_order, channel || ': ' || failure_reason AS line FROM st WHERE NOT success),
dg AS (SELECT COUNT(*) AS n, string_agg(line, ' / ' ORDER BY display_order) FILTER (WHERE rk <= 2) AS first2
       FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY display_order) AS rk FROM fl) z),
ag AS (SELECT bool_and(status = '연결 안됨') AS all_disc,
              COALESCE(bool_or(connection <> 'needs_connection' AND status = '오래됨'), false) AS any_stale,
              COALESCE(bool_or(connection <> 'needs_connection' AND status = '주의'), false) AS any_warn,
              COALESCE(bool_or(status = '연결 안됨'), false) AS any_disc,
              COALESCE(bool_and(CASE WHEN connection <> 'needs_connection' THEN status = '최신' END), true) AS all_fresh,
              MAX(CASE WHEN success THEN last_at END) AS chs, MAX(CASE WHEN NOT success THEN last_check_at END) AS chf
       FROM st),
lt AS (SELECT MAX(last_success_at) AS ls, MAX(last_failure_at) AS lf FROM h)
SELECT CASE WHEN all_disc THEN '연결 안됨' WHEN any_stale THEN '오래됨' WHEN any_warn OR any_disc THEN '주의'
            WHEN all_fresh THEN '최신' ELSE '주의' END AS overall_status,
       GREATEST(chs, ls) AS last_success_at, GREATEST(chf, lf) AS last_failure_at,
       CASE WHEN n = 0 THEN '-' WHEN n > 2 THEN first2 || ' (+' || CAST(n - 2 AS VARCHAR) || ' more)' ELSE first2 END
         AS failure_reason
FROM ag, dg, lt"""
    steps = """sr AS (
  SELECT 'm' || CAST(user_id % 5 AS VARCHAR) AS media, event_id AS seq, event_type AS step,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN 'error E' || CAST(user_id % 4 AS VARCHAR)
              WHEN event_type = 'signup' THEN 'login required for u' || CAST(user_id % 3 AS VARCHAR)
              ELSE 'ok ' || event_type END AS detail
  FROM events)"""
    req = ", ".join(f"COALESCE(bool_or(step = '{s}' AND status = 'success'), false) AS ok_{s}" for s in REQUIRED_STEPS)
    all_ok = " AND ".join(f"ok_{s}" for s in REQUIRED_STEPS)
    verdicts = f"""WITH {steps},
a AS (SELECT media, {req}, COUNT(*) FILTER (WHERE status = 'success') AS success_steps,
             arg_min(detail, seq) FILTER (WHERE status = 'blocked') AS blocker,
             arg_min(detail, seq) FILTER (WHERE status = 'failed') AS failure FROM sr GROUP BY media),
df AS (SELECT media, detail, MIN(seq) AS first_seq FROM sr WHERE status IN ('failed', 'blocked') GROUP BY media, detail),
t3 AS (SELECT media, string_agg(detail, ' / ' ORDER BY rk) AS failure_digest
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY media ORDER BY first_seq, detail) AS rk FROM df) z
       WHERE rk <= 3 GROUP BY media)
SELECT media, {', '.join(f'ok_{s}' for s in REQUIRED_STEPS)}, ({all_ok}) AS required_ok,
       CASE WHEN {all_ok} THEN 'validated' WHEN success_steps > 0 THEN 'partial' ELSE 'conditional' END AS verdict,
       COALESCE(blocker, failure, 'verify with a real account first') AS reason, failure_digest
FROM a LEFT JOIN t3 USING (media)"""
    runs = """WITH r AS (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS n_error,
                COUNT(*) FILTER (WHERE event_type = 'purchase') AS response_rows,
                COUNT(*) FILTER (WHERE event_type = 'click') AS n_click,
                COUNT(*) FILTER (WHERE event_type = 'signup') AS n_signup FROM events GROUP BY user_id)
SELECT user_id,
  CASE WHEN n_error > 16 THEN 'failed' WHEN response_rows = 0 THEN 'no_data'
       WHEN n_click >= 13 AND n_signup >= 13 THEN 'success' ELSE 'partial' END AS api_status,
  CASE WHEN n_click > 0 AND n_click >= 13 THEN 'success' WHEN n_click > 0 AND n_signup >= 13 THEN 'partial'
       ELSE 'failed' END AS file_status
FROM r"""
    return {
        "log_time_parse": f"{base}\nSELECT collection_id, started_at, finished_at, started_ts, finished_ts, event_ts FROM lv",
        "log_upsert": f"""{_ctes(LOG_RAW)},
b AS (SELECT *, CAST(0 AS BIGINT) AS ingest_seq FROM log_raw),
u AS (SELECT * REPLACE ('success' AS status, '' AS error_code, '' AS error_message, CAST(1 AS BIGINT) AS ingest_seq)
      FROM b WHERE CAST(collection_id AS BIGINT) % 10 = 0),
a AS (SELECT * FROM b UNION ALL SELECT * FROM u)
SELECT * EXCLUDE (rk) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY collection_id ORDER BY ingest_seq DESC) AS rk
                            FROM a) z WHERE rk = 1""",
        "log_upsert_compacted": f"""{_ctes(LOG_RAW)},
b AS (SELECT *, CAST(0 AS BIGINT) AS ingest_seq FROM log_raw),
u AS (SELECT * REPLACE ('success' AS status, '' AS error_code, '' AS error_message, CAST(1 AS BIGINT) AS ingest_seq)
      FROM b WHERE CAST(collection_id AS BIGINT) % 10 = 0),
a AS (SELECT * FROM b UNION ALL SELECT * FROM u)
SELECT * EXCLUDE (rk) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY collection_id ORDER BY ingest_seq DESC) AS rk
                            FROM a) z WHERE rk = 1""",
        "media_health_30d": f"{health}\nSELECT {HEALTH_COLS} FROM h",
        "latest_event_times": f"{health}\nSELECT MAX(last_success_at) AS last_success_at, "
                              f"MAX(last_failure_at) AS last_failure_at FROM h",
        "recent_logs": f"{_ctes(LOG_RAW)}\nSELECT * FROM log_raw ORDER BY started_at DESC, collection_id DESC LIMIT 20",
        "channel_status": f"{chan}\nSELECT * FROM st",
        "channel_attention": f"{chan}\nSELECT * FROM st WHERE status IN ('주의', '오래됨', '연결 안됨')",
        "overall_status": overall,
        "step_verdicts": verdicts,
        "run_status": runs,
    }
