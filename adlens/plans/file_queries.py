"""Registered file-inventory queries (downloads, latest files, retention) and oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adlens.operators import files as fo
from adlens.sources import tables

NOW = dt.datetime(2024, 6, 30, 12, 0, 0)
AFTER = dt.datetime(2024, 3, 1)


def _inv(spark, sf):
    return tables.file_inventory(spark, sf)


def _folder(c):
    return F.regexp_extract(c, r"^(data/[^/]+|downloads)", 1)


def file_queries() -> dict:
    return {
        "completed_downloads": lambda spark, sf: fo.completed_downloads(
            _inv(spark, sf).where(F.col("path").startswith("downloads/")), AFTER),
        "latest_files": lambda spark, sf: fo.latest_files(
            _inv(spark, sf).withColumn("folder", _folder(F.col("path"))), ["folder"], [".csv", ".xlsx", ".xls"]),
        "evidence_rollup": lambda spark, sf: fo.evidence_rollup(
            _inv(spark, sf).withColumn("folder", _folder(F.col("path"))), ["folder"]),
        "retention_candidates": lambda spark, sf: fo.retention_candidates(_inv(spark, sf), NOW).where("due"),
        "retention_plan": lambda spark, sf: fo.retention_plan(_inv(spark, sf), NOW),
    }


INV = """inv AS (
  SELECT path, CAST(length AS BIGINT) AS length, modificationTime FROM (
    SELECT CASE WHEN folder = 'downloads' THEN 'downloads/' || replace(dl, '{}', CAST(doc_id AS VARCHAR))
                ELSE 'data/' || folder || '/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || suffix END AS path,
           CASE WHEN folder = 'downloads' AND doc_id % 13 = 0 THEN 0 ELSE n_chars * 4 END AS length,
           TIMESTAMP '2024-06-30 12:00:00' - to_days(CAST((doc_id * 37) % 500 AS INTEGER))
             - to_hours(CAST(doc_id % 24 AS INTEGER)) AS modificationTime
    FROM (SELECT *, ['raw', 'processed', 'reports', 'logs', 'screenshots', 'downloads', 'other'][doc_id % 7 + 1] AS folder,
                 ['.csv', '.xlsx', '.json', '.txt', '.png'][doc_id % 5 + 1] AS suffix,
                 ['report_{}.csv', 'report_{}.xlsx', 'REPORT_{}.XLSX', 'report_{}.xlsx.crdownload', 'demo_{}.csv',
                  'report_{}.tmp', 'notes_{}.txt', 'report_{}.xls'][doc_id % 8 + 1] AS dl
          FROM documents) d) x)"""

TARGETS = """tg AS (SELECT * FROM (VALUES ('raw', 90), ('processed', 365), ('reports', 365), ('logs', 180),
                                   ('screenshots', 30)) t(target, retention_days)),
sx AS (SELECT * FROM (VALUES ('raw', '.csv'), ('raw', '.xlsx'), ('raw', '.xls'), ('raw', '.json'),
    ('processed', '.csv'), ('processed', '.xlsx'), ('processed', '.parquet'), ('processed', '.duckdb'),
    ('reports', '.md'), ('reports', '.txt'), ('reports', '.xlsx'), ('reports', '.pdf'),
    ('logs', '.log'), ('logs', '.txt'), ('logs', '.json'),
    ('screenshots', '.png'), ('screenshots', '.jpg'), ('screenshots', '.jpeg'), ('screenshots', '.webp'))
  t(target, suffix)),
c AS (SELECT inv.path, inv.length, sx.target, tg.retention_days,
             (epoch_us(TIMESTAMP '2024-06-30 12:00:00') - epoch_us(inv.modificationTime)) / 86400000000.0 AS age_days
      FROM inv JOIN sx ON inv.path LIKE 'data/' || sx.target || '/%'
                      AND regexp_extract(inv.path, '(\\.[^./]*)$', 1) = sx.suffix
               JOIN tg ON tg.target = sx.target)"""


def file_oracles() -> dict:
    return {
        "completed_downloads": f"""WITH {INV}
SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, length, modificationTime FROM inv
WHERE path LIKE 'downloads/%'
  AND lower(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(\\.[^.]*)$', 1)) IN ('.xlsx', '.xls', '.csv')
  AND length > 0 AND modificationTime >= TIMESTAMP '2024-03-01 00:00:00'
  AND NOT starts_with(lower(regexp_extract(path, '([^/]+)$', 1)), 'demo_')""",
        "latest_files": f"""WITH {INV},
f AS (SELECT *, regexp_extract(path, '^(data/[^/]+|downloads)', 1) AS folder FROM inv
      WHERE lower(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(\\.[^.]*)$', 1)) IN ('.csv', '.xlsx', '.xls'))
SELECT folder, MAX(modificationTime) AS latest_mtime, arg_max(path, (modificationTime, path)) AS latest_path,
       COUNT(*) AS files FROM f GROUP BY folder""",
        "evidence_rollup": f"""WITH {INV}
SELECT regexp_extract(path, '^(data/[^/]+|downloads)', 1) AS folder, COUNT(*) AS file_count,
       SUM(length) / 1048576.0 AS storage_mb FROM inv GROUP BY 1""",
        "retention_candidates": f"""WITH {INV}, {TARGETS}
SELECT path, length, target, age_days, retention_days, age_days > retention_days AS due FROM c
WHERE age_days > retention_days""",
        "retention_plan": f"""WITH {INV}, {TARGETS},
r AS (SELECT target, COUNT(*) AS file_count, SUM(length) / 1048576.0 AS storage_mb,
             COUNT(*) FILTER (WHERE age_days > retention_days) AS delete_candidate_count,
             COALESCE(SUM(CASE WHEN age_days > retention_days THEN length END) / 1048576.0, 0.0) AS delete_candidate_mb,
             GROUPING(target) AS g FROM c GROUP BY ROLLUP (target))
SELECT tg.target, tg.retention_days, COALESCE(file_count, 0) AS file_count, COALESCE(storage_mb, 0.0) AS storage_mb,
       COALESCE(delete_candidate_count, 0) AS delete_candidate_count,
       COALESCE(delete_candidate_mb, 0.0) AS delete_candidate_mb,
       CAST(DATE '2024-06-30' - tg.retention_days AS DATE) AS delete_before
FROM tg LEFT JOIN (SELECT * FROM r WHERE g = 0) r USING (target)
UNION ALL
SELECT NULL, NULL, file_count, storage_mb, delete_candidate_count, delete_candidate_mb, NULL FROM r WHERE g = 1""",
    }
