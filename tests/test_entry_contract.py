"""Driver contract: entry(), queries() and oracle_sql() agree on sf0.001 (Spark vs DuckDB)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from adlens.sources.tables import TABLES

SMOKE = "/root/testdata/sf0.001"

# One representative query per module (the full set is checked by tools/check_oracle.py).
REPRESENTATIVE = ["kpi_summary", "segments_all", "periods_all", "recent_comparison_by_account", "preset_kpis",
                  "anomalies", "action_issues", "standardize_text", "media_health_30d", "channel_status",
                  "json_shred", "channel_benchmark", "audit_required_status", "retention_plan", "period_markdown"]


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() >= 0
    assert {"severity", "rule_code", "target", "cost"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", REPRESENTATIVE)
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SMOKE)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    orows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert srows == orows
