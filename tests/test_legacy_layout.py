"""Marketplace legacy layout (FIXTURES.md §2): Korean headers plus metadata columns."""

import os

import pytest

from tests.conftest import FIXTURES
from adlens.operators import ingest, issues, rules


@pytest.fixture(scope="module")
def legacy(spark):
    raw = spark.read.option("header", True).csv(os.path.join(FIXTURES, "legacy_gmarket.csv"))
    fact, mapping = ingest.standardize_layout(raw, "legacy")
    return fact, mapping


def test_mapping(legacy):
    _, mapping = legacy
    rows = mapping.collect()
    mapped = {r["header"] for r in rows if r["canonical"]}
    unmapped = {r["header"] for r in rows if not r["canonical"]}
    assert len(mapped) == 12
    assert unmapped == {"광고수익률", "클릭당비용", "클릭률", "전환율", "광고ID", "상품번호", "source_sheet"}
    missing = {r["canonical"] for r in ingest.missing_canonical(mapping).collect()}
    assert missing == {"keyword"}


def test_thresholds(legacy):
    fact, _ = legacy
    t = rules.thresholds(fact).collect()[0]
    assert t["no_conversion_cost_threshold"] == pytest.approx(350_000)
    assert t["high_impression_threshold"] == pytest.approx(54_000)
    assert t["low_ctr_threshold"] == pytest.approx(0.0031944, abs=1e-7)


def test_all_three_rules_fire(legacy):
    fact, _ = legacy
    got = {(r["target"], r["rule_code"]) for r in rules.anomalies(fact).collect()}
    assert got == {("G마켓 전환 점검 캠페인", "spend_without_conversion"),
                   ("G마켓 클릭률 점검 캠페인", "low_ctr_at_volume"),
                   ("G마켓 확대 후보 캠페인", "scale_candidate"),
                   ("G마켓 안정 운영 캠페인", "scale_candidate")}  # ROAS exactly 4.0 qualifies
    scores = {r["target"]: r["priority_score"] for r in issues.action_issues(fact).collect()}
    assert scores["G마켓 전환 점검 캠페인"] == pytest.approx(126.2)
    assert scores["G마켓 클릭률 점검 캠페인"] == pytest.approx(72.6)
    assert scores["G마켓 확대 후보 캠페인"] == pytest.approx(63.8)
    assert scores["G마켓 안정 운영 캠페인"] == pytest.approx(64.3)
