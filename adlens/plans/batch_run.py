"""End-to-end batch run: report folder -> standardised fact -> analysis sheets -> report.

One job per output. The standardised fact is written once as a table under the
shared checkpoint folder and every sheet reads it, so the raw text is parsed a
single time and lineage stays short. Sheets and narratives are written for all scopes
together (``operators.sinks``), so one run serves every advertiser.

usage: python -m adlens.plans.batch_run INPUT_DIR OUTPUT_DIR [--scope account_name] [--glob '*.csv']
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from adlens.operators import audit, compare, issues, metrics, report, rules
from adlens.operators.ingest import map_headers
from adlens.operators.sinks import write_scoped
from adlens.session import get_spark, materialize, scratch_tables
from adlens.sources.reports import read_report_lines


def narratives(fact: DataFrame, scope: Sequence[str] = (), advertiser: str = "advertiser", mapping: DataFrame | None = None,
               aggregates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The narrative of every scope as ordered lines, from one pass for the rules and one for the two period tables."""
    scope = list(scope)
    aggs = aggregates or rules.rule_aggregates(fact, scope)
    hits = rules.anomalies(fact, scope, aggregates=aggs)
    return report.report_lines(
        advertiser, rules.summary_from_campaigns(aggs[0], scope),
        rules.recommendations(fact, scope, anomaly_rows=hits, aggregates=aggs),
        issues.action_issues(fact, scope, anomaly_rows=hits, aggregates=aggs), hits,
        metrics.month_week_periods(fact, scope), mapping, scope)


@dataclass
class AnalysisResult:
    summary: DataFrame
    segments: DataFrame
    periods: DataFrame
    comparison: DataFrame
    anomalies: DataFrame
    recommendations: DataFrame
    issues: DataFrame
    health: DataFrame


def analyze(fact: DataFrame, scope: Sequence[str] = (), aggregates: tuple[DataFrame, DataFrame] | None = None) -> AnalysisResult:
    """All analysis tables for every scope, as lazy DataFrames over ``fact``."""
    scope = list(scope)
    aggs = aggregates or rules.rule_aggregates(fact, scope)
    anomalies = rules.anomalies(fact, scope, aggregates=aggs)
    return AnalysisResult(
        summary=rules.summary_from_campaigns(aggs[0], scope),
        segments=metrics.segments_all(fact, scope),
        periods=metrics.periods_all(fact, scope),
        comparison=compare.recent_comparison(fact, scope),
        anomalies=anomalies,
        recommendations=rules.recommendations(fact, scope, anomaly_rows=anomalies, aggregates=aggs),
        issues=issues.action_issues(fact, scope, anomaly_rows=anomalies, aggregates=aggs),
        health=issues.health_score(fact, scope, anomaly_rows=anomalies, aggregates=aggs),
    )


SHEETS = {
    "summary": "totals and ratios of the period",
    "segments": "measures by platform, campaign, ad group, keyword and product",
    "periods": "measures by day, week, month, quarter, half-year, year and season",
    "period_compare": "the earlier half of the period against the recent one",
    "anomalies": "campaigns that a rule fired for",
    "recommendations": "what to do about them, by priority",
    "today_actions": "all issues with their evidence and the advertiser's message",
    "health": "the account's health from 0 to 100",
}


def write_sheets(result: AnalysisResult, out_dir: str, scope: Sequence[str] = ()) -> None:
    """One dataset per sheet, and a guide to them read from the written sheets.

    With a scope the sheets are bucketed by it, each with a manifest (``operators.sinks``).
    """
    sheets = {
        "summary": result.summary, "segments": result.segments, "periods": result.periods,
        "period_compare": result.comparison, "anomalies": result.anomalies,
        "recommendations": result.recommendations, "today_actions": report.action_sheet(result.issues, scope),
        "health": result.health,
    }
    written = {}
    for name, df in sheets.items():
        path = f"{out_dir}/{name}"
        if scope:
            write_scoped(df, path, scope)
        else:
            df.write.mode("overwrite").parquet(path)
        written[name] = df.sparkSession.read.parquet(f"{path}/rows" if scope else path)
    report.guide_sheet(written, SHEETS).write.mode("overwrite").parquet(f"{out_dir}/guide")


def run_batch(spark: SparkSession, in_dir: str, out_dir: str, scope: Sequence[str] = (), glob: str = "*.csv",
              advertiser: str = "advertiser") -> None:
    """Analyse every report under ``in_dir`` and write all outputs below ``out_dir``; no temporary table stays."""
    with scratch_tables(spark):
        # The text is parsed once: header mapping, standardising and audit read the written lines.
        lines = materialize(read_report_lines(spark, in_dir, glob), "lines")
        mapping = materialize(map_headers(audit.header_catalog_from_lines(lines)), "header-mapping")
        # The standardised fact is itself an output: write it once and analyse the written copy.
        audit.standardize_lines(lines, mapping, keep_extras=True).write.mode("overwrite").parquet(f"{out_dir}/standardized")
        fact = spark.read.parquet(f"{out_dir}/standardized")
        audit.file_audit(lines, mapping=mapping, fact=fact).write.mode("overwrite").parquet(f"{out_dir}/file_audit")
        write_analysis(fact, mapping, out_dir, scope, advertiser)


def write_analysis(fact: DataFrame, mapping: DataFrame, out_dir: str, scope: Sequence[str] = (), advertiser: str = "advertiser") -> None:
    """The sheets and the narrative of every scope of a written fact (one of each without a scope)."""
    spark = fact.sparkSession
    with scratch_tables(spark):
        aggs = rules.rule_aggregates(fact, scope)
        write_sheets(analyze(fact, scope, aggs), out_dir, scope)
        # written once, read for both formats
        text = materialize(narratives(fact, scope, advertiser, mapping, aggs), "narratives")
        report.write_report(text, f"{out_dir}/report_md", scope)
        report.write_report(report.plain_text(text), f"{out_dir}/report_txt", scope)


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Analyse a folder of ad reports with Spark.")
    ap.add_argument("input_dir")
    ap.add_argument("output_dir")
    ap.add_argument("--scope", action="append", default=[], help="grouping column, e.g. account_name")
    ap.add_argument("--glob", default="*.csv")
    ap.add_argument("--advertiser", default="advertiser")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    spark = get_spark(args.master)
    run_batch(spark, args.input_dir, args.output_dir, args.scope, args.glob, args.advertiser)


if __name__ == "__main__":
    main()
