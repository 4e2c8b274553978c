"""Display formatting, report-line tables and dashboard counters.

Reports are built as a long table ``(scope..., section_no, line_no, line)`` with
``union``; a sink writes it ordered within each scope's file, so no report is
ever assembled in one task or on the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import DIMENSIONS, UNCLASSIFIED
from adlens.functions.formatting import fmt_count, fmt_money, fmt_percent
from adlens.operators.sinks import write_scoped
from adlens.session import materialize

COUNT_COLUMNS = ["rows", "impressions", "clicks", "conversions", "orders"]
MONEY_COLUMNS = ["cost", "revenue", "cpc", "cpa"]
PERCENT_COLUMNS = ["ctr", "cvr", "change_rate", "roas"]
DATE_COLUMNS = ["date", "period_start", "period_end"]
CORE_METRICS = ["impressions", "clicks", "cost", "conversions", "revenue", "ctr", "cpc", "cvr", "cpa", "roas"]
PERIOD_TABLE_COLUMNS = ["period_label", "period_start", "period_end", "impressions", "clicks", "cost", "conversions",
                        "revenue", "ctr", "cpc", "cvr", "cpa", "roas"]


def format_column(name: str, c: Column | None = None) -> Column:
    """Format one column by its name's class; null -> ''."""
    c = F.col(name) if c is None else c
    if name in DATE_COLUMNS:
        out = F.date_format(c, "yyyy-MM-dd")
    elif name in COUNT_COLUMNS:
        out = fmt_count(c)
    elif name in MONEY_COLUMNS:
        out = fmt_money(c)
    elif name in PERCENT_COLUMNS:
        out = fmt_percent(c)
    else:
        out = c.cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(out)


def format_for_display(df: DataFrame) -> DataFrame:
    """Every known measure / ratio / date column formatted for display (others unchanged)."""
    known = set(DATE_COLUMNS + COUNT_COLUMNS + MONEY_COLUMNS + PERCENT_COLUMNS)
    return df.select(*[format_column(c).alias(c) if c in known else F.col(c) for c in df.columns])


def localize(df: DataFrame, column_labels: dict[str, str],
             value_labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Rename columns to display labels and map coded values (e.g. severity, priority) to labels."""
    out = df
    for col_name, mapping in (value_labels or {}).items():
        if col_name in out.columns:
            m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
            out = out.withColumn(col_name, F.coalesce(m[F.col(col_name)], F.col(col_name)))
    return out.withColumnsRenamed({k: v for k, v in column_labels.items() if k in out.columns})


def delocalize(df: DataFrame, column_labels: dict[str, str], value_labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Display labels back to column names and coded values; what is no label stays as it is.

    Of several names with one label the last is meant, as in a reversed dictionary.
    """
    names = {label: name for name, label in column_labels.items()}
    out = df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})
    for col_name, mapping in (value_labels or {}).items():
        if col_name in out.columns:
            codes = {label: code for code, label in mapping.items()}
            m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
            out = out.withColumn(col_name, F.coalesce(m[F.col(col_name)], F.col(col_name)))
    return out


def guide_sheet(sheets: dict[str, DataFrame], descriptions: dict[str, str]) -> DataFrame:
    """One row per sheet, in writing order: its name, what it holds, and how many rows it has."""
    out = None
    for number, (name, df) in enumerate(sheets.items(), 1):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(number).alias("sheet_no"), F.lit(name).alias("sheet"), F.lit(descriptions.get(name, "")).alias("description"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def view_projection(df: DataFrame, expert: bool = False) -> DataFrame:
    """Basic view keeps dimensions and core metrics; expert view keeps everything."""
    if expert:
        return df
    wanted = [c for c in DIMENSIONS + CORE_METRICS if c in df.columns]
    return df.select(*wanted) if wanted else df


def comparison_display(cmp: DataFrame, left: str = "previous", right: str = "current",
                       scope: Sequence[str] = ()) -> DataFrame:
    """Comparison rows with values formatted by the row's metric."""
    def by_metric(v: Column) -> Column:
        m = F.col("metric")
        return (F.when(m.isin(COUNT_COLUMNS), fmt_count(v)).when(m.isin(MONEY_COLUMNS), fmt_money(v))
                .when(m.isin(PERCENT_COLUMNS), fmt_percent(v)).otherwise(v.cast("string")))
    return cmp.select(*scope, "metric_no", "metric", by_metric(F.col(left)).alias(left),
                      by_metric(F.col(right)).alias(right), by_metric(F.col("delta")).alias("delta"),
                      fmt_percent(F.col("change_rate")).alias("change_rate"))


def change_band(rate: Column) -> Column:
    """Signed change text: '+x.xx%', '-x.xx%', 'no change', or 'no previous period'."""
    return (F.when(rate.isNull(), F.lit("no previous period"))
            .when(rate > 0, F.concat(F.lit("+"), fmt_percent(rate)))
            .when(rate < 0, fmt_percent(rate)).otherwise(F.lit("no change")))


def _markdown_parts(table: DataFrame, columns: Sequence[str]) -> tuple[str, str, Column]:
    """Header and separator of a pipe table, and the line of a formatted row."""
    cols = [c for c in columns if c in table.columns]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[format_column(c) for c in cols]), F.lit(" |"))
    return "| " + " | ".join(cols) + " |", "| " + " | ".join(["---"] * len(cols)) + " |", body


def _numbered(*lines: Column) -> Column:
    return F.array(*(F.struct(F.lit(no).alias("line_no"), line.alias("line")) for no, line in enumerate(lines)))


def markdown_table_lines(table: DataFrame, columns: Sequence[str], order: Sequence[str],
                         scope: Sequence[str] = ()) -> DataFrame:
    """Pipe-table lines: header (line 0), separator (line 1), then formatted rows in ``order``."""
    header, sep, body = _markdown_parts(table, columns)
    w = Window.partitionBy(*scope).orderBy(*order)
    rows = table.select(*scope, (F.row_number().over(w) + 1).alias("line_no"), body.alias("line"))
    heads = table.select(*scope).distinct() if scope else table.sparkSession.range(1).select()
    return heads.select(*scope, F.inline(_numbered(F.lit(header), F.lit(sep)))).unionByName(rows)


def period_sections(periods: DataFrame, sections: dict[str, int], scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., section_no, line_no, line): :func:`period_markdown` of several grains, a section each.

    A scope's first row brings the lines above it along, so the periods are computed once.
    """
    scope, c = list(scope), F.col
    header, sep, body = _markdown_parts(periods, PERIOD_TABLE_COLUMNS)
    heads = _numbered(F.lit(header), F.lit(sep))
    number = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    w = Window.partitionBy(*scope, "grain").orderBy("period_start", "period_label")
    rows = periods.where(c("grain").isin(*sections)).withColumn("_no", F.row_number().over(w))
    own = F.array(F.struct((c("_no") + 1).alias("line_no"), body.alias("line")))
    if scope:
        own = F.slice(F.concat(heads, own), F.when(c("_no") == 1, 1).otherwise(3), F.lit(3))
    out = rows.select(*scope, number[c("grain")].alias("section_no"), F.inline(own))
    if not scope:  # a table without rows still has its header
        out = periods.sparkSession.range(1).select(F.explode(F.lit([*sections.values()])).alias("section_no")).select(
            "section_no", F.inline(heads)).unionByName(out)
    return out


def period_markdown(periods: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return markdown_table_lines(periods, PERIOD_TABLE_COLUMNS, ["period_start", "period_label"], scope)


def report_worthy(issues: DataFrame) -> DataFrame:
    """Issues for the report: include flag, data-shortage problems, or an actionable severity."""
    return issues.where(F.col("report_include") | F.col("problem").isin("insufficient data")
                        | F.col("severity").isin("high", "medium", "opportunity"))


SEVERITY_LABEL = {"high": "urgent", "medium": "watch", "opportunity": "opportunity", "low": "reference"}


def advertiser_message() -> Column:
    """What to tell the advertiser about an issue: what was found where, on what evidence, and what is next."""
    c = F.col
    return F.when(c("problem") == "insufficient data", F.lit("There is too little data to explain results yet; recent data is needed first.")) \
        .otherwise(F.concat(c("problem"), F.lit(" for "), c("target"), F.lit(": "), c("evidence"), F.lit(". Next: "),
                            c("recommended_action"), F.lit(".")))


def action_sheet(issues: DataFrame, scope: Sequence[str] = (), advertiser: str = "all accounts") -> DataFrame:
    """All issues (no cut) with a severity label, an include label and the advertiser's message, in priority order.

    The advertiser is the scope's own value, or ``advertiser`` for an analysis without a scope.
    """
    who = scope_name(scope, advertiser)
    lab = F.create_map(*[x for k, v in SEVERITY_LABEL.items() for x in (F.lit(k), F.lit(v))])
    return issues.select(*scope, "issue_rank", F.coalesce(lab[F.col("severity")], F.col("severity")).alias("severity"),
                         "priority_score", "media", "target", "problem", "evidence", "cause_hypothesis",
                         "recommended_action", "expected_effect",
                         F.when(F.col("report_include"), "include").otherwise("exclude").alias("report_include"),
                         who.alias("advertiser"), advertiser_message().alias("advertiser_message"))


def scope_name(scope: Sequence[str], advertiser: str) -> Column:
    """The scope's own value, or ``advertiser`` for an analysis without a scope."""
    return F.concat_ws(" / ", *(F.col(k).cast("string") for k in scope)) if scope else F.lit(advertiser)


def issue_blocks(issues: DataFrame, advertiser: str, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., line_no, line): a heading and ten lines for each issue of the report, in priority order."""
    lab = F.create_map(*[x for k, v in SEVERITY_LABEL.items() for x in (F.lit(k), F.lit(v))])
    c = F.col
    label = F.coalesce(lab[c("severity")], c("severity"))
    lines = [F.concat(F.lit("### ["), label, F.lit("] "), c("problem")),
             F.concat(F.lit("- priority score: "), F.format_number(c("priority_score"), 2)),
             F.concat(F.lit("- advertiser: "), scope_name(scope, advertiser)),
             *(F.concat(F.lit(f"- {name}: "), c(col)) for name, col in (
                 ("media", "media"), ("target", "target"), ("evidence", "evidence"), ("likely cause", "cause_hypothesis"),
                 ("recommended action", "recommended_action"), ("expected effect", "expected_effect"))),
             F.concat(F.lit("- message: "), advertiser_message()),
             F.concat(F.lit("- report: "), F.when(c("report_include"), "include").otherwise("if needed"))]
    rows = F.array(*(F.struct((c("issue_rank") * 20 + i).alias("line_no"), x.alias("line")) for i, x in enumerate(lines)))
    return report_worthy(issues).select(*scope, F.inline(rows))


def issue_lanes(issues: DataFrame, scope: Sequence[str] = (), per_lane: int = 2) -> DataFrame:
    """First ``per_lane`` issues of each lane: urgent (high), opportunity, watch (medium + low)."""
    lane = (F.when(F.col("severity") == "high", "urgent").when(F.col("severity") == "opportunity", "opportunity")
            .when(F.col("severity").isin("medium", "low"), "watch"))
    t = issues.withColumn("lane", lane).where(F.col("lane").isNotNull())
    w = Window.partitionBy(*scope, "lane").orderBy("issue_rank")
    return t.withColumn("lane_rank", F.row_number().over(w)).where(F.col("lane_rank") <= per_lane).select(
        *scope, "lane", "lane_rank", "issue_rank", "severity", "target", "problem")


def action_parts(text: Column, n: int = 4) -> Column:
    """Action text split on ',', '·' and '/', stripped of ' .', first ``n`` non-empty parts."""
    parts = F.transform(F.split(text, "[,·/]"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, n)


def issue_title(problem: Column, action: Column) -> Column:
    """Action-oriented title from ordered substring rules over the problem text."""
    p = F.lower(problem)
    first = F.element_at(action_parts(action, 1), 1)
    return (F.when(p.contains("conversion") & (p.contains("without") | p.contains("drop") | p.contains("low")),
                   F.lit("explain the conversion drop"))
            .when(p.contains("click") | p.contains("ctr"), F.lit("check creatives and keywords"))
            .when(p.contains("roas"), F.lit("explain the ROAS change"))
            .when(p.contains("spend") & (p.contains("increase") | p.contains("excess")), F.lit("review the budget"))
            .when(p.contains("insufficient") | p.contains("check"), F.lit("collect more data"))
            .when(first.isNotNull(), F.concat(F.lit("review: "), first)).otherwise(problem))


def severity_counts(anomalies: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Anomalies per severity and their share of the scope's anomalies."""
    per = anomalies.groupBy(*scope, "severity").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*scope)
    return per.withColumn("share", F.col("n") / F.sum("n").over(w))


def top_label(table: DataFrame, metric: str, label: str, scope: Sequence[str] = ()) -> DataFrame:
    """Label of the row with the highest ``metric`` per scope (ties by label)."""
    return table.groupBy(*scope).agg(F.max_by(F.col(label), F.struct(F.col(metric), F.col(label))).alias("top_label"))


def dashboard_counters(fact: DataFrame, issues: DataFrame, files: DataFrame | None = None,
                       channels: DataFrame | None = None) -> DataFrame:
    """One row: distinct accounts / campaigns / platforms and issue counts by severity.

    With a file inventory also its raw files and reports, with the active channels their number.
    """
    valid = lambda c: F.when((F.trim(F.col(c)) != "") & (F.col(c) != UNCLASSIFIED), F.col(c))
    f = fact.agg(F.countDistinct(valid("account_name")).alias("accounts"),
                 F.countDistinct(valid("campaign_name")).alias("campaigns"),
                 F.countDistinct(valid("platform")).alias("platforms"))
    i = issues.agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "high").alias("critical"),
                   F.count_if(F.col("severity") == "medium").alias("warning"),
                   F.count_if(F.col("report_include")).alias("report_due"))
    parts = [i]
    if files is not None:
        under = lambda d: F.count_if(F.col("path").startswith(f"data/{d}/"))
        parts.append(files.agg(under("raw").alias("raw_files"), under("reports").alias("reports")))
    if channels is not None:
        parts.append(channels.agg(F.count(F.lit(1)).alias("channels")))
    out = f
    for part in parts:  # one row each, attached as scalar subqueries
        packed = part.select(F.struct(*part.columns).alias("s")).scalar()
        out = out.select("*", packed.alias("s")).select(*out.columns, "s.*")
    return out


def report_lines(advertiser: str, summary: DataFrame, recommendations: DataFrame, issues: DataFrame,
                 anomalies: DataFrame, periods: DataFrame, mapping: DataFrame | None = None,
                 scope: Sequence[str] = ()) -> DataFrame:
    """Narrative markdown reports as (scope..., section_no, line_no, line) rows, one report for each scope.

    ``periods`` has the monthly and weekly rows, told apart by ``grain``.

    Lines are numbered inside their scope, so every advertiser's (or file's) report comes from
    the same few jobs. ``mapping`` (by ``source``) adds the column mapping: that of the scope's
    file if the scope is the file, else of all files.
    """
    s, scope = F.col, list(scope)
    line = lambda no, text: F.struct(F.lit(no).alias("line_no"), text.alias("line"))
    values = [("rows", fmt_count), ("cost", fmt_money), ("revenue", fmt_money), ("roas", fmt_percent), ("ctr", fmt_percent),
              ("cvr", fmt_percent)]
    title = F.concat(F.lit("# "), scope_name(scope, advertiser), F.lit(" ad performance report"))
    head = summary.select(*scope, F.lit(1).alias("section_no"), F.inline(F.array(
        line(0, title), *(line(i, F.concat(F.lit(f"- {name}: "), fmt(s(name)))) for i, (name, fmt) in enumerate(values, 1)))))
    sections = [(2, "## Recommendations"), (3, "## Today's actions"), (4, "## Anomalies"), (5, "## Monthly"), (6, "## Weekly")]
    titles = summary.select(*scope, F.inline(F.array(*[
        F.struct(F.lit(sec).alias("section_no"), F.lit(-1).alias("line_no"), F.lit(t).alias("line")) for sec, t in sections])))
    # a scope has at most three rule hits for each of its 20 campaigns
    numbered = lambda *order: F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).alias("line_no")
    recs = recommendations.select(
        *scope, F.lit(2).alias("section_no"), numbered("rec_no", "rule_seq"),
        F.concat(F.lit("- ["), s("priority"), F.lit("] "), s("target"), F.lit(": "), s("issue"), F.lit(" -> "),
                 s("recommended_action")).alias("line"))
    acts = issue_blocks(issues, advertiser, scope).withColumn("section_no", F.lit(3))
    anom = anomalies.select(
        *scope, F.lit(4).alias("section_no"), numbered("base_rank", "rule_seq"),
        F.concat(F.lit("- "), s("severity"), F.lit(" / "), s("rule_code"), F.lit(" / "), s("target"), F.lit(" / "),
                 fmt_money(s("cost"))).alias("line"))
    tables = period_sections(periods, {"monthly": 5, "weekly": 6}, scope)
    cols = [*scope, "section_no", "line_no", "line"]
    out = head.select(*cols)
    for part in (titles, recs, acts, anom, tables):
        out = out.unionByName(part.select(*cols))
    if mapping is not None:
        # one line per column position and header: "header -> canonical" (or "unmapped"); a folder has
        # many files but few layouts, so equal lines of different files are one
        text = F.concat(F.lit("- "), s("header"), F.lit(" -> "), F.coalesce(s("canonical"), F.lit("unmapped")))
        own = ["file"] if scope == ["file"] else []
        columns = mapping.withColumn("file", s("source")).select(*own, "position", "header", "canonical").distinct().select(
            *own, F.lit(7).alias("section_no"), s("position").alias("line_no"), text.alias("line"))
        if scope and not own:  # few layouts, many scopes
            columns = summary.select(*scope, F.explode(columns.agg(F.collect_list(F.struct("section_no", "line_no", "line"))).scalar()).alias("x")) \
                .select(*scope, "x.*")
        heading = summary.select(*scope, F.lit(7).alias("section_no"), F.lit(-1).alias("line_no"), F.lit("## Column mapping").alias("line"))
        out = out.unionByName(heading).unionByName(columns.select(*cols))
    return out


def union_sources(frames: dict[str, DataFrame], label: str = "source_sheet") -> DataFrame:
    """Union frames by column name (missing columns -> null), tagging each row with its source name."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def sample_kpis(df: DataFrame, entity: str, rating: str, flag: str, flag_value: str,
                scope: Sequence[str] = ()) -> DataFrame:
    """Row count, distinct entities, mean rating and count of rows whose flag equals ``flag_value``."""
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"),
                                  F.avg(rating).alias("mean_rating"),
                                  F.count_if(F.col(flag) == flag_value).alias("flagged"))


def chained_replace(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply literal replacements in order (internal codes -> operator wording)."""
    for src, dst in pairs:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def normalise_list(text: Column) -> Column:
    """Newline- or comma-separated items, trimmed, blanks dropped, joined with ', '."""
    items = F.transform(F.split(F.regexp_replace(text, "\n", ","), ","), lambda x: F.trim(x))
    return F.array_join(F.filter(items, lambda x: x != ""), ", ")


def audit_report_lines(audits: DataFrame) -> DataFrame:
    """Audit report in (file, line_no, line) order: a summary under the empty file name, then a section per file.

    The summary counts the files, those that loaded and those that failed, and the files of each
    medium; with profile audits among them, real files and profiles. Sections sort by file, so no
    task numbers the files of the folder; with issues audited they tell how many. The audits are
    written once, as every part reads them.
    """
    audits = materialize(audits, "report-audits")
    c = F.col
    failed = F.count_if(c("load_status") == "failed")
    totals = audits.agg(F.count(F.lit(1)).alias("files"), failed.alias("failed")).select(
        F.lit("").alias("file"), F.inline(F.array(
            F.struct(F.lit(0).alias("line_no"), F.lit("# Report audit").alias("line")),
            F.struct(F.lit(1).alias("line_no"), F.concat(
                F.lit("- files: "), fmt_count(c("files")), F.lit(", loaded: "), fmt_count(c("files") - c("failed")),
                F.lit(", failed: "), fmt_count(c("failed"))).alias("line")))))
    media = audits.groupBy("inferred_media").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("").alias("file"), F.lit(2).alias("line_no"),
        F.concat(F.lit("- "), c("inferred_media"), F.lit(": "), fmt_count(c("n"))).alias("line"))
    sections = audits.select("file", F.inline(F.array(
        F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("## "), c("file")).alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("- rows: "), fmt_count(c("row_count")), F.lit(", columns: "),
                                                     c("column_count").cast("string")).alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("- media: "), c("inferred_media"), F.lit(", advertiser: "),
                                                     c("advertiser")).alias("line")),
        F.struct(F.lit(3).alias("line_no"), F.concat(F.lit("- unmapped: "), F.coalesce(
            F.array_join(c("unmapped_columns"), ", "), F.lit(""))).alias("line")),
        F.struct(F.lit(4).alias("line_no"), F.concat(F.lit("- cannot judge: "),
                                                     F.array_join(c("unavailable_fields"), ", ")).alias("line")),
        F.struct(F.lit(5).alias("line_no"), F.concat(F.lit("- load: "), c("load_status"), F.coalesce(
            F.concat(F.lit(" ("), c("load_problem"), F.lit(")")), F.lit(""))).alias("line")),
        *([F.struct(F.lit(6).alias("line_no"), F.when(
            c("action_issue_count").isNotNull(), F.concat(F.lit("- issues: "), fmt_count(c("action_issue_count")))).alias("line"))]
          if "action_issue_count" in audits.columns else []),
    ))).where("line IS NOT NULL")  # a profile has no columns, load or issues of its own
    if "audit_source" in audits.columns:
        real = F.count_if(c("audit_source") == "real_file")
        totals = totals.unionByName(audits.agg(F.count(F.lit(1)).alias("n"), real.alias("real")).select(
            F.lit("").alias("file"), F.lit(3).alias("line_no"),
            F.concat(F.lit("- real files: "), fmt_count(c("real")), F.lit(", profiles: "), fmt_count(c("n") - c("real"))).alias("line")))
    return totals.unionByName(media).unionByName(sections)


def plain_text(lines: DataFrame) -> DataFrame:
    """Markdown lines without '#' and '*'."""
    return lines.withColumn("line", F.regexp_replace("line", "[#*]", ""))


def write_report(lines: DataFrame, path: str, scope: Sequence[str] = ()) -> None:
    """Write the text of one report, or of every scope's: whole reports one after the other, with a manifest of their places."""
    if scope:
        write_scoped(lines, path, scope, ["section_no", "line_no"], text="line")
        return
    ordered = lines.coalesce(1).sortWithinPartitions("section_no", "line_no")
    ordered.select("line").write.mode("overwrite").text(path)
