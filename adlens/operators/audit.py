"""Per-file audit of raw media reports (mapping, required-field status, readiness).

Input is the ``lines`` table of ``sources.reports`` (any number of files and
layouts). One job maps every file's header, standardises every data line in a
single projection, and audits per file with grouped aggregates; the analysis
issues per file reuse the scope-aware operators with ``scope=["file"]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlens.constants import (ALIAS_CANDIDATE_RULES, AUCTION_WORDS, CART_COUNT_ALIASES, DIMENSIONS, ELEVENST_WORDS,
                              GMARKET_WORDS, LEGACY_REPORT_WORDS, MARKETPLACE_MEDIA, MARKETPLACE_METADATA_HEADERS,
                              MEASURES, MEDIA_11ST, MEDIA_AUCTION, MEDIA_GMARKET, MEDIA_GMARKET_AUCTION, MEDIA_NAVER,
                              MEDIA_UNCLASSIFIED, NAVER_WORDS, UNCLASSIFIED)
from adlens.functions.columns import NUMERIC_TEXT, clean_dimension, clean_numeric, parse_date, valid_label, with_rates
from adlens.operators.ingest import map_headers, normalize_header
from adlens.operators.issues import action_issues
from adlens.session import materialize

OK, FAILED, UNKNOWN = "ok", "mapping_failed", "cannot_judge"
TEXT_FIELDS = ["account_name", "platform", "campaign_name", "ad_group_name"]
NUMERIC_FIELDS = ["impressions", "clicks", "cost", "conversions", "revenue"]
DERIVED = {"roas": "cost", "cpc": "clicks", "ctr": "impressions", "cvr": "clicks"}
STATUS_ORDER = ["date", "account_name", "platform", "campaign_name", "ad_group_name", "product_or_keyword",
                "impressions", "clicks", "cost", "conversions", "revenue", "cart_count", "roas", "cpc", "ctr", "cvr"]


def header_catalog_from_lines(lines: DataFrame) -> DataFrame:
    return lines.where("is_header").select(F.col("file").alias("source"),
                                           F.posexplode("fields").alias("position", "header"))


def _positions(mapping: DataFrame) -> DataFrame:
    """Per file: canonical name -> header position (bounded by the file's column count)."""
    return mapping.where(F.col("canonical").isNotNull()).groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("canonical", "position"))).alias("pos"))


def _extra_cells(mapping: DataFrame) -> DataFrame:
    """Per file: a map from name to position of the headers without a canonical name, in order.

    A blank header is named after its position and a repeated one numbered, as names are keys.
    """
    name = F.coalesce(F.nullif(F.trim("header"), F.lit("")), F.concat(F.lit("column_"), F.col("position").cast("string")))
    rest = mapping.where(F.col("canonical").isNull()).select("source", "position", name.alias("name"))
    nth = F.row_number().over(Window.partitionBy("source", "name").orderBy("position")) - 1
    rest = rest.withColumn("name", F.when(nth > 0, F.concat("name", F.lit("."), nth.cast("string"))).otherwise(F.col("name")))
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    return rest.groupBy("source").agg(F.map_from_arrays(F.transform(ordered, lambda x: x["name"]),
                                                        F.transform(ordered, lambda x: x["position"])).alias("_extra"))


def standardize_lines(lines: DataFrame, mapping: DataFrame, keep_extras: bool = False, keep_cart: bool = False) -> DataFrame:
    """All data lines of all files -> canonical fact with ``file`` and ``line_id``.

    With ``keep_extras`` the cells under headers without a canonical name pass through in
    ``extras``, a map from header to text. With ``keep_cart`` the cart count of the line is in
    ``_cart``, null in files without such a column.
    """
    canon = ["date"] + DIMENSIONS + MEASURES
    # Resolve each canonical column's position once per file (small table), so each
    # data line does plain array accesses; get() is null when absent / out of range.
    pos = _positions(mapping).select("source", *[F.col("pos")[F.lit(c)].alias(f"_p_{c}") for c in canon])
    if keep_cart:
        pos = pos.join(_cart_positions(mapping), "source", "full")
    data = lines.where(~F.col("is_header")).join(pos, lines.file == pos.source, "left")

    def raw(c: str) -> Column:
        return F.get(F.col("fields"), F.col(f"_p_{c}"))

    # Cells of one kind are cleaned as one array: thirteen cleaning expressions side by side
    # make a generated method too large for the JVM to compile, which then interprets it.
    kept = []
    if keep_extras:
        rest = _extra_cells(mapping).withColumnRenamed("source", "_extra_source")
        data = data.join(rest, data.file == F.col("_extra_source"), "left")
        empty = F.create_map().cast("map<string,string>")
        # the file's names are keys of every line's map: they are looked at for repeats once a file
        kept = [F.coalesce(F.transform_values("_extra", lambda _, at: F.get(F.col("fields"), at)), empty).alias("extras")]
    if keep_cart:
        kept.append(F.when(F.col("cart_pos").isNotNull(), _cart_count(F.get("fields", "cart_pos"))).alias("_cart"))
    cells = data.select("file", "line_id", *[F.transform(F.array(*map(raw, names)), clean).alias(kind) for kind, names, clean in (
        ("_dates", ["date"], parse_date), ("_dimensions", DIMENSIONS, clean_dimension), ("_measures", MEASURES, clean_numeric))], *kept)
    cols = [F.col("file"), F.col("line_id"), F.col("_dates")[0].alias("date")]
    cols += [F.col("_dimensions")[i].alias(d) for i, d in enumerate(DIMENSIONS)]
    cols += [F.col("_measures")[i].alias(m) for i, m in enumerate(MEASURES)]
    return with_rates(cells.select(*cols, *(["extras"] if keep_extras else []), *(["_cart"] if keep_cart else [])))


def infer_media_from_name(path) -> Column:
    """Media from file-name words: search ads, marketplace (both / one), 11st, else unclassified."""
    p = path if isinstance(path, Column) else F.col(path)
    text = normalize_header(p)

    def any_of(words):
        out = F.lit(False)
        for w in words:
            out = out | text.contains(normalize_header(F.lit(w)))
        return out
    return (F.when(any_of(NAVER_WORDS), F.lit(MEDIA_NAVER))
            .when(any_of(GMARKET_WORDS) & any_of(AUCTION_WORDS), F.lit(MEDIA_GMARKET_AUCTION))
            .when(any_of(GMARKET_WORDS), F.lit(MEDIA_GMARKET))
            .when(any_of(AUCTION_WORDS), F.lit(MEDIA_AUCTION))
            .when(any_of(ELEVENST_WORDS), F.lit(MEDIA_11ST))
            .otherwise(F.lit(MEDIA_UNCLASSIFIED)))


def report_version(path) -> Column:
    text = normalize_header(path if isinstance(path, Column) else F.col(path))
    hit = F.lit(False)
    for w in LEGACY_REPORT_WORDS:
        hit = hit | text.contains(w)
    return F.when(hit, F.lit("gmarket_auction_legacy_candidate")).otherwise(F.lit("unknown"))


def _file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _cart_positions(mapping: DataFrame) -> DataFrame:
    """Per file with a cart-count column: the position of the first one."""
    aliases = [normalize_header(F.lit(a)) for a in CART_COUNT_ALIASES]
    return mapping.where(F.col("header_norm").isin(*aliases)).groupBy("source").agg(F.min("position").alias("cart_pos"))


def _cart_count(cell: Column) -> Column:
    txt = F.trim(F.replace(cell, F.lit(",")))
    return F.coalesce(F.when(txt.rlike(NUMERIC_TEXT), txt.try_cast("double")), F.lit(0.0))


def _cart_totals(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per file: Σ of the first cart-count column (if any header is a cart alias)."""
    cart_pos = _cart_positions(mapping)
    data = lines.where(~F.col("is_header")).join(cart_pos, lines.file == cart_pos.source)
    return data.groupBy("file").agg(F.sum(_cart_count(F.get("fields", "cart_pos"))).alias("cart_total"))


def file_audit(lines: DataFrame, with_issues: bool = True, mapping: DataFrame | None = None,
               fact: DataFrame | None = None) -> DataFrame:
    """One row per file: load status, counts, mapping lists, required-field statuses, inferred
    media / advertiser, issue count and first five issue previews, readiness.

    A file that could not be read or is empty has a row too (``load_status`` failed). A caller
    that has mapped and standardised the lines passes ``mapping`` and ``fact``; otherwise the
    mapping is written once under the checkpoint folder, as several branches read it, and so is
    the fact if the issue engine reads it beside the per-file aggregates. The lines are then
    standardised once, cart counts included.
    """
    if mapping is None:
        mapping = materialize(map_headers(header_catalog_from_lines(lines)), "header-mapping")
    if fact is None:
        fact = standardize_lines(lines, mapping, keep_cart=True)
        if with_issues:
            fact = materialize(fact, "audit-fact")
    c = F.col
    maps = mapping.groupBy("source").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.map_from_entries(F.collect_list(F.when(c("canonical").isNotNull(), F.struct("header", "canonical"))))
        .alias("mapped_columns"),
        F.array_sort(F.collect_list(F.when(c("canonical").isNull(), F.struct("position", "header"))))
        .alias("_unmapped"),
        F.collect_set("canonical").alias("_canon"))
    maps = maps.select(c("source").alias("file"), "column_count", "mapped_columns",
                       F.transform("_unmapped", lambda s: s["header"]).alias("unmapped_columns"), "_canon")
    # first usable value in line order (ties on the line id broken by the value itself)
    first_valid = lambda col_name: F.min_by(
        c(col_name), F.when(valid_label(c(col_name)), F.struct(c("line_id"), c(col_name))))
    agg = fact.groupBy("file").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("date").alias("_dated"),
        *[F.bool_and(c(d) == UNCLASSIFIED).alias(f"_allu_{d}") for d in TEXT_FIELDS + ["product_name", "keyword"]],
        *[F.sum(m).alias(f"_sum_{m}") for m in NUMERIC_FIELDS],
        first_valid("platform").alias("_media"), first_valid("account_name").alias("_adv"),
        *([F.sum("_cart").alias("cart_total")] if "_cart" in fact.columns else []))
    files = lines.where("is_header").select("file", "problem")
    j = files.join(maps, "file", "left").join(agg, "file", "left")
    if "_cart" not in fact.columns:
        j = j.join(_cart_totals(lines, mapping), "file", "left")
    j = j.fillna({"row_count": 0})

    def mapped(col_name: str) -> Column:
        return F.coalesce(F.array_contains(c("_canon"), col_name), F.lit(False))

    def text_status(d: str) -> Column:
        return (F.when(~mapped(d), F.lit(FAILED))
                .when((c("row_count") == 0) | F.coalesce(c(f"_allu_{d}"), F.lit(True)), F.lit(UNKNOWN))
                .otherwise(F.lit(OK)))

    status = {"date": F.when(~mapped("date"), F.lit(FAILED)).when(F.coalesce(c("_dated"), F.lit(0)) == 0,
                                                                    F.lit(UNKNOWN)).otherwise(F.lit(OK))}
    for d in TEXT_FIELDS:
        status[d] = text_status(d)
    prod, kw = text_status("product_name"), text_status("keyword")
    status["product_or_keyword"] = (F.when((prod == OK) | (kw == OK), F.lit(OK))
                                    .when((prod == UNKNOWN) | (kw == UNKNOWN), F.lit(UNKNOWN)).otherwise(F.lit(FAILED)))
    for m in NUMERIC_FIELDS:
        status[m] = (F.when(~mapped(m), F.lit(FAILED)).when(F.coalesce(c(f"_sum_{m}"), F.lit(0.0)) == 0, F.lit(UNKNOWN))
                     .otherwise(F.lit(OK)))
    status["cart_count"] = F.when(F.coalesce(c("cart_total"), F.lit(0.0)) > 0, F.lit(OK)).otherwise(F.lit(UNKNOWN))
    for r, denom in DERIVED.items():
        status[r] = F.when(F.coalesce(c(f"_sum_{denom}"), F.lit(0.0)) == 0, F.lit(UNKNOWN)).otherwise(F.lit(OK))
    status_map = F.create_map(*[x for k in STATUS_ORDER for x in (F.lit(k), status[k])])
    media = F.coalesce(c("_media"), infer_media_from_name(c("file")))
    out = j.select(
        "file", "row_count", F.coalesce(c("column_count"), F.lit(0)).alias("column_count"), media.alias("inferred_media"),
        F.coalesce(c("_adv"), _file_stem(c("file"))).alias("advertiser"), "mapped_columns", "unmapped_columns",
        F.filter(F.array(*[F.lit(k) for k in
                           ["date", "platform", "account_name", "campaign_name", "ad_group_name", "keyword",
                            "product_name", "impressions", "clicks", "cost", "conversions", "revenue", "orders"]]),
                 lambda k: ~F.coalesce(F.array_contains(c("_canon"), k), F.lit(False))).alias("missing_columns"),
        status_map.alias("required_status"),
        F.filter(F.array(*[F.lit(k) for k in STATUS_ORDER]), lambda k: status_map[k] == UNKNOWN)
        .alias("unavailable_fields"),
        report_version(c("file")).alias("report_version"),
        F.when(c("problem").isNull(), F.lit("loaded")).otherwise(F.lit("failed")).alias("load_status"),
        c("problem").alias("load_problem"))
    out = out.withColumn("profile_label", profile_label(c("inferred_media"), c("report_version")))
    if not with_issues:
        return out
    issues = action_issues(fact, ["file"])
    summary = issues.groupBy("file").agg(
        F.count(F.lit(1)).alias("action_issue_count"),
        F.transform(F.array_sort(F.collect_list(F.when(c("issue_rank") <= 5, F.struct(
            "issue_rank", F.concat(c("problem"), F.lit(" / "), c("evidence")).alias("t"))))), lambda s: s["t"])
        .alias("action_issue_preview"))
    out = out.join(summary, "file", "left").fillna({"action_issue_count": 0})
    ready = readiness(c("action_issue_preview"), c("required_status"))
    return out.withColumn("readiness", F.when(c("load_status") == "failed", F.lit("fail")).otherwise(ready))


def readiness(preview: Column, status: Column) -> Column:
    """possible / limited / data_shortage from the issue previews and core statuses."""
    core_ok = F.lit(True)
    for m in NUMERIC_FIELDS:
        core_ok = core_ok & (status[m] == OK)
    shortage = F.exists(F.coalesce(preview, F.array().cast("array<string>")),
                        lambda t: t.startswith("insufficient data"))
    return (F.when(F.coalesce(F.size(preview), F.lit(0)) <= 0, F.lit("limited"))
            .when(shortage, F.lit("data_shortage")).when(core_ok, F.lit("possible")).otherwise(F.lit("limited")))


def profile_label(media: Column, version: Column) -> Column:
    return (F.when(media.isin(MARKETPLACE_MEDIA), F.lit("marketplace_legacy_candidate"))
            .when(media.isin(MEDIA_NAVER, MEDIA_11ST), F.lit("real_file_auto_diagnosis"))
            .when(version != "unknown", version).otherwise(F.lit("generic_ad_file")))


def media_validation(audits: DataFrame, media: list[str], profiles: DataFrame | None = None) -> DataFrame:
    """Validation status for each listed media: on a real file, on a profile audit only, or pending."""
    spark = audits.sparkSession
    wanted = spark.createDataFrame([(m,) for m in media], "inferred_media string")
    have = audits.groupBy("inferred_media").agg(F.count(F.lit(1)).alias("files"))
    j = wanted.join(have, "inferred_media", "left")
    known = F.lit(False)
    if profiles is not None:
        j = j.join(profiles.select("inferred_media").distinct().withColumn("_profile", F.lit(True)), "inferred_media", "left")
        known = F.coalesce("_profile", F.lit(False))
    return j.select("inferred_media", F.coalesce("files", F.lit(0)).alias("files"),
                    F.when(F.col("files") > 0, F.lit("validated_real_file")).when(known, F.lit("validated_profile"))
                    .otherwise(F.lit("pending_no_file")).alias("validation_status"))


def with_profile_audits(audits: DataFrame, profiles: DataFrame) -> DataFrame:
    """The audits of real files, and the profile audits of the media that have none, told apart by ``audit_source``.

    The audits are written once, as both branches read them: files aren't audited again for their media.
    """
    audits = materialize(audits, "file-audits")
    real = audits.select("inferred_media").distinct()
    rest = profiles.join(real, "inferred_media", "left_anti")
    return audits.withColumn("audit_source", F.lit("real_file")).unionByName(
        rest.withColumn("audit_source", F.lit("profile")), allowMissingColumns=True)


def alias_candidates(mapping: DataFrame) -> DataFrame:
    """Suggested canonical target for each unmapped header (ordered substring rules)."""
    text = F.lower(F.regexp_replace(F.trim(F.col("header")), " ", ""))
    meta = [m.lower().replace(" ", "") for m in MARKETPLACE_METADATA_HEADERS] + ["sourcesheet"]
    target = F.when(text.isin(meta), F.lit("metadata_hold"))
    for needles, tgt in ALIAS_CANDIDATE_RULES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | text.contains(n.lower().replace(" ", ""))
        target = target.when(hit, F.lit(tgt))
    target = target.otherwise(F.lit("needs_review"))
    return mapping.where(F.col("canonical").isNull()).select("source", "position", "header",
                                                             target.alias("suggested_target"))
