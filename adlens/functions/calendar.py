"""Calendar labels (seven grains) and date-range presets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlens.constants import (AUTUMN, DAY_WORD, FIRST_HALF, MONTH_WORD, QUARTER_WORD, SECOND_HALF, SPRING, SUMMER,
                              WEEK_WORD, WINTER, YEAR_WORD)
from adlens.functions.columns import col_of


def _year(d: Column) -> Column:
    return F.year(d).cast("string")


def season_name(month: Column) -> Column:
    return (F.when(month.isin(3, 4, 5), SPRING).when(month.isin(6, 7, 8), SUMMER)
            .when(month.isin(9, 10, 11), AUTUMN).otherwise(WINTER))


def period_label(grain: str, d) -> Column:
    """Label of the calendar bucket containing timestamp/date ``d`` for one grain."""
    d = col_of(d)
    if grain == "daily":
        return F.date_format(d, f"yyyy{YEAR_WORD} MM{MONTH_WORD} dd{DAY_WORD}")
    if grain == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit(f"{YEAR_WORD} "),
                        F.weekofyear(d).cast("string"), F.lit(WEEK_WORD))
    if grain == "monthly":
        return F.date_format(d, f"yyyy{YEAR_WORD} MM{MONTH_WORD}")
    if grain == "quarterly":
        return F.concat(_year(d), F.lit(f"{YEAR_WORD} "), F.quarter(d).cast("string"), F.lit(QUARTER_WORD))
    if grain == "half_year":
        return F.concat(_year(d), F.lit(f"{YEAR_WORD} "), F.when(F.month(d) <= 6, FIRST_HALF).otherwise(SECOND_HALF))
    if grain == "yearly":
        return F.concat(_year(d), F.lit(YEAR_WORD))
    if grain == "seasonal":
        # Prefixed by the calendar year: Jan/Feb and Dec of one year share a winter label.
        return F.concat(_year(d), F.lit(f"{YEAR_WORD} "), season_name(F.month(d)))
    raise ValueError(f"unknown grain {grain!r}")


def season_start(d) -> Column:
    """First day of the contiguous season holding date ``d`` (winter = Dec .. Feb)."""
    d = col_of(d)
    y, m = F.year(d), F.month(d)
    return (F.when(m.isin(3, 4, 5), F.make_date(y, F.lit(3), F.lit(1)))
            .when(m.isin(6, 7, 8), F.make_date(y, F.lit(6), F.lit(1)))
            .when(m.isin(9, 10, 11), F.make_date(y, F.lit(9), F.lit(1)))
            .when(m == 12, F.make_date(y, F.lit(12), F.lit(1)))
            .otherwise(F.make_date(y - 1, F.lit(12), F.lit(1))))


def half_start(d) -> Column:
    d = col_of(d)
    return F.make_date(F.year(d), F.when(F.month(d) <= 6, F.lit(1)).otherwise(F.lit(7)), F.lit(1))


def preset_range(preset: str, anchor) -> tuple[Column, Column]:
    """(start, end) DATE columns of a named preset relative to ``anchor`` (a DATE column)."""
    a = col_of(anchor)
    if preset == "yesterday":
        y = F.date_sub(a, 1)
        return y, y
    if preset == "last_15_days":
        return F.date_sub(a, 14), a
    if preset == "this_month":
        return F.trunc(a, "month"), a
    if preset == "last_month":
        first = F.trunc(a, "month")
        return F.add_months(first, -1), F.date_sub(first, 1)
    if preset == "last_week":
        week_start = F.date_trunc("week", a).cast("date")
        end = F.date_sub(week_start, 1)
        return F.date_sub(end, 6), end
    if preset == "last_quarter":
        end = F.date_sub(F.trunc(a, "quarter"), 1)
        return F.trunc(end, "quarter"), end
    if preset == "last_half":
        end = F.date_sub(half_start(a), 1)
        return half_start(end), end
    if preset == "last_season":
        end = F.date_sub(season_start(a), 1)
        return season_start(end), end
    return F.date_sub(a, 6), a
