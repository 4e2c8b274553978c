"""Display formats: thousands separators, money, percent (half-even rounding)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlens.functions.columns import col_of

MONEY_SUFFIX = "원"


def fmt_count(c) -> Column:
    return F.format_number(F.coalesce(col_of(c).cast("double"), F.lit(0.0)), 0)


def fmt_money(c) -> Column:
    return F.concat(fmt_count(c), F.lit(MONEY_SUFFIX))


def fmt_percent(c) -> Column:
    """Ratio shown ×100 with two decimals and a percent sign."""
    return F.concat(F.format_number(F.coalesce(col_of(c).cast("double"), F.lit(0.0)) * 100, 2), F.lit("%"))
