"""Null-safe arithmetic and cleaning expressions for the canonical fact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlens.constants import NA_TOKENS, RATES, UNCLASSIFIED

# A plain decimal / scientific literal; anything else ('1d', '1.5f', 'nan', 'abc') is not a number.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The same, and nothing after it ('$' also stands before a line break at the end).
BARE_NUMBER = NUMERIC_TEXT[:-1] + r"\z"
BARE_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so it does not depend on the session time zone."""
    return F.lit(value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()).cast("timestamp_ntz")


def safe_div(numerator, denominator) -> Column:
    """numerator / denominator as DOUBLE; 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(col_of(numerator).cast("double"), col_of(denominator).cast("double")), F.lit(0.0))


def rate_exprs(prefix: str = "") -> dict[str, Column]:
    """The five derived ratios over (already summed) measure columns."""
    p = prefix
    return {
        "ctr": safe_div(f"{p}clicks", f"{p}impressions"),
        "cpc": safe_div(f"{p}cost", f"{p}clicks"),
        "cvr": safe_div(f"{p}conversions", f"{p}clicks"),
        "cpa": safe_div(f"{p}cost", f"{p}conversions"),
        "roas": safe_div(f"{p}revenue", f"{p}cost"),
    }


def with_rates(df, prefix: str = ""):
    exprs = rate_exprs(prefix)
    return df.withColumns({f"{prefix}{k}": exprs[k] for k in RATES})


def null_na_tokens(c) -> Column:
    """Null out the default CSV null tokens (compared on the raw, untrimmed text)."""
    c = col_of(c)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c.cast("string"))


# What a cell is stripped of: all white space, tabs and no-break spaces included.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2007\u202f\u3000"


def strip(c) -> Column:
    return F.btrim(col_of(c), F.lit(BLANKS))


def clean_numeric(c) -> Column:
    """Text measure -> DOUBLE: drop ',', '원', '%', strip, parse; anything unparseable -> 0.

    A percent sign is removed, not divided by 100. Null tokens are not numbers, so they are 0 too.
    Text that is a number as it stands is parsed at once.
    """
    raw = col_of(c).cast("string")
    text = strip(F.translate(raw, ",원%", ""))
    return F.coalesce(F.when(raw.rlike(BARE_NUMBER), raw.try_cast("double")).when(text.rlike(NUMERIC_TEXT), text.try_cast("double")),
                      F.lit(0.0))


def clean_dimension(c) -> Column:
    """Null / blank / null-token text -> the 'unclassified' label; otherwise stripped text."""
    text = strip(null_na_tokens(c))
    return F.when(text != "", text).otherwise(F.lit(UNCLASSIFIED))


# Year-first dates with other separators are rewritten to ISO; the rest is parsed by layout,
# each tried only on text of its own shape (a failed pattern parse costs a JVM exception per row).
YEAR_FIRST = r"^([0-9]{4})(?:[/.]|년 ?)([0-9]{1,2})(?:[/.]|월 ?)([0-9]{1,2})일?(?= |T|$)"
SHAPED_DATE_FORMATS = [
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$", "M/d/yyyy H:mm"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M/d/yyyy H:mm:ss"),
]


def parse_date(c) -> Column:
    """Free text -> TIMESTAMP_NTZ; unparseable -> null.

    ISO and other year-first dates, with or without a time, go through the exception-free
    cast (a bare ISO date at once); the layouts of ``SHAPED_DATE_FORMATS`` are parsed only when the
    text has that shape.
    """
    raw = col_of(c).cast("string")
    text = strip(raw)
    iso = F.regexp_replace(text, YEAR_FIRST, "$1-$2-$3").try_cast("timestamp_ntz")
    shaped = F.lit(None).cast("timestamp")
    for pattern, fmt in reversed(SHAPED_DATE_FORMATS):
        shaped = F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(fmt))).otherwise(shaped)
    free = F.coalesce(F.when(~text.rlike(r"^[0-9]{8}$"), iso), shaped.cast("timestamp_ntz"))
    return F.when(raw.rlike(BARE_DATE), raw.try_cast("timestamp_ntz")).otherwise(free)


def valid_label(c) -> Column:
    """True for a usable label: not blank and not the 'unclassified' value."""
    c = col_of(c)
    return c.isNotNull() & (F.trim(c) != "") & (c != UNCLASSIFIED)


def first_valid(*cols) -> Column:
    """First usable label among ``cols``, else the 'unclassified' label."""
    return F.coalesce(*[F.when(valid_label(c), col_of(c)) for c in cols], F.lit(UNCLASSIFIED))
