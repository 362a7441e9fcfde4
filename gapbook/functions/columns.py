"""Scalar and aggregate column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_symbol(symbol: Column | str) -> Column:
    """Blanks at both ends off, upper case, dots as hyphens."""
    return F.replace(F.upper(F.regexp_replace(as_column(symbol), r"^\s+|\s+$", "")), F.lit("."), F.lit("-"))


def normal_symbol(symbol: str) -> str:
    """The same for a name that the caller holds."""
    return symbol.strip().upper().replace(".", "-")


def parse_symbols(text: Column | str) -> Column:
    """A list of tickers between newlines, spaces or commas: normalised, each once, in first order."""
    parts = F.filter(F.split(as_column(text), r"[\n ,]"), lambda s: F.trim(s) != "")
    return F.coalesce(F.array_distinct(F.transform(parts, normalize_symbol)), F.array().cast("array<string>"))


def clean_double(value: Column | str) -> Column:
    """A number, or null where it is missing, not a number or not numeric."""
    number = as_column(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division by zero."""
    return F.try_divide(top, bottom)


def sample_skewness(value: Column | str) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n, g1 = F.count(value).cast("double"), F.skewness(value)
    return F.when(n > 2, F.coalesce(finite(g1), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(value: Column | str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n, g2 = F.count(value).cast("double"), F.kurtosis(value)
    return F.when(
        n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * finite(g2) + 6)
    )


def market_cap_label(cap: Column | str) -> Column:
    """12.3T, 4.5B, 6.7M, or a dash."""
    c = as_column(cap)
    return (
        F.when(c.isNull() | (c <= 0), F.lit("-"))
        .when(c >= 1e12, F.format_string("%.2fT", c / 1e12))
        .when(c >= 1e9, F.format_string("%.1fB", c / 1e9))
        .otherwise(F.format_string("%.0fM", c / 1e6))
    )
