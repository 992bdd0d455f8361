"""Numbers at the stage boundaries: ten decimals, safe division, lenient parsing, UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Similarities and scores are carried as whole numbers of this unit's reciprocal: ten decimals.
TEN = 10**10


def _tens(value: Column) -> tuple[Column, Column]:
    """Whether a double's tenth decimal is sure without its decimal digits, and the double as a whole number of 1e-10 then.

    Below 10 the product is off by less than 1e-4, so only what lies nearer to a half than a hundredth needs the digits.
    """
    times = value * F.lit(float(TEN))
    return (value >= 0) & (value < 10) & (F.abs(times - F.floor(times) - 0.5) > 0.01), F.floor(times + 0.5)


def ten_decimals(value: Column) -> Column:
    """A double rounded half up at the tenth decimal, as a whole number of 1e-10: exact to add in any order."""
    sure, whole = _tens(value)
    return F.when(sure, whole).otherwise((value.cast("decimal(12,10)") * F.lit(TEN)).cast("long"))


def ten_rounded(value: Column) -> Column:
    """A double rounded half up at the tenth decimal."""
    sure, whole = _tens(value)
    return F.when(sure, from_ten(whole)).otherwise(F.round(value, 10))


def from_ten(whole: Column) -> Column:
    return whole.cast("double") / F.lit(float(TEN))


def ten_text(value: Column) -> Column:
    """Ten decimals as text."""
    sure, whole = _tens(value)
    plain = F.concat((whole / F.lit(TEN)).cast("int").cast("string"), F.lit("."), F.lpad((whole % F.lit(TEN)).cast("string"), 10, "0"))
    return F.when(sure, plain).otherwise(F.format_string("%.10f", value))


def safe_divide(a: Column, b: Column) -> Column:
    """Null where either is null or the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def lenient_double(text: Column) -> Column:
    """Null for blank, non-numeric, NaN and infinite texts."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lenient_long(text: Column) -> Column:
    return F.trim(text).try_cast("long")


def utc_text(seconds: Column) -> Column:
    """Unix seconds as YYYY-MM-DDTHH:MM:SSZ; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
