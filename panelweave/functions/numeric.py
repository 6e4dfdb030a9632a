"""Column expressions for the missing-value rules: NULL is the only missing marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """NaN becomes NULL; Spark sorts NaN above every number and lets it survive ``max``."""
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def divide(a: Column, b: Column) -> Column:
    """Quotient; a zero divisor or an overflow gives NULL."""
    return finite(F.try_divide(a, b))


def natural_log(value: Column) -> Column:
    """ln, NULL for zero and below."""
    return F.when(value > 0, F.ln(value))


def to_number(text: Column) -> Column:
    """Number read from text; text that is no number gives NULL."""
    return clean(text.cast("string").try_cast("double"))


def lenient_date(text: Column) -> Column:
    """``yyyyMMdd`` first, then any date Spark can cast; otherwise NULL."""
    s = F.trim(text.cast("string"))
    eight = F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(eight, s.try_cast("date"))


def open_end(end: Column, text: bool = False) -> Column:
    """NULL, blank and far-future end marks all read as NULL (an open interval)."""
    if text:
        # fixed values: end marks used by the source tables
        return F.when(~F.trim(end).isin("", "99999999", "22001231"), end)
    return F.when(end < F.lit("2200-12-31").cast("date"), end)
