"""Security-code expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_exchange_code(code: Column) -> Column:
    """Vendor exchange suffix to the short one; other codes pass unchanged."""
    # fixed values: XSHG -> SH, XSHE -> SZ, XBSE -> BJ
    out = F.regexp_replace(code, r"\.XSHG$", ".SH")
    out = F.regexp_replace(out, r"\.XSHE$", ".SZ")
    return F.regexp_replace(out, r"\.XBSE$", ".BJ")


def looks_like_index(code: Column) -> Column:
    """Whether a code names an index rather than a stock."""
    # fixed values: index-only suffixes, and the index number ranges of two exchanges
    suffix = F.upper(F.regexp_extract(code, r"\.([^.]*)$", 1))
    return (
        suffix.isin("WI", "CI", "CSI")
        | ((suffix == "SH") & code.rlike("^(000|999)"))
        | ((suffix == "SZ") & code.startswith("399"))
    )


def board_type(number: Column, board_name: Column) -> Column:
    """Listing board by number prefix, or by the board's name for the growth board."""
    # fixed values: number prefixes of the boards
    return (
        F.when(number.startswith("688"), "STAR")
        .when(number.startswith("300") | F.contains(board_name, F.lit("创业")), "GEM")
        .when(number.startswith("8") | number.startswith("4"), "BSE")
        .otherwise("MainBoard")
    )


def exchange_of(code: Column) -> Column:
    return F.when(code.endswith(".SH"), "SH").when(code.endswith(".SZ"), "SZ").otherwise("BJ")


def padded(code: Column, keep: int, width: int = 16) -> Column:
    """First ``keep`` characters, filled with zeros on the right to ``width``."""
    return F.rpad(F.substring(code, 1, keep), width, "0")


def pad_to(code: Column, width: int = 16) -> Column:
    """Zeros on the right up to ``width``; longer codes are left whole."""
    return F.when(F.length(code) >= width, code).otherwise(F.rpad(code, width, "0"))


def dashed_date(text: Column) -> Column:
    """``yyyyMMdd`` text with dashes; missing reads as the all-zero date."""
    return (
        F.when(text.isNull(), "0000-00-00")
        .when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
        .otherwise(text)
    )
