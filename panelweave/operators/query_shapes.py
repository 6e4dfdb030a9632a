"""The six controlled selections over a source table, and what is done to their result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.codes import to_exchange_code
from panelweave.functions.numeric import lenient_date, to_number
from panelweave.operators.grid import dedup_last

NAME = re.compile(r"[a-z][a-z0-9_]*")
# fixed values: roles each shape needs
REQUIRED_ROLES = {
    "point_range": ("observation_date",),
    "report_period": ("report_period",),
    "announcement_range": ("announcement_date",),
    "interval_overlap": ("interval_start", "interval_end"),
    "cross_section_asof": ("observation_date",),
    "static_lookup": (),
}
# A longer list of codes is joined instead of being written into the filter.
ISIN_LIMIT = 1000


def check_columns(df: DataFrame, cols: list[str]) -> None:
    """Every name is a plain identifier and a column of ``df``."""
    for c in cols:
        if not NAME.fullmatch(str(c)):
            raise ValueError(f"not a safe identifier: {c!r}")
    unknown = sorted(set(cols) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns {unknown}")


def check_roles(shape: str, roles: dict[str, str]) -> None:
    if shape not in REQUIRED_ROLES:
        raise ValueError(f"unsupported query shape {shape!r}")
    missing = [r for r in REQUIRED_ROLES[shape] if r not in roles]
    if missing:
        raise ValueError(f"{shape} is missing roles {missing}")


def only_codes(df: DataFrame, code_col: str, codes: list[str] | DataFrame | None) -> DataFrame:
    """Restrict to codes: a pushed-down IN for a short list, a semi-join for a table of codes."""
    if codes is None:
        return df
    if isinstance(codes, DataFrame):
        return df.join(codes.select(F.col("code").alias(code_col)).distinct(), code_col, "left_semi")
    codes = list(dict.fromkeys(codes))
    if len(codes) > ISIN_LIMIT:
        return only_codes(df, code_col, df.sparkSession.createDataFrame([(c,) for c in codes], ["code"]))
    return df.filter(F.col(code_col).isin(*codes))


def _between(col: str, start, end) -> Column:
    """Compare in the column's own type, so that the filter reaches the scan."""
    return F.col(col).between(F.lit(start), F.lit(end))


def scan_bars(df: DataFrame, codes, start, end, cols: list[str], code_col: str = "code", date_col: str = "date") -> DataFrame:
    check_columns(df, [code_col, date_col, *cols])
    return only_codes(df, code_col, codes).filter(_between(date_col, start, end)).select(code_col, date_col, *cols)


def point_range(df, codes, code_col, date_col, start, end, fields) -> DataFrame:
    check_columns(df, [code_col, date_col, *fields])
    return only_codes(df, code_col, codes).filter(_between(date_col, start, end)).select(code_col, date_col, *fields)


def report_period(df, codes, code_col, period_col, start, end, fields, ann_col=None, as_of=None) -> DataFrame:
    roles = [period_col] + ([ann_col] if ann_col else [])
    check_columns(df, [code_col, *roles, *fields])
    got = only_codes(df, code_col, codes).filter(_between(period_col, start, end))
    if ann_col and as_of is not None:
        got = got.filter(F.col(ann_col) <= F.lit(as_of))
    return got.select(code_col, *roles, *fields)


def announcement_range(df, codes, code_col, ann_col, start, end, fields) -> DataFrame:
    return point_range(df, codes, code_col, ann_col, start, end, fields)


def interval_overlap(df, codes, code_col, start_col, end_col, start, end, fields) -> DataFrame:
    """Intervals that touch [start, end]; both ends count and a NULL or blank end is open."""
    check_columns(df, [code_col, start_col, end_col, *fields])
    e = F.col(end_col)
    is_open = e.isNull() | (e == "") if df.schema[end_col].dataType.typeName() == "string" else e.isNull()
    got = only_codes(df, code_col, codes).filter((F.col(start_col) <= F.lit(end)) & (is_open | (e >= F.lit(start))))
    return got.select(code_col, start_col, end_col, *fields)


def cross_section_asof(df, codes, code_col, date_col, end, fields, latest=False, tie=()) -> DataFrame:
    """Rows up to ``end``; with ``latest`` only the last one per code."""
    check_columns(df, [code_col, date_col, *fields, *tie])
    got = only_codes(df, code_col, codes).filter(F.col(date_col) <= F.lit(end))
    if latest:
        cols = list(dict.fromkeys([code_col, date_col, *tie, *fields]))
        got = dedup_last(got.select(*cols), [code_col], [date_col, *tie])
    return got.select(code_col, date_col, *fields)


def static_lookup(df, codes, code_col, fields) -> DataFrame:
    check_columns(df, [code_col, *fields])
    return only_codes(df, code_col, codes).select(code_col, *fields)


def latest_announcement(df, keys: list[str], ann: str, tie: list[str] = ()) -> DataFrame:
    """Last announcement per key; ``tie`` orders rows announced on the same day."""
    return dedup_last(df, keys, [ann, *tie])


def normalise_roles(df: DataFrame, code_col: str, roles: dict[str, str], numeric: list[str] = ()) -> DataFrame:
    """Role columns as dates under their role names, values as numbers, the code as ``code``."""
    check_columns(df, [code_col, *roles.values()])
    taken = {code_col, *roles.values()}
    return df.select(
        to_exchange_code(F.col(code_col)).alias("code"),
        *[lenient_date(F.col(c)).alias(r) for r, c in roles.items()],
        *[to_number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns if c not in taken],
    )


def with_lineage(df: DataFrame, table: str, fields: list[str]) -> DataFrame:
    return df.withColumns({"source_table": F.lit(table), "source_fields": F.lit(",".join(fields))})
