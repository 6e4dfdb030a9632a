"""Registered queries: each runs on the given tables and has an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.domain import Domain

DIGITS = 6
# Exact halves round differently in the two engines, so both sides are nudged off them.
NUDGE = 1e-10


@dataclass(frozen=True)
class Entry:
    build: Callable[[Domain], DataFrame]
    sql: str | None


QUERIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, nums: str = "", dates: str = "date"):
    """Register ``build(domain)`` under ``name``.

    ``nums`` and ``dates`` list the result's number and date columns for the SQL side: numbers
    are rounded and dates written as text on both sides, so that the values can be compared.
    """

    def add(build):
        final = None
        if sql is not None:
            swaps = [f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split()]
            swaps += [f"round(CAST({n} AS DOUBLE) + 1e-10, {DIGITS}) + 0.0 AS {n}" for n in nums.split()]
            final = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql}) AS q" if swaps else sql
        QUERIES[name] = Entry(build, final)
        return build

    return add


def finish(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out.append((F.round(F.col(f.name).cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(f.name))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def load() -> dict[str, Entry]:
    from panelweave.plans.registry import catalog, documents, events, evaluation, factors, formulas, joins, quality, scans  # noqa: F401

    return QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, e=e: finish(e.build(Domain(spark, folder)))) for name, e in load().items()}


def sql_texts() -> dict[str, str]:
    return {name: e.sql for name, e in load().items() if e.sql is not None}
