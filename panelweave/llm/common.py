"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.session import freeze

# Fixed pattern: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it.

    Spark evaluates an expression again at each mention inside a lambda; binding it as the
    only element of an array does not.
    """
    return F.transform(F.array(value), body)[0]


def running(items: Column, weight: Callable[[Column], Column], join: Callable[[Column, Column], Column] = lambda s, x: s + x, block: int = 512) -> Column:
    """For an array, the sum of ``weight`` over the items before each one, as an array of longs.

    ``join`` may be another associative operation with 0 as its neutral value, such as the greatest
    of non-negative numbers. It runs inside blocks and over the blocks, so the copies that growing
    an array takes stay near ``block`` times the items, not their square.
    """

    def before_each(parts: Column, start: Column) -> Column:
        state = F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda s, w: F.struct(join(s["at"], w).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(parts, state, step, lambda s: s["out"])

    def whole(weights: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(weights) - 1) / block).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(weights, b * block + 1, F.lit(block)))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: join(s, x)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before_each(totals(bs), F.lit(0)), before_each)))

    return F.when(F.size(items) > 0, let(F.transform(items, lambda x: weight(x).cast("long")), whole)).otherwise(F.array().cast("array<long>"))


def fresh(*taken: DataFrame) -> Callable[[str], str]:
    """Column names that no given table has, so that extra columns of any name do no harm."""
    used = {c.lower() for df in taken for c in df.columns}
    tag = uuid.uuid4().hex[:8]
    return lambda name: name if name.lower() not in used else f"__{name}_{tag}"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Frozen rows with a number of their own, the same at every later read."""
    return freeze(df.withColumn(name, F.monotonically_increasing_id()))
