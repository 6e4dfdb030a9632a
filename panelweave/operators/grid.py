"""Panel shapes: dense grids, long/wide, duplicates, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.numeric import clean
from panelweave.session import land

KEYS = ["date", "code"]


def value_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in KEYS]


def calendar_array(dates: DataFrame) -> Column:
    """All distinct dates as one sorted array, as a scalar subquery.

    The array holds at most one entry per day, so its size is bounded by the time span
    and not by the rows read.
    """
    return dates.agg(F.array_sort(F.collect_set("date"))).scalar()


def densify(panel: DataFrame, dates: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Every (date, code) cell of the grid, with NULL where ``panel`` has no row.

    Rolling windows count grid rows, so they need the gaps spelled out. The grid is exploded
    from the codes (no join over rows) and merged with the cells by one grouping. Rows come
    out partitioned by code; a code has at most one row per date, so no code can be hot.
    """
    values = value_columns(panel)
    dates = panel if dates is None else dates
    known = (panel if codes is None else codes).select("code").distinct()
    grid = known.select(F.explode(calendar_array(dates.select("date"))).alias("date"), "code")
    blank = [F.lit(None).cast(panel.schema[v].dataType).alias(v) for v in values]
    on_grid = grid.select("date", "code", F.lit(True).alias("_grid"), *blank)
    cells = panel.select("date", "code", F.lit(False).alias("_grid"), *values)
    merged = (
        on_grid.unionByName(cells)
        .repartition("code")
        .groupBy("date", "code")
        .agg(F.bool_or("_grid").alias("_grid"), *[F.max(v).alias(v) for v in values])
    )
    return merged.filter("_grid").drop("_grid")


def to_wide(panel: DataFrame, value: str, names: list[str], name: str = "code", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """One row per ``keys`` with a column per listed name: variables of a panel, or a named handful of codes."""
    return panel.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, names: list[str], value: str = "value", name: str = "code", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    return wide.unpivot(list(keys), names, name, value)


def dedup_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``.

    ``max_by`` keeps one row per key on the map side, so a key with very many copies is
    reduced before the shuffle. ``order`` must tell all rows of a key apart.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def order_like(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Rows in the requested code order, unknown codes last, then by date."""
    place = F.array_position(F.lit(codes), F.col("code"))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(codes) + 1), "code", "date")


def panel_from_matrix(df: DataFrame, dates: str = "dates", codes: str = "codes", values: str = "values") -> DataFrame:
    """Rows ``{dates[], codes[], values[][]}`` opened to one row per cell."""
    keep = [c for c in df.columns if c not in (dates, codes, values)]
    by_date = df.select(*keep, F.col(dates).alias("_d"), F.col(codes).alias("_c"), F.posexplode(values).alias("_i", "_row"))
    by_cell = by_date.select(*keep, "_d", "_c", "_i", F.posexplode("_row").alias("_j", "_v"))
    return by_cell.select(
        *keep,
        F.try_element_at("_d", F.col("_i") + 1).cast("date").alias("date"),
        F.try_element_at("_c", F.col("_j") + 1).alias("code"),
        clean(F.col("_v").cast("double")).alias("value"),
    )


def stack(panels: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Named panels below each other, with ``factor``, written once: each panel is computed once however often the stack is read."""
    stacked = None
    for name, panel in panels.items():
        one = panel.select("date", "code", F.lit(name).alias("factor"), F.col(value).alias("value"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return land(stacked, "stack")


def shared_by_all(stacked: DataFrame, axis: str, n: int) -> DataFrame:
    """The dates or codes that occur in all ``n`` panels of a stack."""
    return stacked.groupBy(axis).agg(F.size(F.collect_set("factor")).alias("_k")).filter(F.col("_k") == n).select(axis)


def within_shared(stacked: DataFrame, n: int) -> DataFrame:
    """The cells of a stack whose date and code occur in all ``n`` panels."""
    # Dates are at most one per day, which bounds what is broadcast.
    return stacked.join(shared_by_all(stacked, "code", n), "code", "left_semi").join(F.broadcast(shared_by_all(stacked, "date", n)), "date", "left_semi")


def inner_align(panels: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Stack named panels and keep only cells whose date and code occur in every one."""
    return within_shared(stack(panels, value), len(panels))


def outer_align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two panels side by side on the union of their cells."""
    return left.join(right, KEYS, "full_outer")


def blank_outside(panel: DataFrame, universe: DataFrame, *excluded: DataFrame) -> DataFrame:
    """Keep every grid row but set the values to NULL outside ``universe`` or inside a mask.

    Masks are row sets of (date, code). Flags are merged by grouping, so each side is read
    once and a later rolling window still sees an unbroken grid.
    """
    values = value_columns(panel)
    marks = universe.select("date", "code", F.lit(1).alias("_in"), F.lit(0).alias("_out"))
    for mask in excluded:
        marks = marks.unionByName(mask.select("date", "code", F.lit(0).alias("_in"), F.lit(1).alias("_out")))
    flags = marks.groupBy("date", "code").agg(F.max("_in").alias("_in"), F.max("_out").alias("_out"))
    keep = (F.coalesce("_in", F.lit(0)) == 1) & (F.coalesce("_out", F.lit(0)) == 0)
    return panel.join(flags, KEYS, "left").select(*KEYS, *[F.when(keep, F.col(v)).alias(v) for v in values])


def number_dates(dates: DataFrame, out: str = "idx") -> DataFrame:
    """0-based position of each distinct date. One row per day at most, so one task is enough."""
    return dates.select("date").distinct().withColumn(out, F.row_number().over(W.orderBy("date")) - 1)
