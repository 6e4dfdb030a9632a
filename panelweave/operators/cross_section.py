"""Operators across the codes of one date.

While no date is too large for a task, statistics are windows by date: steps that follow each
other share one shuffle and the panel is computed once. Otherwise they are aggregated (pre-summed
on the map side) and joined back as a table with one row per day, which may be broadcast
whatever the panel's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.operators.ordering import groups_fit, positions

DATE = ["date"]
FEW_INDUSTRIES = 200


def _fits(panel: DataFrame, fits: bool | None) -> bool:
    return groups_fit(panel, DATE) if fits is None else fits


def percentile_rank(panel: DataFrame, value: str, out: str, keys: list[str] = DATE) -> DataFrame:
    """Average-tie rank divided by the number of non-missing values; missing stays missing."""
    placed = positions(panel, value, keys, ["code"])
    pct = (F.col("_lt") + 1 + F.col("_le")) / 2 / F.col("_n")
    return placed.select(*panel.columns, F.when(F.col(value).isNotNull(), pct).alias(out))


def with_date_stats(panel: DataFrame, *aggs: Column) -> DataFrame:
    """Attach per-date aggregates to every row."""
    return panel.join(F.broadcast(panel.groupBy("date").agg(*aggs)), "date")


def winsorize(panel: DataFrame, cols: list[str], lower: float = 0.01, upper: float = 0.99, fits: bool | None = None) -> DataFrame:
    """Clip each column to its own per-date quantiles (linear interpolation between values)."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("need 0 <= lower < upper <= 1")
    if _fits(panel, fits):
        found = panel.withColumns({f"_{side}_{c}": F.percentile(c, F.lit(p)).over(W.partitionBy("date")) for c in cols for side, p in (("lo", lower), ("hi", upper))})
    else:
        bounds = None
        for c in cols:
            one = _quantiles_by_position(panel, c, {f"_lo_{c}": lower, f"_hi_{c}": upper})
            bounds = one if bounds is None else bounds.join(one, "date", "full_outer")
        found = panel.join(F.broadcast(bounds), "date", "left")
    clipped = [
        F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))).alias(c)
        if c in cols else F.col(c)
        for c in panel.columns
    ]
    return found.select(*clipped)


def _quantiles_by_position(panel: DataFrame, col: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles from ordered positions: no group is held in memory."""
    placed = positions(panel.select("date", "code", col), col, DATE, ["code"])
    aggs = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        pick = lambda k: F.max(F.when((F.col("_lt") <= k) & (k < F.col("_le")), F.col(col)))
        aggs += [pick(lo).alias(f"{name}_a"), pick(hi).alias(f"{name}_b"), F.max(at - lo).alias(f"{name}_f")]
    got = placed.groupBy("date").agg(*aggs)
    blend = [
        (F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_f")).alias(n) for n in wanted
    ]
    return got.select("date", *blend)


def zscore(panel: DataFrame, cols: list[str], fits: bool | None = None) -> DataFrame:
    """(x - mean) / sample deviation per date; a date without spread gives missing."""
    stats = {n: a for c in cols for n, a in ((f"_m_{c}", F.avg(c)), (f"_s_{c}", F.stddev_samp(c)))}
    if _fits(panel, fits):
        found = panel.withColumns({n: a.over(W.partitionBy("date")) for n, a in stats.items()})
    else:
        found = with_date_stats(panel, *[a.alias(n) for n, a in stats.items()])
    scored = [
        F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).alias(c)
        if c in cols else F.col(c)
        for c in panel.columns
    ]
    return found.select(*scored)


def industry_neutralize(panel: DataFrame, cols: list[str], industries: DataFrame, fits: bool | None = None) -> DataFrame:
    """Subtract the mean of the row's industry on its date.

    Every code must have exactly one industry; a missing or partial map is refused.
    """
    mapped = industries.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("code").alias("codes"), F.count_distinct("industry").alias("industries")
    ).first()
    if mapped.rows != mapped.codes:
        raise ValueError("a code has more than one industry")
    if panel.select("code").distinct().join(industries, "code", "left_anti").limit(1).count():
        raise ValueError("the industry map does not cover every code of the panel")
    tagged = panel.join(industries.select("code", F.col("industry").alias("_ind")), "code")
    out = [(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in panel.columns]
    if _fits(panel, fits):
        # Rows shuffled by date serve the (date, industry) window as well.
        spread_out = tagged.withColumns({f"_m_{c}": F.avg(c).over(W.partitionBy("date", "_ind")) for c in cols})
        return spread_out.select(*out)
    means = tagged.groupBy("date", "_ind").agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    if mapped.industries <= FEW_INDUSTRIES:
        # At most one row per day and industry, with few industries.
        means = F.broadcast(means)
    return tagged.join(means, ["date", "_ind"]).select(*out)


def fillna(panel: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    return panel.select(*[F.coalesce(F.col(c), F.lit(float(value))).alias(c) if c in cols else F.col(c) for c in panel.columns])
