"""Factor evaluation: does the value on a date order the returns that start on the next one?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.operators.grid import number_dates
from panelweave.operators.ordering import groups_fit, numbered, positions
from panelweave.session import freeze

MIN_CROSS_SECTION = 5


def align_forward(factor: DataFrame, returns: DataFrame) -> DataFrame:
    """``(date, code, x, y)``: the factor and the next return of the return calendar.

    Both panels are dense grids. Cells outside the shared dates and codes drop out; the last
    return date keeps its row with a missing return.
    """
    ahead = F.lead("value", 1).over(W.partitionBy("code").orderBy("date"))
    nxt = returns.select("date", "code", ahead.alias("y"))
    return factor.select("date", "code", F.col("value").alias("x")).join(nxt, ["date", "code"])


def align_columns(panel: DataFrame, factor: str, returns: str) -> DataFrame:
    """As ``align_forward`` when both are columns of one dense panel: a window and no join."""
    ahead = F.lead(returns, 1).over(W.partitionBy("code").orderBy("date"))
    return panel.select("date", "code", F.col(factor).alias("x"), ahead.alias("y"))


def date_sizes(aligned: DataFrame) -> DataFrame:
    """Usable and shared codes per date."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    return aligned.groupBy("date").agg(F.count_if(ok).alias("usable"), F.count(F.lit(1)).alias("shared"))


def usable_dates(aligned: DataFrame, min_cross_section: int = MIN_CROSS_SECTION) -> DataFrame:
    return date_sizes(aligned).withColumn("evaluated", F.col("usable") >= min_cross_section)


def usable_rows(aligned: DataFrame, min_cross_section: int = MIN_CROSS_SECTION) -> DataFrame:
    """Rows with both values, on dates with enough of them.

    While dates fit a task they are counted in a window, whose shuffle by date the ranks need
    anyway. Otherwise dates are counted by an aggregation and joined as a broadcast row per day.
    """
    both = aligned.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if groups_fit(aligned, ["date"]):
        counted = both.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("date")))
        return counted.filter(F.col("_c") >= min_cross_section).drop("_c")
    good = usable_dates(aligned, min_cross_section).filter("evaluated").select("date")
    return both.join(F.broadcast(good), "date", "left_semi")


def coverage(aligned: DataFrame, min_cross_section: int = MIN_CROSS_SECTION) -> DataFrame:
    dates = usable_dates(aligned, min_cross_section).filter("evaluated")
    return dates.agg(F.avg(F.col("usable") / F.col("shared")).alias("coverage_mean"), F.count(F.lit(1)).alias("evaluated_dates"))


def _pearson(x: str, y: str) -> Column:
    """Pearson correlation; a side without spread gives 0."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(flat, 0.0).otherwise(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))


def ic_series(usable: DataFrame) -> DataFrame:
    return usable.groupBy("date").agg(_pearson("x", "y").alias("ic"))


def with_ranks(usable: DataFrame) -> DataFrame:
    """Average-tie ranks of both sides within each date."""
    for side in ("x", "y"):
        usable = positions(usable, side, ["date"], ["code"]).withColumn(
            f"r{side}", (F.col("_lt") + 1 + F.col("_le")) / 2
        ).drop("_lt", "_le", "_n")
    return usable


def rank_ic_series(usable: DataFrame) -> DataFrame:
    return with_ranks(usable).groupBy("date").agg(_pearson("rx", "ry").alias("rank_ic"))


def check_groups(groups: int) -> None:
    if isinstance(groups, bool) or not isinstance(groups, int) or not 2 <= groups <= 20:
        raise ValueError("groups must be a whole number from 2 to 20")


def quantile_bucket(usable: DataFrame, groups: int = 5) -> DataFrame:
    """0-based bucket by first-come rank; dates with fewer distinct values than groups drop out.

    With r the rank and n the count, the bucket is ceil((r - 1) * groups / (n - 1)) - 1, at least 0,
    in whole numbers: the equal-width cut of the ranks.
    """
    check_groups(groups)
    if groups_fit(usable, ["date"]):
        day = W.partitionBy("date")
        ranked = usable.withColumns({
            "_rn": F.row_number().over(day.orderBy("x", "code")), "_k": F.dense_rank().over(day.orderBy("x")), "_n": F.count(F.lit(1)).over(day),
        })
        placed = ranked.withColumn("_d", F.max("_k").over(day)).filter(F.col("_d") >= groups).drop("_k", "_d")
    else:
        enough = usable.groupBy("date").agg(F.count_distinct("x").alias("_d")).filter(F.col("_d") >= groups)
        rows = usable.join(F.broadcast(enough.select("date")), "date", "left_semi")
        placed = numbered(rows, [F.col("x"), F.col("code")], ["date"])
    span = F.col("_n") - 1
    ceil = F.expr(f"((_rn - 1) * {int(groups)} + _n - 2) div (_n - 1)")
    bucket = F.when(span > 0, F.greatest(ceil, F.lit(1)) - 1).otherwise(0)
    return placed.withColumn("bucket", bucket.cast("int")).drop("_rn", "_n")


def quantile_returns(bucketed: DataFrame, groups: int | None = None) -> DataFrame:
    """Mean forward return per bucket: the mean within each date, then over dates."""
    daily = bucketed.groupBy("date", "bucket").agg(F.avg("y").alias("_m"))
    return daily.groupBy("bucket").agg(F.avg("_m").alias("mean_return"))


def spread_and_monotonic(means: DataFrame, groups: int = 5) -> DataFrame:
    """Top minus bottom mean, and whether the means never fall. At most 20 rows."""
    arr = F.array_sort(F.collect_list(F.struct("bucket", "mean_return")))
    one = means.agg(arr.alias("_a"))
    first, last = F.element_at("_a", 1).mean_return, F.element_at("_a", -1).mean_return
    rising = F.forall(
        F.sequence(F.lit(2), F.greatest(F.size("_a"), F.lit(2))),
        lambda i: F.try_element_at("_a", i).mean_return >= F.try_element_at("_a", i - 1).mean_return,
    )
    whole = (F.size("_a") == groups) & (F.size("_a") >= 2)
    return one.select(
        F.when(F.size("_a") > 0, last - first).otherwise(0.0).alias("long_short_spread"),
        (whole & F.coalesce(rising, F.lit(False))).alias("monotonic"),
    )


def turnover_series(bucketed: DataFrame, groups: int = 5) -> DataFrame:
    """Per bucketed date, the share of the previous top bucket's size that is new.

    A name stays if its previous top date is the one before; that needs one window per code,
    whose rows are at most one per date.
    """
    idx = number_dates(bucketed)
    top = bucketed.filter(F.col("bucket") == groups - 1).select("date", "code").join(F.broadcast(idx), "date")
    stays = F.lag("idx").over(W.partitionBy("code").orderBy("idx")) == F.col("idx") - 1
    per_date = top.withColumn("_stays", F.coalesce(stays, F.lit(False))).groupBy("date", "idx").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(~F.col("_stays")).alias("entered")
    )
    prev = F.lag("size").over(W.orderBy("idx"))  # one row per date
    return per_date.withColumn("_prev", prev).filter(F.col("_prev") > 0).select(
        "date", (F.col("entered") / F.col("_prev")).alias("turnover")
    )


def top_turnover(bucketed: DataFrame, groups: int = 5) -> DataFrame:
    return turnover_series(bucketed, groups).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover_mean"))


def summarise(series: DataFrame, col: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), share above zero, count, mean/deviation."""
    s = series.agg(
        F.avg(col).alias("mean"),
        F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("std"),
        F.avg((F.col(col) > 0).cast("double")).alias("positive_rate"),
        F.count(col).alias("count"),
    )
    return s.withColumn("ir", F.coalesce(F.try_divide("mean", F.nullif("std", F.lit(0.0))), F.lit(0.0)))


def analyze_factor(factor: DataFrame, returns: DataFrame, groups: int = 5, min_cross_section: int = MIN_CROSS_SECTION) -> DataFrame:
    """All measures in one row. Raises if nothing can be evaluated."""
    return analyze_aligned(align_forward(factor, returns), groups, min_cross_section)


def analyze_aligned(aligned: DataFrame, groups: int = 5, min_cross_section: int = MIN_CROSS_SECTION) -> DataFrame:
    """As ``analyze_factor`` for an aligned panel ``(date, code, x, y)``.

    Several measures read the aligned rows, so they are written once to the checkpoint folder
    instead of being computed again for each.
    """
    check_groups(groups)
    aligned = freeze(aligned)
    dates = usable_dates(aligned, min_cross_section)
    n, good = dates.agg(F.count(F.lit(1)), F.count_if("evaluated")).first()
    if n == 0:
        raise ValueError("the factor and the returns are empty or share no dates")
    if good == 0:
        raise ValueError(f"no date has at least {min_cross_section} usable codes")
    usable = usable_rows(aligned, min_cross_section)
    daily = with_ranks(usable).groupBy("date").agg(_pearson("x", "y").alias("ic"), _pearson("rx", "ry").alias("rank_ic"))
    bucketed = quantile_bucket(usable, groups)
    names = ("mean", "std", "positive_rate", "ir")
    stats = daily.agg(*[
        a for s in ("ic", "rank_ic") for a in (
            F.avg(s).alias(f"{s}_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"{s}_std"), F.avg((F.col(s) > 0).cast("double")).alias(f"{s}_positive_rate"))
    ])
    for s in ("ic", "rank_ic"):
        stats = stats.withColumn(f"{s}_ir", F.coalesce(F.try_divide(f"{s}_mean", F.nullif(f"{s}_std", F.lit(0.0))), F.lit(0.0)))
    parts = [
        stats.select(*[f"{s}_{k}" for s in ("ic", "rank_ic") for k in names]),
        spread_and_monotonic(quantile_returns(bucketed), groups),
        top_turnover(bucketed, groups),
        coverage(aligned, min_cross_section),
    ]
    # Each part is a single row.
    row = parts[0].withColumn("_k", F.lit(0))
    for p in parts[1:]:
        row = row.join(p.withColumn("_k", F.lit(0)), "_k")
    return row.drop("_k").withColumn("skipped_dates", F.lit(n - good))
