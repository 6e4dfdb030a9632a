"""Point-in-time alignment of revised reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.operators.grid import calendar_array


def pit_align(reports: DataFrame, dates: DataFrame, tie: list[str], offset_days: int = 1, value: str = "value") -> DataFrame:
    """What was known of each code on each date.

    A report is visible from its announcement plus ``offset_days``. The value shown is the one
    of the highest report period known so far and, within it, of the latest announcement, so
    a late revision of an old period never replaces a newer period. A NULL value that is the
    latest stays NULL. ``tie`` orders reports of one period announced on one day.

    Reports are first reduced to the best one per (code, day), on the map side. After that a
    code has at most one row per day, so its list and the running window stay small for every code.
    """
    known = reports.filter(
        F.col("code").isNotNull() & F.col("report_period").isNotNull() & F.col("announcement_date").isNotNull()
    )
    # Reports of a code and day were announced on one day, which need not move with each of them.
    ties = [f"_t{i}" for i in range(len(tie))]
    version = F.struct("report_period", *[F.col(t).alias(i) for t, i in zip(tie, ties, strict=True)], F.col(value).alias("_v"))
    best = known.groupBy("code", F.date_add("announcement_date", offset_days).alias("date")).agg(F.max(version).alias("_ver"))
    announced = F.date_sub("date", offset_days).alias("announcement_date")
    best = best.select("code", "date", F.struct("_ver.report_period", announced, *[f"_ver.{i}" for i in ties], "_ver._v").alias("_ver"))
    # The days of a code are made where its reports are (a row per day at most), so no cell of the grid is shuffled.
    cell = lambda date, ver, on_grid: F.struct(date.alias("date"), ver.alias("_ver"), F.lit(on_grid).alias("_grid"))
    empty = F.lit(None).cast(best.schema["_ver"].dataType)
    of_code = best.repartition("code").groupBy("code").agg(F.collect_list(cell(F.col("date"), F.col("_ver"), False)).alias("_known"))
    of_code = of_code.withColumn("_days", F.coalesce(calendar_array(dates), F.array().cast("array<date>")))
    cells = of_code.select("code", F.explode(F.concat("_known", F.transform("_days", lambda d: cell(d, empty, True)))).alias("_c")).select("code", "_c.*")
    merged = cells.groupBy("code", "date").agg(F.max("_ver").alias("_ver"), F.bool_or("_grid").alias("_grid"))
    so_far = W.partitionBy("code").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    filled = merged.withColumn("_now", F.max("_ver").over(so_far)).filter("_grid")
    return filled.select("date", "code", F.col("_now._v").alias(value), F.col("_now.report_period").alias("report_period"))
