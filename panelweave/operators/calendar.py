"""Trading calendar operators. A calendar holds one row per day, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.numeric import lenient_date
from panelweave.operators.grid import calendar_array

# fixed values: exchanges of each market
MARKET_EXCHANGES = {"cn": ["SSE", "SZSE"], "hk": ["HKEX"]}
WARMUP_FACTOR = 1.6
WARMUP_EXTRA_DAYS = 5


def trading_days(calendar: DataFrame, market: str = "cn", day: str = "trade_days", exchange: str = "s_info_exchmarket") -> DataFrame:
    """Distinct days on which an exchange of the market trades."""
    names = MARKET_EXCHANGES["hk" if market.lower() == "hk" else "cn"]
    return calendar.filter(F.col(exchange).isin(names)).select(lenient_date(F.col(day)).alias("date")).distinct()


def trading_dates(days: DataFrame, start: str, end: str) -> DataFrame:
    return days.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _shifted(df: DataFrame, col: str, n: int, days: DataFrame, out: str) -> DataFrame:
    """``n`` trading days away from ``col``; clamped at the calendar's end, NULL beyond it.

    Only the distinct dates of ``df`` (a few thousand at most) are looked up; the result is
    then joined back as a small table keyed by date.
    """
    if n == 0:
        return df.withColumn(out, F.col(col).cast("date"))
    cal = calendar_array(days)
    asked = df.select(F.col(col).cast("date").alias("_at")).distinct().withColumn("_cal", cal)
    if n > 0:
        after = F.filter("_cal", lambda d: d > F.col("_at"))
        found = F.try_element_at(after, F.least(F.lit(n), F.size(after)))
    else:
        before = F.filter("_cal", lambda d: d < F.col("_at"))
        found = F.try_element_at(before, F.greatest(F.lit(1), F.size(before) + F.lit(1 + n)))
    looked_up = asked.select("_at", F.when(F.size(after if n > 0 else before) > 0, found).alias(out))
    return df.join(F.broadcast(looked_up), F.col(col).cast("date") == F.col("_at"), "left").drop("_at")


def next_trading_date(df: DataFrame, col: str, n: int, days: DataFrame, out: str = "next_date") -> DataFrame:
    return _shifted(df, col, n, days, out)


def prev_trading_date(df: DataFrame, col: str, n: int, days: DataFrame, out: str = "prev_date") -> DataFrame:
    return _shifted(df, col, -n, days, out)


def warmup_start(start: Column, window: int) -> Column:
    """First calendar day to read so that a ``window`` of trading days is complete at ``start``."""
    return F.date_sub(start, int(WARMUP_FACTOR * window) + WARMUP_EXTRA_DAYS)


def trim(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Drop warm-up rows from a result."""
    return trading_dates(panel, start, end)


def rebalance_dates(panel: DataFrame, every: str) -> DataFrame:
    """Last available date of each ISO week or calendar month."""
    if every not in ("weekly", "monthly"):
        raise ValueError(f"rebalance must be weekly or monthly, got {every!r}")
    period = F.date_trunc("week" if every == "weekly" else "month", "date")
    return panel.groupBy(period.alias("_p")).agg(F.max("date").alias("date")).select("date")
