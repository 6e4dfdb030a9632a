import datetime as dt

import pytest
from conftest import wide

from panelweave.operators import asof, calendar as cal, masks

D = dt.date.fromisoformat


def days(spark, *names):
    return spark.createDataFrame([(D(n),) for n in names], "date date")


def reports(spark, *rows):
    return spark.createDataFrame([("000001.SZ", D(p), D(a), v) for p, a, v in rows], "code string, report_period date, announcement_date date, value double")


def test_not_visible_before_the_day_after(spark):
    r = reports(spark, ("2022-12-31", "2023-03-31", 10.0))
    got = wide(asof.pit_align(r, days(spark, "2023-03-31", "2023-04-01"), []))
    assert got["000001.SZ"] == [None, 10.0]
    assert wide(asof.pit_align(r, days(spark, "2023-03-31"), [], offset_days=0))["000001.SZ"] == [10.0]


def test_late_revision_of_an_old_period_does_not_win(spark):
    r = reports(spark, ("2022-12-31", "2023-03-31", 10.0), ("2023-03-31", "2023-04-30", 11.0), ("2022-12-31", "2023-05-15", 12.0))
    got = wide(asof.pit_align(r, days(spark, "2023-04-01", "2023-05-01", "2023-05-16"), []))
    assert got["000001.SZ"] == [10.0, 11.0, 11.0]


def test_missing_value_that_is_newest_stays_missing(spark):
    r = reports(spark, ("2022-12-31", "2023-03-31", 10.0), ("2023-03-31", "2023-04-30", None))
    assert wide(asof.pit_align(r, days(spark, "2023-04-15", "2023-05-15"), []))["000001.SZ"] == [10.0, None]


def test_interval_ends(spark):
    c = days(spark, *[f"2024-01-0{i}" for i in range(1, 8)])
    iv = spark.createDataFrame([("a", D("2024-01-02"), D("2024-01-04")), ("a", D("2024-01-03"), D("2024-01-05")), ("b", D("2024-01-06"), None)], "code string, start date, end date")
    cells = lambda m: sorted((r.code, r.date.day) for r in m.collect())
    assert cells(masks.interval_mask(c, iv)) == [("a", 2), ("a", 3), ("a", 4), ("b", 6), ("b", 7)]
    assert cells(masks.interval_mask(c, iv, closed="both")) == [("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 6), ("b", 7)]
    with pytest.raises(ValueError):
        masks.interval_mask(c, iv, closed="right")


def test_status_overrules_suspension(spark):
    c = days(spark, "2024-01-01", "2024-01-02", "2024-01-03")
    ev = spark.createDataFrame([("a", D("2024-01-01"), None)], "code string, start date, end date")
    st = spark.createDataFrame([("a", D("2024-01-02"), 0, 1), ("a", D("2024-01-02"), -1, 2), ("b", D("2024-01-03"), 3, 3)], "code string, date date, status int, seq int")
    got = sorted((r.code, r.date.day) for r in masks.suspended(c, ev, st, ["seq"]).collect())
    assert got == [("a", 1), ("a", 3), ("b", 3)]


def test_shift_clamps(spark):
    c = days(spark, "2024-01-02", "2024-01-03", "2024-01-05")
    q = days(spark, "2024-01-01", "2024-01-03", "2024-01-05", "2024-01-09").withColumnRenamed("date", "at")
    out = lambda df, col: [r[col] and r[col].day for r in df.orderBy("at").collect()]
    assert out(cal.next_trading_date(q, "at", 1, c), "next_date") == [2, 5, None, None]
    assert out(cal.next_trading_date(q, "at", 9, c), "next_date") == [5, 5, None, None]
    assert out(cal.next_trading_date(q, "at", 0, c), "next_date") == [1, 3, 5, 9]
    assert out(cal.prev_trading_date(q, "at", 1, c), "prev_date") == [None, 2, 3, 5]
    assert out(cal.next_trading_date(q, "at", -2, c), "next_date") == [None, 2, 2, 3]


def test_rebalance_is_the_last_date_there_is(spark):
    c = days(spark, "2024-01-02", "2024-01-31", "2024-02-28")
    assert sorted(r.date.day for r in cal.rebalance_dates(c, "monthly").collect()) == [28, 31]
    with pytest.raises(ValueError):
        cal.rebalance_dates(c, "yearly")


def test_cells_of_the_grid_are_made_without_a_shuffle(spark):
    """The plan hashes reports only: above the step that makes the days, nothing is exchanged."""
    r = spark.createDataFrame([(f"c{i}", D("2022-12-31"), D("2023-03-31"), float(i)) for i in range(9)], "code string, report_period date, announcement_date date, value double")
    got = asof.pit_align(r, days(spark, "2023-03-31", "2023-04-01"), [])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")] and "Exchange" in plan
    assert len(got.collect()) == 18
    assert asof.pit_align(r, days(spark), []).count() == 0 and asof.pit_align(r.limit(0), days(spark, "2023-03-31"), []).count() == 0
