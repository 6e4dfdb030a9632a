"""Per-day figures from the ends of intervals against the masks of days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import masks

D0 = dt.date(2023, 12, 20)


def day(n):
    return D0 + dt.timedelta(days=n)


@pytest.fixture
def made(spark):
    rng = random.Random(4)
    spans = []
    for _ in range(120):
        a = rng.randrange(-10, 60)
        spans.append((rng.choice("AB"), f"c{rng.randrange(8)}", day(a), rng.choice([None, day(a + rng.randrange(0, 25))]) if rng.random() < 0.7 else day(a), day(rng.randrange(90))))
    members = spark.createDataFrame(spans, "index_code string, code string, start date, end date, opdate date")
    calendar = spark.createDataFrame([(day(n),) for n in range(0, 55) if n % 7 not in (3, 4)], "date date")
    status = spark.createDataFrame([(day(rng.randrange(-5, 60)), f"c{rng.randrange(10)}", rng.choice([-1, -1, 0, None]), k) for k in range(200)], "date date, code string, status int, n int")
    return members, calendar, status


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def per_day(cells):
    return cells.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("top"))


@pytest.mark.parametrize("bounds", [(None, None), ("2023-12-28", "2024-01-15")])
def test_counts_and_stamps_are_those_of_the_day_rows(spark, made, bounds):
    members, calendar, status = made
    assert rows(masks.member_totals(members, calendar, *bounds)) == rows(masks.member_lists(masks.index_members(members, calendar, *bounds)))
    over = lambda spans: masks.over_days(spans, calendar, [], {"n": F.lit(1)}, {"top": F.col("code")}, *bounds)
    want = rows(per_day(masks.interval_mask(calendar, members, *bounds)))
    assert rows(over(masks.merged(members))) == want and len(want) > 10
    spans = masks.suspended_spans(members, status, ["n"])
    assert rows(over(spans)) == rows(per_day(masks.suspended(calendar, members, status, ["n"], *bounds)))


def test_no_intervals(spark, made):
    members, calendar, _ = made
    assert masks.member_totals(members.limit(0), calendar).collect() == []
    assert masks.member_totals(members, calendar.limit(0)).collect() == []
