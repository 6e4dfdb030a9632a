"""The bucketed ranking gives the numbers of pandas, also with a hot group and hot ties."""

import random

import pandas as pd
import pytest
from conftest import panel
from pyspark.sql import functions as F

from panelweave.operators import cross_section as xs
from panelweave.operators import evaluation as ev
from panelweave.operators import ordering as od


@pytest.fixture(scope="module")
def data():
    """A third of all rows on one date, and a third of those share one value."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        date = "2024-01-01" if i % 3 == 0 else f"2024-01-{2 + i % 20:02d}"
        v = None if i % 17 == 0 else (0.0 if i % 9 == 0 else round(rng.gauss(0, 100), 1))
        rows.append((date, f"c{i}", v))
    return pd.DataFrame(rows, columns=["date", "code", "value"])


def load(spark, pdf):
    rows = [(d, c, None if v != v else v) for d, c, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "date string, code string, value double").withColumn("date", F.col("date").cast("date"))


def test_rank_equals_pandas(spark, data, split, monkeypatch):
    monkeypatch.setattr(od, "SAMPLE_PER_SPLIT", 1)
    got = xs.percentile_rank(load(spark, data), "value", "r").select("code", "r").toPandas().set_index("code")["r"]
    want = data.set_index("code").groupby("date")["value"].rank(pct=True)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_numbered_equals_sort(spark, data, split):
    df = load(spark, data).filter("value is not null")
    got = od.numbered(df, [F.col("value"), F.col("code")], ["date"]).select("code", "_rn", "_n").toPandas().set_index("code")
    d = data.dropna().sort_values(["date", "value", "code"])
    d["rn"] = d.groupby("date").cumcount() + 1
    assert (got["_rn"].sort_index().to_numpy() == d.set_index("code")["rn"].sort_index().to_numpy()).all()


def test_winsorize_equals_pandas(spark, data, split):
    got = xs.winsorize(load(spark, data), ["value"], 0.1, 0.9).toPandas().set_index("code")["value"]
    want = data.set_index("code").groupby("date")["value"].transform(lambda s: s.clip(s.quantile(0.1), s.quantile(0.9)))
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_buckets_agree_both_ways(spark, data, split):
    df = load(spark, data).filter("value is not null").select("date", "code", F.col("value").alias("x"), F.lit(1.0).alias("y"))
    a = sorted(ev.quantile_bucket(df, 5).select("code", "bucket").collect())
    spark.conf.set(od.ONE_TASK_KEY, str(1 << 40))
    assert a == sorted(ev.quantile_bucket(df, 5).select("code", "bucket").collect())


def test_bucket_rule_equals_qcut(spark):
    for n in (5, 7, 11, 23):
        df = panel(spark, {f"c{i:02d}": [i * i] for i in range(n)}, name="x").withColumn("y", F.lit(0.0))
        got = [r.bucket for r in ev.quantile_bucket(df, 5).orderBy("x").collect()]
        assert got == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False).tolist()


def test_size_check_reads_statistics_only(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < od.input_bytes(df.groupBy("id").count()) < od.ONE_TASK_BYTES
    assert od.groups_fit(df, ["id"])
