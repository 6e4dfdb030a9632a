import math

import pytest
from conftest import panel, wide

from panelweave.plans import formula as f

PRICES = {"600519.SH": [10, 11, 12, 12], "000001.SZ": [20, 19, 22, 21]}


def run(spark, tree, data=PRICES, name="close"):
    return wide(f.evaluate(tree, panel(spark, data, name=name)))


def test_rolling_mean_needs_a_whole_window(spark):
    got = run(spark, f.rolling_mean("close", 2))
    assert got["600519.SH"][:2] == [None, 10.5] and got["000001.SZ"][1] == 19.5
    assert run(spark, f.rolling_mean("close", 3))["600519.SH"][:2] == [None, None]


def test_rolling_return_is_a_lag(spark):
    got = run(spark, f.rolling_return("close", 2))["600519.SH"]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.2)


def test_rolling_return_zero_base(spark):
    zero = {"a": [0, 5, 0]}
    assert run(spark, f.rolling_return("close", 1, keep_inf=False), zero)["a"] == [None, None, -1.0]
    assert run(spark, f.rolling_return("close", 1), zero)["a"][1] == math.inf


def test_rolling_std_of_one_row_is_missing(spark):
    assert run(spark, f.rolling_std("close", 1))["600519.SH"] == [None] * 4
    assert run(spark, f.rolling_std("close", 2))["000001.SZ"][1] == pytest.approx(math.sqrt(0.5))


def test_rank_runs_across_codes(spark):
    got = run(spark, f.rank("close"), {"a": [1, 4], "b": [3, 2]})
    assert got == {"a": [0.5, 1.0], "b": [1.0, 0.5]}


def test_rank_ties_and_missing(spark):
    got = run(spark, f.rank("close"), {"a": [1], "b": [1], "c": [None], "d": [5]})
    assert got == {"a": [0.5], "b": [0.5], "c": [None], "d": [1.0]}


def test_divide_by_zero_is_missing(spark):
    df = panel(spark, PRICES, name="close").withColumn("zero", f.F.lit(0.0))
    assert set(sum(wide(f.evaluate(f.divide("close", "zero"), df)).values(), [])) == {None}


def test_log(spark):
    got = run(spark, f.log("close"), {"a": [1, 0, 3, 5], "b": [-1, 2, 4, 6]})
    assert got["a"][1] is None and got["b"][0] is None and got["a"][2] == pytest.approx(math.log(3))


def test_arithmetic_and_literals(spark):
    df = panel(spark, {"x": [1]}, name="a").withColumn("b", f.F.lit(10.0))
    for tree, want in ((f.add("a", "b"), 11), (f.subtract("b", "a"), 9), (f.multiply("a", "b"), 10), (f.negative("b"), -10), (f.add(f.lit_node(2), "b"), 12)):
        assert wide(f.evaluate(tree, df))["x"] == [want]


def test_fillna(spark):
    assert run(spark, f.fillna("close"), {"a": [None, 2]})["a"] == [0.0, 2.0]


def test_evaluate_all_shares_the_pass(spark):
    df = f.evaluate_all({"m": f.rank(f.rolling_return("close", 1)), "n": f.negative(f.rank(f.rolling_return("close", 1)))}, panel(spark, PRICES, name="close"))
    assert all(r.n == -r.m for r in df.collect() if r.m is not None)


@pytest.mark.parametrize("bad", [0, 2521, 1.5, True, "3", None])
def test_windows_are_checked(bad):
    with pytest.raises(ValueError):
        f.check_window("rolling_mean", bad)
    assert f.check_window("rolling_mean", 20.0) == 20


@pytest.mark.parametrize("tree", [
    ("call", "zscore", (f.var("close"),), ()), ("call", "power", (f.var("close"),), ()), ("call", "add", (f.var("close"),), ()),
    f.var("absent"), f.lit_node(1), ("call", "rolling_mean", (f.var("close"),), ()),
])
def test_illegal_trees_are_refused(spark, tree):
    with pytest.raises(ValueError):
        f.evaluate(tree, panel(spark, PRICES, name="close"))


def test_max_window_is_not_summed():
    assert f.max_window(f.rolling_std(f.rolling_return("close", 20), 60)) == 60
