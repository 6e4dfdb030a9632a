import pytest
from conftest import panel, wide

from panelweave.operators import cross_section as xs
from panelweave.operators import grid
from panelweave.plans.formula import var
from panelweave.plans.steps import Step, apply_steps, check_steps, run_factor, step_trace

RAW = {"600519.SH": [1, 2, 3], "000001.SZ": [2, 3, 4], "000002.SZ": [3, 4, 5], "600000.SH": [100, 200, 300]}
INDUSTRIES = [("600519.SH", "food"), ("000001.SZ", "bank"), ("000002.SZ", "bank"), ("600000.SH", "bank")]


@pytest.fixture
def industries(spark):
    return spark.createDataFrame(INDUSTRIES, "code string, industry string")


def test_winsorize_clips_and_drops_nothing(spark):
    got = wide(xs.winsorize(panel(spark, RAW), ["value"], 0.25, 0.75))
    assert got["600000.SH"][0] == pytest.approx(3 + 97 * 0.25) and sum(map(len, got.values())) == 12


def test_zscore_has_mean_zero_and_no_spread_is_missing(spark):
    got = wide(xs.zscore(panel(spark, RAW), ["value"]))
    assert sum(v[0] for v in got.values()) == pytest.approx(0)
    assert wide(xs.zscore(panel(spark, {"a": [1], "b": [1]}), ["value"])) == {"a": [None], "b": [None]}


def test_industry_mean_is_zero(spark, industries):
    got = wide(xs.industry_neutralize(panel(spark, RAW), ["value"], industries))
    assert sum(got[c][1] for c, i in INDUSTRIES if i == "bank") == pytest.approx(0) and got["600519.SH"] == [0, 0, 0]


def test_partial_and_ambiguous_maps_are_refused(spark, industries):
    for bad in (industries.limit(0), industries.filter("industry = 'bank'"), industries.union(spark.createDataFrame([("600519.SH", "wine")]))):
        with pytest.raises(ValueError):
            xs.industry_neutralize(panel(spark, RAW), ["value"], bad)


def test_steps_run_in_order_and_by_target(spark):
    steps = [Step(2, "fillna", "factor", {"value": 7.0}), Step(1, "zscore", "variables")]
    got = wide(run_factor(var("value"), panel(spark, {"a": [1, None], "b": [3, 2]}), steps))
    assert got["a"][1] == 7.0 and got["a"][0] == pytest.approx(-(2 ** -0.5))
    trace = [(r.operation, r.target) for r in step_trace(spark, steps).orderBy("position").collect()]
    assert trace == [("zscore", "variables"), ("fillna", "factor")]


@pytest.mark.parametrize("steps", [
    [Step(1, "zscore", "factor"), Step(1, "fillna", "factor")], [Step(1, "zscore", "factor"), Step(2, "zscore", "factor")], [Step(1, "square", "factor")],
])
def test_illegal_steps(steps):
    with pytest.raises(ValueError):
        check_steps(steps)


def test_industry_step_needs_a_map(spark):
    with pytest.raises(ValueError):
        apply_steps(panel(spark, RAW), [Step(1, "industry_neutralize", "factor")], "factor")


def test_densify_and_blank(spark):
    rows = panel(spark, {"a": [1, 2, 3]}).union(panel(spark, {"b": [9]}))
    dense = grid.densify(rows)
    assert wide(dense) == {"a": [1, 2, 3], "b": [9, None, None]}
    inside = rows.filter("code = 'a'").select("date", "code")
    assert wide(grid.blank_outside(dense, inside, inside.filter("date = DATE'2024-01-02'"))) == {"a": [1, None, 3], "b": [None] * 3}


def test_matrix_and_wide_round_trip(spark):
    doc = spark.createDataFrame([(["2024-01-01", "2024-01-02"], ["a", "b"], [[1.0, None], [3.0, float("nan")]])], "dates array<string>, codes array<string>, values array<array<double>>")
    long = grid.panel_from_matrix(doc)
    assert wide(long) == {"a": [1, 3], "b": [None, None]}
    back = grid.to_long(grid.to_wide(long, "value", ["a", "b"]), ["a", "b"])
    assert wide(back) == wide(long)


def test_keep_last(spark):
    rows = spark.createDataFrame([("k", 1, None), ("k", 2, "new"), ("k", 3, None)], "key string, seq int, v string")
    assert [tuple(r) for r in grid.dedup_last(rows, ["key"], ["seq"]).collect()] == [("k", 3, None)]
