import datetime as dt
import random

import pytest
from conftest import panel, wide
from pyspark.sql import functions as F

from panelweave.operators import composite as co
from panelweave.operators import evaluation as ev
from panelweave.operators import findings as fi
from panelweave.sources.registry import METRIC_SCHEMA, metrics


def pair(n_codes=10, days=12, lag=1):
    """Scores that are a fresh permutation every day; returns repeat them ``lag`` days later."""
    rng = random.Random(3)
    score = [rng.sample(range(n_codes), n_codes) for _ in range(days)]
    codes = [f"c{i}" for i in range(n_codes)]
    factor = {c: [score[t][i] for t in range(days)] for i, c in enumerate(codes)}
    returns = {c: [score[t - lag][i] / 1000 if t >= lag else 0.0 for t in range(days)] for i, c in enumerate(codes)}
    return factor, returns


def test_perfect_factor(spark):
    x, r = pair()
    got = ev.analyze_factor(panel(spark, x), panel(spark, r)).first()
    assert got.ic_mean == pytest.approx(1) and got.rank_ic_mean == pytest.approx(1) and got.monotonic
    assert got.evaluated_dates == 11 and got.skipped_dates == 1 and got.coverage_mean == pytest.approx(1)


def test_alignment_to_the_own_period_does_not_score(spark):
    x, r = pair(lag=0)
    assert abs(ev.analyze_factor(panel(spark, x), panel(spark, r)).first().ic_mean) < 0.6


def test_constant_side_scores_zero(spark):
    x, r = pair()
    flat = {c: [1.0] * 12 for c in x}
    rows = ev.ic_series(ev.usable_rows(ev.align_forward(panel(spark, flat), panel(spark, r)))).collect()
    assert {v.ic for v in rows} == {0.0}


def test_thin_dates_and_empty_input_raise(spark):
    x, r = pair()
    few = {c: x[c] for c in list(x)[:3]}
    with pytest.raises(ValueError, match="5"):
        ev.analyze_factor(panel(spark, few), panel(spark, r))
    with pytest.raises(ValueError):
        ev.analyze_factor(panel(spark, x).limit(0), panel(spark, r))
    for bad in (1, 21, 2.5, True):
        with pytest.raises(ValueError):
            ev.check_groups(bad)


@pytest.mark.parametrize("flip, want", [(False, 0.0), (True, 1.0)])
def test_turnover(spark, flip, want):
    x = {f"c{i}": [(9 - i if flip and t % 2 else i) for t in range(12)] for i in range(10)}
    usable = ev.usable_rows(ev.align_forward(panel(spark, x), panel(spark, pair()[1])))
    assert ev.top_turnover(ev.quantile_bucket(usable, 2), 2).first().turnover_mean == want


def test_too_few_values_give_no_buckets(spark):
    x = {f"c{i}": [i % 2] for i in range(10)}
    df = panel(spark, x, name="x").withColumn("y", F.lit(1.0))
    assert ev.quantile_bucket(df, 5).count() == 0
    assert ev.spread_and_monotonic(ev.quantile_returns(ev.quantile_bucket(df, 5)), 5).first().monotonic is False


def test_summary_of_one_value(spark):
    s = ev.summarise(spark.createDataFrame([(0.5,)], "v double"), "v").first()
    assert (s.mean, s.std, s.positive_rate, s["count"], s.ir) == (0.5, 0.0, 1.0, 1, 0.0)


# ---- composites


UP = {c: [float(i + 1)] * 60 for i, c in enumerate("ABCDEF")}
DOWN = {c: [float(6 - i)] * 60 for i, c in enumerate("ABCDEF")}


def test_opposite_directions_reinforce(spark):
    f = {"up": panel(spark, UP), "down": panel(spark, DOWN)}
    got = wide(co.combine_factors(f, {"up": 1, "down": 1}, {"up": 1, "down": -1}))
    assert got["F"][0] > got["A"][0] and got["F"][0] == pytest.approx(-got["A"][0])
    both = panel(spark, UP, name="up").join(panel(spark, DOWN, name="down"), ["date", "code"])
    cols = wide(co.combine_columns(both, {"up": 1, "down": 1}, {"up": 1, "down": -1}))
    assert all(cols[c] == pytest.approx(got[c]) for c in got)


def test_missing_and_flat_scores_count_as_zero(spark):
    got = wide(co.combine_factors({"a": panel(spark, {"x": [1, 5], "y": [1, None], "z": [1, 7]})}, {"a": 1}, {"a": 1}))
    assert got["x"][0] == 0 and got["y"] == [0, 0]


@pytest.mark.parametrize("weights, directions", [({"a": 0}, {"a": 1}), ({"a": float("nan")}, {"a": 1}), ({"a": 1}, {"a": 2}), ({"b": 1}, {"a": 1})])
def test_combination_guards(weights, directions):
    with pytest.raises(ValueError):
        co.check_combination({"a": None}, weights, directions)


@pytest.mark.parametrize("weighting", ["equal", "factor_score"])
def test_weights_sum_to_one_and_ties_go_to_the_first_code(spark, weighting):
    tied = {"B": [1.0] * 40, "A": [1.0] * 40, "C": [2.0] * 40}
    rows = co.generate_index(panel(spark, tied), 2, weighting).collect()
    assert {r.code for r in rows} == {"A", "C"}
    totals = {}
    for r in rows:
        totals[r.date] = totals.get(r.date, 0) + r.weight
    assert sorted(totals) == [dt.date(2024, 1, 31), dt.date(2024, 2, 9)] and all(t == pytest.approx(1) for t in totals.values())


def test_top_n_is_capped_and_duplicates_refused(spark):
    p = panel(spark, {"A": [1], "B": [2]})
    assert co.generate_index(p, 10).count() == 2
    with pytest.raises(ValueError):
        co.check_unique_dates(p.union(p))


def test_review_gate(spark):
    reg = metrics(spark).union(spark.createDataFrame([("NEW", "", "", "", "", "", "", None, None, "unreviewed")], METRIC_SCHEMA))
    assert co.review_gate(["pb"], reg).first().review_status == "reviewed"
    assert tuple(co.review_gate(["PB", "NEW"], reg).first()) == ("unreviewed", "NEW unreviewed")
    assert co.review_gate([], reg).first().review_status == "unreviewed"
    for key in ("FLOAT_MV", "nothing"):
        with pytest.raises(ValueError):
            co.review_gate([key], reg)


# ---- findings


def codes(df):
    return sorted((r.severity, r.code) for r in df.collect())


def test_findings_of_bad_panels(spark):
    reg = metrics(spark)
    good = panel(spark, {f"c{i}": [float(i), float(i + 1)] for i in range(6)})
    assert codes(fi.data_findings(good, "x", start="2024-01-01", end="2024-01-02")) == []
    assert codes(fi.data_findings(good.limit(0), "x")) == [("warning", "empty_sample")]
    assert ("error", "duplicate_key") in codes(fi.data_findings(good.union(good), "x"))
    assert codes(fi.data_findings(good.filter("code < 'c3'"), "x")) == [("warning", "narrow_cross_section")]
    flat = panel(spark, {f"c{i}": [float(i)] * 2 for i in range(6)})
    assert codes(fi.data_findings(flat, "x")) == [("error", "constant_input")]
    thin = panel(spark, {f"c{i}": [float(i), None, None] for i in range(6)})
    assert ("warning", "sparse_data") in codes(fi.data_findings(thin, "x"))
    assert codes(fi.data_findings(good, "x", start="2023-12-01", end="2024-01-02")) == [("warning", "partial_coverage")]
    big = good.withColumn("value", F.col("value") * 1000)
    assert codes(fi.data_findings(big, "x", metric="PB", registry=reg)) == [("error", "implausible_input_magnitude")]
    with pytest.raises(ValueError, match="no_input_data"):
        fi.check_inputs({})


def test_findings_of_results(spark):
    reg = metrics(spark)
    good = panel(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    none = good.withColumn("value", F.lit(None).cast("double"))
    assert codes(fi.check_result(good.limit(0))) == [("error", "empty_result")] and codes(fi.check_result(none)) == [("error", "all_null_result")]
    assert codes(fi.check_distribution(good.withColumn("value", F.lit(1.0)))) == [("warning", "constant_factor")]
    assert codes(fi.check_result_range(good.withColumn("value", F.col("value") * 100), reg, ["ROE_TTM", "PE_TTM"])) == [("error", "implausible_magnitude")]
    assert codes(fi.check_reference(good, good.withColumn("value", F.col("value") * 1.2))) == [("warning", "reference_mismatch")]
    assert codes(fi.check_reference(good, good.withColumn("value", F.col("value") * 1.01))) == []
    with pytest.raises(ValueError, match="all_null_result"):
        fi.raise_on_errors(fi.check_result(none))
    fi.raise_on_errors(fi.check_distribution(good))


def test_combining_and_indexing_refuse_what_they_cannot_use(spark):
    a, later = panel(spark, {"A": [1, 2], "B": [3, 4]}), panel(spark, {"A": [1, 2], "B": [3, 4]}, start="2025-01-01")
    one = {"a": 1, "b": 1}
    with pytest.raises(ValueError, match="no date"):
        co.combine_factors({"a": a, "b": later}, one, one)
    with pytest.raises(ValueError, match="no code"):
        co.combine_factors({"a": a, "b": panel(spark, {"C": [1, 2]})}, one, one)
    with pytest.raises(ValueError, match="duplicate rows"):
        co.generate_index(a.union(a), 2)
    with pytest.raises(ValueError, match="empty"):
        co.generate_index(a.limit(0), 2)
    with pytest.raises(ValueError, match="usable selection"):
        co.generate_index(panel(spark, {"A": [1, None], "B": [3, None]}), 2)
    # Rows that are doubled between rebalance dates only do no harm.
    assert co.generate_index(a.union(a.filter("date = '2024-01-01'")), 2).count() == 2


def test_factors_are_computed_once(spark):
    """The combination reads its stack and none of the factors' own sources again."""
    a = panel(spark, UP).repartition(2)
    plan = co.combine_factors({"a": a, "b": a}, {"a": 1, "b": 1}, {"a": 1, "b": 1})._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "parquet" in plan


def test_factors_without_overlap_are_refused(spark):
    a, b = panel(spark, {"A": [1, 2], "B": [3, 4]}), panel(spark, {"A": [1, 2], "B": [3, 4]}, start="2025-01-01")
    co.check_overlap({"a": a, "b": a})
    with pytest.raises(ValueError, match="no date"):
        co.check_overlap({"a": a, "b": b})
    with pytest.raises(ValueError, match="no code"):
        co.check_overlap({"a": a, "c": panel(spark, {"C": [1, 2]})})


def test_market_cap_takes_the_last_row_on_the_trading_grid(spark):
    from panelweave.operators import prices

    rows = spark.createDataFrame([("x", "20240102", 1.0, 1), ("x", "20240102", None, 3), ("x", "20240102", 5.0, 2), ("x", "20240104", 2.0, 1)], f"{prices.CODE} string, {prices.DAY} string, s_val_mv double, n int")
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4)], "date date")
    got = {r.date.day: r.market_cap for r in prices.market_cap(rows, order="n", dates=days).collect()}
    assert got == {2: None, 3: None, 4: 20_000.0}


def test_checks_hold_cells_only_for_duplicates(spark):
    """A check that asks for no duplicates groups by code alone, so a task holds no entry per (code, date)."""
    rows = panel(spark, {"a": [1, None, 3], "b": [2, 2, 2]}).union(panel(spark, {"b": [5]}))
    cells = lambda df: "date" in "".join(x.split("functions=")[0] for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Aggregate(keys=" in x)
    assert cells(fi.check_duplicates(rows)) and fi.check_duplicates(rows).first().evidence == {"duplicates": "1"}
    assert not any(cells(f(rows)) for f in (fi.check_sparse, fi.check_empty, fi.check_narrow, fi.check_constant, fi.check_result, fi.check_distribution, fi.result_summary))
    full, lean = fi.panel_facts(rows).drop("duplicates").first(), fi.panel_facts(rows, cells=False).drop("duplicates").first()
    assert full == lean and full.rows == 7 and full.non_null == 6
