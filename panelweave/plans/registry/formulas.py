"""The eleven formula operators and the preprocessing steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import cross_section as xs
from panelweave.plans import formula as f
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S
from panelweave.plans.steps import Step, apply_steps, run_factor, step_traces


def _formula(name, tree, cols, *named):
    query(name, S.steps(S.GRID, "grid", *named), nums="value")(lambda d: f.evaluate(tree, d.panel(*cols)))


_formula("f_variable", f.var("close"), ["close"], ("value", "close"))
_formula("f_literal", f.multiply(f.lit_node(2.5), "close"), ["close"], ("value", "2.5 * close"))
_formula("f_add", f.add("close", "volume"), ["close", "volume"], ("value", "close + volume"))
_formula("f_subtract", f.subtract("high", "low"), ["high", "low"], ("value", "high - low"))
_formula("f_multiply", f.multiply("close", "volume"), ["close", "volume"], ("value", "close * volume"))
_formula("f_divide", f.divide("close", f.subtract("high", "low")), ["close", "high", "low"], ("value", "close / nullif(high - low, 0)"))
_formula("f_negative", f.negative("close"), ["close"], ("value", "-close"))
_formula("f_log", f.log(f.subtract("high", "low")), ["high", "low"], ("value", "CASE WHEN high - low > 0 THEN ln(high - low) END"))
_formula("f_rank", f.rank("volume"), ["volume"], ("value", S.rank("volume")))
_formula("f_rolling_mean", f.rolling_mean("close", 3), ["close"], ("value", S.rmean("close", 3)))
_formula("f_rolling_std", f.rolling_std("close", 6), ["close"], ("value", S.rstd("close", 6)))
_formula("f_rolling_return", f.rolling_return("close", 3), ["close"], ("value", S.rret("close", 3)))
_formula("f_fillna", f.fillna("close", -1.0), ["close"], ("value", "coalesce(close, -1.0)"))
_formula(
    "f_nested", f.rank(f.rolling_mean(f.rank(f.rolling_return("close", 1)), 3)), ["close"],
    ("a", S.rret("close", 1)), ("b", S.rank("a")), ("c", S.rmean("b", 3)), ("value", S.rank("c")),
)


@query("f_rank_daily", f"WITH {S.DAILY} SELECT date, code, {S.rank('value')} AS value FROM daily", nums="value")
def _(d):
    """Rank over the daily event panel, where a date has every active user."""
    return f.evaluate(f.rank("value"), d.daily)


@query("f_rolling_daily", f"""WITH {S.DAILY}, g AS (SELECT x.date, c.code, y.value AS v FROM (SELECT DISTINCT date FROM daily) x
  CROSS JOIN (SELECT DISTINCT code FROM daily) c LEFT JOIN daily y ON y.date = x.date AND y.code = c.code),
  h AS (SELECT date, code, coalesce(v, 0) AS v FROM g) SELECT date, code, {S.rmean('v', 5)} AS value FROM h""", nums="value")
def _(d):
    from panelweave.operators.grid import densify

    return f.evaluate(f.rolling_mean(f.fillna("value"), 5), densify(d.daily))


@query("x1_winsorize", f"""WITH {S.GRID}, q AS (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM grid WHERE close IS NOT NULL GROUP BY date)
  SELECT grid.date, code, CASE WHEN close IS NOT NULL THEN least(greatest(close, lo), hi) END AS close FROM grid LEFT JOIN q ON q.date = grid.date""", nums="close")
def _(d):
    return xs.winsorize(d.panel("close"), ["close"], 0.05, 0.95)


@query("x2_zscore", f"""WITH {S.GRID} SELECT date, code, (close - avg(close) OVER (PARTITION BY date)) / nullif(stddev_samp(close) OVER (PARTITION BY date), 0) AS close FROM grid""", nums="close")
def _(d):
    return xs.zscore(d.panel("close"), ["close"])


@query("x3_industry_neutralize", f"""WITH {S.GRID}, {S.INDUSTRIES} SELECT date, grid.code, close - avg(close) OVER (PARTITION BY date, industry) AS close
  FROM grid JOIN industries ON industries.code = grid.code""", nums="close")
def _(d):
    return xs.industry_neutralize(d.panel("close"), ["close"], d.industries)


@query("x4_fillna", f"WITH {S.GRID} SELECT date, code, coalesce(volume, 0) AS volume, coalesce(close, 0) AS close FROM grid", nums="volume close")
def _(d):
    return xs.fillna(d.panel("volume", "close"), ["volume", "close"])


STEPS = [
    Step(1, "winsorize", "variables", {"lower": 0.05, "upper": 0.95}), Step(2, "zscore", "variables"),
    Step(3, "industry_neutralize", "factor"), Step(4, "fillna", "factor", {"value": 0.0}),
]


@query("x5_ordered_steps", f"""WITH {S.GRID}, {S.INDUSTRIES},
  q AS (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM grid WHERE close IS NOT NULL GROUP BY date),
  w AS (SELECT grid.date, code, CASE WHEN close IS NOT NULL THEN least(greatest(close, lo), hi) END AS c FROM grid LEFT JOIN q ON q.date = grid.date),
  z AS (SELECT date, code, (c - avg(c) OVER (PARTITION BY date)) / nullif(stddev_samp(c) OVER (PARTITION BY date), 0) AS c FROM w),
  m AS (SELECT date, code, {S.rmean('c', 3)} AS v FROM z)
  SELECT date, m.code, coalesce(v - avg(v) OVER (PARTITION BY date, industry), 0) AS value FROM m JOIN industries ON industries.code = m.code""", nums="value")
def _(d):
    return run_factor(f.rolling_mean("close", 3), d.panel("close"), STEPS, d.industries)


STEP_OF = "CASE l_returnflag WHEN 'A' THEN CASE WHEN l_discount < 0.05 THEN 'winsorize' ELSE 'unknown' END WHEN 'R' THEN 'zscore' ELSE CASE WHEN l_tax < 0.04 THEN 'industry_neutralize' ELSE 'fillna' END END"
TARGET_OF = "CASE l_linestatus WHEN 'F' THEN 'variables' ELSE 'factor' END"


@query("x6_step_trace", f"""WITH s AS (SELECT l_orderkey AS spec_id, l_linenumber AS step_order, {STEP_OF} AS operation, {TARGET_OF} AS target FROM lineitem)
  SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY CASE target WHEN 'variables' THEN 0 ELSE 1 END, step_order, operation) AS position, step_order, operation, target FROM s WHERE operation <> 'unknown'""", dates="")
def _(d):
    """An order is a factor, its lines are the steps; the trace of every factor."""
    steps = d.table("lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_linenumber").alias("step_order"), F.expr(STEP_OF).alias("operation"), F.expr(TARGET_OF).alias("target"))
    return step_traces(steps)
