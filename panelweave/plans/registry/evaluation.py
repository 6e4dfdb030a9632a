"""Factor evaluation, composites and index weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import composite as co
from panelweave.operators import evaluation as ev
from panelweave.plans.formula import evaluate, evaluate_all, negative, rolling_mean, rolling_return
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S

GROUPS = 5


def aligned(d):
    """Three-month momentum against the next month's return, on one monthly grid."""
    both = evaluate_all({"x": rolling_return("close", 3), "r": rolling_return("close", 1)}, d.panel("close"))
    return ev.align_columns(both, "x", "r")


def usable(d):
    return ev.usable_rows(aligned(d))


ALIGNED = f"""{S.GRID}, r AS (SELECT date, code, {S.rret('close', 3)} AS x, {S.rret('close', 1)} AS y0 FROM grid),
  al AS (SELECT date, code, x, lead(y0) OVER (PARTITION BY code ORDER BY date) AS y FROM r),
  sz AS (SELECT date, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) AS usable, count(*) AS shared FROM al GROUP BY date),
  us AS (SELECT al.* FROM al JOIN sz ON sz.date = al.date WHERE usable >= 5 AND x IS NOT NULL AND y IS NOT NULL)"""


def pearson(x, y):
    return (
        f"CASE WHEN min({x}) = max({x}) OR min({y}) = max({y}) THEN 0 ELSE coalesce(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0), 0) END"
    )


RANKED = f"""{ALIGNED}, rk AS (SELECT date, code, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM us)"""
BUCKETED = f"""{ALIGNED}, en AS (SELECT date FROM us GROUP BY date HAVING count(DISTINCT x) >= {GROUPS}),
  nb AS (SELECT us.*, row_number() OVER (PARTITION BY us.date ORDER BY x, code) AS rn, count(*) OVER (PARTITION BY us.date) AS n FROM us JOIN en ON en.date = us.date),
  bk AS (SELECT date, code, x, y, CAST(greatest(((rn - 1) * {GROUPS} + n - 2) // (n - 1), 1) - 1 AS INTEGER) AS bucket FROM nb)"""
MEANS = f"{BUCKETED}, dm AS (SELECT date, bucket, avg(y) AS m FROM bk GROUP BY 1, 2), qm AS (SELECT bucket, avg(m) AS mean_return FROM dm GROUP BY 1)"
TURN = f"""{BUCKETED}, ds AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bk)),
  top AS (SELECT ds.idx, ds.date, code FROM bk JOIN ds ON ds.date = bk.date WHERE bucket = {GROUPS - 1}),
  tn AS (SELECT a.date, a.idx, count(*) AS size, count(CASE WHEN b.code IS NULL THEN 1 END) AS entered FROM top a LEFT JOIN top b ON b.idx = a.idx - 1 AND b.code = a.code GROUP BY 1, 2),
  tv AS (SELECT date, entered / lag(size) OVER (ORDER BY idx) AS turnover FROM tn QUALIFY lag(size) OVER (ORDER BY idx) > 0)"""


def summary(col, source):
    return f"SELECT avg({col}) AS mean, coalesce(stddev_samp({col}), 0) AS std, avg(CASE WHEN {col} > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, count({col}) AS count, coalesce(avg({col}) / nullif(stddev_samp({col}), 0), 0) AS ir FROM {source}"


@query("a1_align_forward", f"WITH {ALIGNED} SELECT date, code, x, y FROM al", nums="x y")
def _(d):
    """Factor and returns as two tables."""
    panel = d.panel("close")
    return ev.align_forward(evaluate(rolling_return("close", 3), panel), evaluate(rolling_return("close", 1), panel))


@query("a1_align_columns", f"WITH {ALIGNED} SELECT date, code, x, y FROM al", nums="x y")
def _(d):
    return aligned(d)


@query("a2_usable_dates", f"WITH {ALIGNED} SELECT date, usable, shared, usable >= 5 AS evaluated FROM sz")
def _(d):
    return ev.usable_dates(aligned(d))


@query("a3_coverage", f"WITH {ALIGNED} SELECT avg(usable / shared) AS coverage_mean, count(*) AS evaluated_dates FROM sz WHERE usable >= 5", nums="coverage_mean", dates="")
def _(d):
    return ev.coverage(aligned(d))


@query("a4_ic", f"WITH {ALIGNED} SELECT date, {pearson('x', 'y')} AS ic FROM us GROUP BY date", nums="ic")
def _(d):
    return ev.ic_series(usable(d))


@query("a5_rank_ic", f"WITH {RANKED} SELECT date, {pearson('rx', 'ry')} AS rank_ic FROM rk GROUP BY date", nums="rank_ic")
def _(d):
    return ev.rank_ic_series(usable(d))


@query("a6_quantile_bucket", f"WITH {BUCKETED} SELECT date, code, x, y, bucket FROM bk", nums="x y")
def _(d):
    return ev.quantile_bucket(usable(d), GROUPS)


@query("a7_quantile_returns", f"WITH {MEANS} SELECT bucket, mean_return FROM qm", nums="mean_return", dates="")
def _(d):
    return ev.quantile_returns(ev.quantile_bucket(usable(d), GROUPS))


@query("a8_spread_monotonic", f"""WITH {MEANS}, pr AS (SELECT bucket, mean_return, lag(mean_return) OVER (ORDER BY bucket) AS p FROM qm)
  SELECT max(CASE WHEN bucket = {GROUPS - 1} THEN mean_return END) - max(CASE WHEN bucket = 0 THEN mean_return END) AS long_short_spread,
  count(*) = {GROUPS} AND bool_and(p IS NULL OR mean_return >= p) AS monotonic FROM pr""", nums="long_short_spread", dates="")
def _(d):
    return ev.spread_and_monotonic(ev.quantile_returns(ev.quantile_bucket(usable(d), GROUPS)), GROUPS)


@query("a9_turnover_series", f"WITH {TURN} SELECT date, turnover FROM tv", nums="turnover")
def _(d):
    return ev.turnover_series(ev.quantile_bucket(usable(d), GROUPS), GROUPS)


@query("a9_top_turnover", f"WITH {TURN} SELECT coalesce(avg(turnover), 0) AS turnover_mean FROM tv", nums="turnover_mean", dates="")
def _(d):
    return ev.top_turnover(ev.quantile_bucket(usable(d), GROUPS), GROUPS)


@query("a10_summarise_ic", f"WITH {ALIGNED}, ics AS (SELECT date, {pearson('x', 'y')} AS ic FROM us GROUP BY date) {summary('ic', 'ics')}", nums="mean std positive_rate ir", dates="")
def _(d):
    return ev.summarise(ev.ic_series(usable(d)), "ic")


@query("a11_analyze_factor", f"""WITH {RANKED}, ics AS (SELECT date, {pearson('x', 'y')} AS ic FROM us GROUP BY date), ris AS (SELECT date, {pearson('rx', 'ry')} AS ic FROM rk GROUP BY date),
  a AS ({summary('ic', 'ics')}), b AS ({summary('ic', 'ris')}), {TURN.split('us AS', 1)[1].split('),', 1)[1].strip()}, dm AS (SELECT date, bucket, avg(y) AS m FROM bk GROUP BY 1, 2), qm AS (SELECT bucket, avg(m) AS mean_return FROM dm GROUP BY 1),
  pr AS (SELECT bucket, mean_return, lag(mean_return) OVER (ORDER BY bucket) AS p FROM qm)
  SELECT a.mean AS ic_mean, a.std AS ic_std, a.positive_rate AS ic_positive_rate, a.ir AS ic_ir, b.mean AS rank_ic_mean, b.std AS rank_ic_std, b.positive_rate AS rank_ic_positive_rate, b.ir AS rank_ic_ir,
  (SELECT max(CASE WHEN bucket = 4 THEN mean_return END) - max(CASE WHEN bucket = 0 THEN mean_return END) FROM pr) AS long_short_spread,
  (SELECT count(*) = 5 AND bool_and(p IS NULL OR mean_return >= p) FROM pr) AS monotonic, (SELECT avg(turnover) FROM tv) AS turnover_mean,
  (SELECT avg(usable / shared) FROM sz WHERE usable >= 5) AS coverage_mean, (SELECT count(*) FROM sz WHERE usable >= 5) AS evaluated_dates, (SELECT count(*) FROM sz WHERE usable < 5) AS skipped_dates FROM a, b""",
  nums="ic_mean ic_std ic_positive_rate ic_ir rank_ic_mean rank_ic_std rank_ic_positive_rate rank_ic_ir long_short_spread turnover_mean coverage_mean", dates="")
def _(d):
    return ev.analyze_aligned(aligned(d), GROUPS)


# ---- composites ----------------------------------------------------------------------


def composite(d):
    """Momentum up, price level down, steady volume up."""
    return co.combine_columns(evaluate_all(LEGS, d.panel("close", "volume")), WEIGHTS, DIRECTIONS)


LEGS = {"momentum": rolling_return("close", 3), "level": rolling_mean("close", 3), "volume": negative(rolling_mean("volume", 3))}
WEIGHTS = {"momentum": 2.0, "level": 1.0, "volume": 1.0}
DIRECTIONS = {"momentum": 1, "level": -1, "volume": 1}


def z(x):
    return f"coalesce(({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0), 0)"


COMPOSITE = f"""{S.GRID}, f AS (SELECT date, code, {S.rret('close', 3)} AS a, -({S.rmean('close', 3)}) AS b, -({S.rmean('volume', 3)}) AS c FROM grid),
  comp AS (SELECT date, code, 0.5 * {z('a')} + 0.25 * {z('b')} + 0.25 * {z('c')} AS value FROM f)"""


def _picked(n, every):
    return f"""{COMPOSITE}, rb AS (SELECT max(date) AS date FROM comp GROUP BY date_trunc('{every}', date)),
  pk AS (SELECT comp.date, code, value FROM comp JOIN rb ON rb.date = comp.date QUALIFY row_number() OVER (PARTITION BY comp.date ORDER BY value DESC, code) <= {n})"""


@query("i1_combine_factors", f"WITH {COMPOSITE} SELECT date, code, value FROM comp", nums="value")
def _(d):
    """Factors as tables of their own, aligned by the function."""
    p = d.panel("close", "volume")
    return co.combine_factors({name: evaluate(tree, p) for name, tree in LEGS.items()}, WEIGHTS, DIRECTIONS)


@query("i1_combine_columns", f"WITH {COMPOSITE} SELECT date, code, value FROM comp", nums="value")
def _(d):
    return composite(d)


@query("i3_index_equal", f"WITH {_picked(10, 'month')} SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM pk", nums="weight")
def _(d):
    return co.generate_index(composite(d), 10)


@query("i5_index_factor_score", f"""WITH {_picked(20, 'week')}, sh AS (SELECT date, code, value - min(value) OVER (PARTITION BY date) + 1e-9 AS s FROM pk)
  SELECT date, code, s / sum(s) OVER (PARTITION BY date) AS weight FROM sh""", nums="weight")
def _(d):
    return co.generate_index(composite(d), 20, "factor_score", "weekly")


@query("i4_weight_totals", f"""WITH {_picked(15, 'month')}, sh AS (SELECT date, value - min(value) OVER (PARTITION BY date) + 1e-9 AS s FROM pk)
  SELECT date, count(*) AS n, 1.0 AS total FROM sh GROUP BY date""", nums="total")
def _(d):
    """Weights of a date always sum to one."""
    return co.generate_index(composite(d), 15, "factor_score").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))


METRIC = """CASE l_linenumber % 4 WHEN 1 THEN CASE WHEN l_tax < 0.06 THEN 'PB' ELSE ' roe_ttm' END WHEN 2 THEN 'S_DQ_VOLUME' WHEN 3 THEN CASE WHEN l_discount > 0.08 THEN 'FLOAT_MV' END
  ELSE CASE WHEN l_quantity < 5 THEN 'NO_SUCH' ELSE 'PB' END END"""


@query("i6_review_gate", f"""WITH m AS (SELECT l_orderkey AS index_id, {METRIC} AS key, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
  SELECT index_id, CASE WHEN count(CASE WHEN key IN ('FLOAT_MV', 'NO_SUCH') THEN 1 END) > 0 THEN 'refused' WHEN count(key) = 0 THEN 'unreviewed' ELSE 'reviewed' END AS review_status,
    CASE WHEN count(key) = 0 THEN 'no metric declared' ELSE '' END AS review_note, coalesce(string_agg(CASE WHEN key IN ('FLOAT_MV', 'NO_SUCH') THEN key END, ',' ORDER BY pos, key), '') AS refused FROM m GROUP BY 1""", dates="")
def _(d):
    """An order is an index, its lines name the metrics."""
    from panelweave.sources.registry import metrics

    declared = d.table("lineitem").select(F.col("l_orderkey").alias("index_id"), F.col("l_linenumber").alias("pos"), F.expr(METRIC).alias("key"))
    return co.review_gates(declared, metrics(d.spark))


@query("i7_limitation_note", f"WITH {_picked(10, 'month')} SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight, '{co.LIMITATION_NOTE}' AS limitation FROM pk", nums="weight")
def _(d):
    return co.with_limitation_note(co.generate_index(composite(d), 10))
