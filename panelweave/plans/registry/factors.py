"""Named factors over the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import asof, grid, masks
from panelweave.plans import named_factors as nf
from panelweave.plans.formula import evaluate
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S


def _factor(name, tree, cols, *named):
    query(f"factor_{name}", S.steps(S.GRID, "grid", *named), nums="value")(lambda d: evaluate(tree, d.panel(*cols)))


_factor("momentum", nf.momentum(window=3), ["close"], ("a", S.rret("close", 3)), ("value", S.rank("a")))
_factor("momentum_long", nf.momentum(window=12), ["close"], ("a", S.rret("close", 12)), ("value", S.rank("a")))
_factor("reversal", nf.reversal(window=1), ["close"], ("a", S.rret("close", 1)), ("value", "-a"))
_factor("low_volatility", nf.low_volatility(window=6), ["close"], ("a", S.rstd("close", 6)), ("b", S.rank("a")), ("value", "-b"))
_factor("volatility", nf.volatility(window=6), ["close"], ("a", S.rret("close", 1)), ("b", S.rstd("a", 6)), ("value", S.rank("b")))
_factor(
    "illiquidity", nf.illiquidity(window=3), ["close", "amount"],
    ("a", S.rret("close", 1)), ("b", "a / nullif(amount, 0)"), ("c", S.rmean("b", 3)), ("value", S.rank("c")),
)
_factor("amount_illiquidity", nf.amount_illiquidity(window=3), ["amount"], ("a", S.rmean("amount", 3)), ("b", "-a"), ("value", S.rank("b")))
_factor(
    "high_low_range", nf.high_low_range(window=3), ["high", "low", "close"],
    ("a", "(high - low) / nullif(close, 0)"), ("b", S.rmean("a", 3)), ("value", S.rank("b")),
)
_factor("turnover_mean", nf.turnover_mean("volume", 3), ["volume"], ("a", S.rmean("volume", 3)), ("value", S.rank("a")))
_factor(
    "price_volume", nf.price_volume(volume="amount", window=3), ["close", "amount"],
    ("a", S.rret("close", 3)), ("b", S.rank("a")), ("c", S.rstd("amount", 3)), ("d", S.rank("c")), ("value", "0.5 * b + 0.5 * d"),
)
_factor("accruals", nf.accruals(assets="amount"), ["net_profit", "cfo", "amount"], ("a", "(net_profit - cfo) / nullif(amount, 0)"), ("value", S.rank("a")))
_factor("asset_turnover", nf.ratio_rank("net_profit", "amount"), ["net_profit", "amount"], ("a", "net_profit / nullif(amount, 0)"), ("value", S.rank("a")))
_factor("leverage", nf.ratio_rank("debt", "amount"), ["debt", "amount"], ("a", "debt / nullif(amount, 0)"), ("value", S.rank("a")))
_factor("current_ratio", nf.ratio_rank("amount", "debt"), ["amount", "debt"], ("a", "amount / nullif(debt, 0)"), ("value", S.rank("a")))
_factor("cash_to_profit", nf.ratio_rank("cfo", "net_profit"), ["cfo", "net_profit"], ("a", "cfo / nullif(net_profit, 0)"), ("value", S.rank("a")))
_factor("earnings_to_price", nf.ratio_rank("net_profit", "close"), ["net_profit", "close"], ("a", "net_profit / nullif(close, 0)"), ("value", S.rank("a")))
_factor("book_to_price", nf.cheapness("close"), ["close"], ("a", "-close"), ("value", S.rank("a")))
_factor("earnings_yield", nf.cheapness("net_profit"), ["net_profit"], ("a", "-net_profit"), ("value", S.rank("a")))
_factor("sales_to_price", nf.cheapness("amount"), ["amount"], ("a", "-amount"), ("value", S.rank("a")))
_factor("quality", nf.metric_rank("net_profit"), ["net_profit"], ("value", S.rank("net_profit")))
_factor("cash_growth", nf.metric_rank("cfo"), ["cfo"], ("value", S.rank("cfo")))
_factor(
    "quality_value", nf.quality_value("net_profit", "close"), ["net_profit", "close"],
    ("a", S.rank("net_profit")), ("b", "-close"), ("c", S.rank("b")), ("value", "a + c"),
)
_factor(
    "quality_less_value", nf.quality_less_value("cfo", "close"), ["cfo", "close"],
    ("a", S.rank("cfo")), ("c", S.rank("close")), ("value", "a - c"),
)
_factor(
    "value_momentum", nf.value_momentum("amount", window=3), ["amount", "close"],
    ("x", "-amount"), ("a", S.rank("x")), ("y", S.rret("close", 3)), ("b", S.rank("y")), ("value", "a + b"),
)
_factor("quality_growth", nf.quality_growth("net_profit", "cfo"), ["net_profit", "cfo"], ("a", S.rank("net_profit")), ("b", S.rank("cfo")), ("value", "a + b"))
_factor(
    "triple", nf.triple("net_profit", "amount", "close", 3), ["net_profit", "amount", "close"],
    ("a", S.rank("net_profit")), ("x", "-amount"), ("b", S.rank("x")), ("y", S.rret("close", 3)), ("c", S.rank("y")), ("value", "a + b + c"),
)

PIT = f"""{S.REPORTS}, {S.BARS}, ver AS (SELECT code, announcement_date + 1 AS date, max((report_period, announcement_date, l_orderkey, l_linenumber, value)) AS v FROM reports GROUP BY 1, 2),
  g AS (SELECT c.code, d.date FROM (SELECT DISTINCT code FROM reports) c CROSS JOIN (SELECT DISTINCT date FROM bars) d),
  run AS (SELECT code, date, max(v) OVER (PARTITION BY code ORDER BY date) AS v FROM ver),
  pit AS (SELECT g.date, g.code, run.v[5] AS value, run.v[1] AS report_period FROM g ASOF LEFT JOIN run ON g.code = run.code AND g.date >= run.date)"""


def pit_panel(d):
    return asof.pit_align(d.reports, d.bars.select("date").distinct(), ["l_orderkey", "l_linenumber"])


@query("factor_pit_quality", f"WITH {PIT} SELECT date, code, {S.rank('value')} AS value FROM pit", nums="value")
def _(d):
    """Rank of the newest metric that was public on each date."""
    return evaluate(nf.metric_rank("value"), pit_panel(d).select("date", "code", "value"))


MEMBERS = """mem AS (SELECT code, industry AS index_code, min(date) AS s, max(date) AS e FROM bars JOIN industries USING (code) GROUP BY 1, 2),
  uni AS (SELECT DISTINCT d.date, mem.code FROM (SELECT DISTINCT date FROM bars) d JOIN mem ON d.date BETWEEN mem.s AND mem.e WHERE mem.index_code IN ({names}))"""


def _member_factor(name, nations, tree, cols, *named):
    names = ", ".join(f"'{n}'" for n in nations)
    base = f"{S.GRID}, {S.INDUSTRIES}, {MEMBERS.format(names=names)}, u AS (SELECT g.date, g.code, " + ", ".join(
        f"CASE WHEN uni.code IS NOT NULL THEN g.{c} END AS {c}" for c in cols
    ) + " FROM grid g LEFT JOIN uni ON uni.date = g.date AND uni.code = g.code)"

    @query(f"factor_{name}", S.steps(base, "u", *named), nums="value")
    def build(d):
        spans = d.bars.groupBy("code").agg(F.min("date").alias("start"), F.max("date").alias("end")).join(d.industries, "code")
        rows = spans.select(F.col("industry").alias("index_code"), "code", "start", "end", F.col("start").alias("opdate"))
        daily = masks.index_members(rows.filter(F.col("index_code").isin(nations)), d.bars.select("date").distinct())
        panel = grid.blank_outside(d.panel(*cols), daily.select("date", "code"))
        return evaluate(tree, panel)


_member_factor("members_momentum", ["NATION_1", "NATION_6", "NATION_11", "NATION_16", "NATION_21"], nf.momentum(window=3), ["close"], ("a", S.rret("close", 3)), ("value", S.rank("a")))
_member_factor("members_value", ["NATION_2", "NATION_7", "NATION_12"], nf.cheapness("close"), ["close"], ("a", "-close"), ("value", S.rank("a")))
_member_factor("members_reversal", ["NATION_0", "NATION_5", "NATION_10", "NATION_15"], nf.reversal(window=1), ["close"], ("a", S.rret("close", 1)), ("value", "-a"))
