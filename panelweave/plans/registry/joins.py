"""Masks, memberships, point-in-time joins, dimensions and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import asof, grid, instruments as ins, masks, prices
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S
from panelweave.plans.registry.factors import PIT, pit_panel

BASE = f"WITH {S.CAL}, {S.INTERVALS}"


def per_day(mask):
    """A mask as one row per day: how many codes, and the sum and highest of their numbers."""
    number = F.substring("code", 2, 20).cast("long")
    return mask.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("code_sum"), F.max(number).alias("last_code"))


def over_days(d, spans, start=None, end=None):
    """The same rows from disjoint spans of codes."""
    number = F.substring("code", 2, 20).cast("long")
    return masks.over_days(spans, d.calendar, [], {"n": F.lit(1), "code_sum": number}, {"last_code": number}, start, end)


PER_DAY = "SELECT date, count(*) AS n, CAST(sum(CAST(substr(code, 2) AS BIGINT)) AS BIGINT) AS code_sum, max(CAST(substr(code, 2) AS BIGINT)) AS last_code FROM m GROUP BY date"


@query("j2_interval_mask", f"{BASE}, m AS (SELECT DISTINCT cal.date, code FROM cal JOIN ivs ON cal.date >= s AND (e IS NULL OR cal.date < e)) {PER_DAY}")
def _(d):
    return over_days(d, masks.merged(d.intervals))


@query("j2_st_mask", f"""{BASE}, m AS (SELECT DISTINCT cal.date, ivs.code FROM cal JOIN ivs ON cal.date >= s AND (e IS NULL OR cal.date < e) JOIN seg ON seg.code = ivs.code
  WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND cal.date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') {PER_DAY}""")
def _(d):
    return per_day(masks.st_mask(d.calendar, d.st_intervals, "1997-01-01", "1998-12-31"))


@query("j3_suspended", f"""{BASE}, iv AS (SELECT DISTINCT cal.date, ivs.code FROM cal JOIN ivs ON cal.date >= s AND (e IS NULL OR cal.date < e)),
  st AS (SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS code, arg_max(CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 0 END, o_orderkey) AS status FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
  m AS (SELECT coalesce(iv.date, st.date) AS date, coalesce(iv.code, st.code) AS code FROM iv FULL JOIN st ON iv.date = st.date AND iv.code = st.code
  WHERE CASE WHEN status IS NOT NULL THEN status <> -1 ELSE iv.code IS NOT NULL END) {PER_DAY}""")
def _(d):
    return over_days(d, masks.suspended_spans(d.intervals, d.daily_status, ["o_orderkey"]))


MEM = f"{BASE}, mem AS (SELECT c_mktsegment AS index_code, ivs.code, s, e, s + 7 AS opdate FROM ivs JOIN seg ON seg.code = ivs.code)"


@query("j4_index_members", f"""{MEM} SELECT date, index_code, count(*) AS n_members, max(opdate) AS opdate FROM cal JOIN mem ON date >= s AND (e IS NULL OR date <= e) GROUP BY 1, 2""", dates="date opdate")
def _(d):
    return masks.member_totals(d.memberships, d.calendar)


@query("j4_members_on_day", f"{MEM} SELECT index_code, code, max(opdate) AS opdate FROM mem WHERE s <= DATE '1997-07-01' AND (e IS NULL OR e >= DATE '1997-07-01') GROUP BY 1, 2", dates="opdate")
def _(d):
    return masks.members_on(d.memberships, "1997-07-01")


@query("j5_universe", f"{MEM}, m AS (SELECT DISTINCT date, code FROM cal JOIN mem ON date >= s AND (e IS NULL OR date <= e) WHERE index_code = 'BUILDING') {PER_DAY}")
def _(d):
    return per_day(masks.universe(masks.index_members(d.memberships, d.calendar), "BUILDING"))


SPELLS = f"""{BASE}, spell AS (SELECT ivs.code, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || '0799' AS ind, s AS entry, e AS remove FROM ivs JOIN seg ON seg.code = ivs.code),
  codes AS (SELECT rpad(lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), 16, '0') AS c, n_name AS name, 'N' || n_nationkey AS alias FROM nation
  UNION ALL SELECT rpad(lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '07', 16, '0'), 'SUB ' || n_name, '' FROM nation WHERE n_regionkey = 2),
  looked AS (SELECT spell.*, coalesce(nullif(a.alias, ''), substr(ind, 1, 4)) AS c1, coalesce(a.name, substr(ind, 1, 4)) AS n1, coalesce(nullif(b.alias, ''), substr(ind, 1, 6)) AS c2, coalesce(b.name, substr(ind, 1, 6)) AS n2
  FROM spell LEFT JOIN codes a ON a.c = rpad(substr(ind, 1, 4), 16, '0') LEFT JOIN codes b ON b.c = rpad(substr(ind, 1, 6), 16, '0'))"""


@query("j6_industry_zx", f"""{SPELLS} SELECT code, entry AS start_date, coalesce(remove, DATE '2200-12-31') AS cancel_date, c1 AS first_industry_code, n1 AS first_industry_name,
  c2 AS second_industry_code, n2 AS second_industry_name FROM looked""", dates="start_date cancel_date")
def _(d):
    return masks.industry_history(d.industry_spells, d.industry_codes, "zx")


@query("j6_industry_sw", f"""{SPELLS} SELECT code, entry AS start_date, coalesce(remove, DATE '2200-12-31') AS cancel_date, 2 AS version, n1 AS index_name, c1 || '.INDX' AS index_code,
  n2 AS index_name2, c2 || '.INDX' AS index_code2 FROM looked WHERE entry <= DATE '1997-12-31' AND (remove IS NULL OR remove > DATE '1997-01-01')""", dates="start_date cancel_date")
def _(d):
    return masks.industry_history(d.industry_spells, d.industry_codes, "sw", "1997-01-01", "1997-12-31")


EOD = f"WITH {S.STOCK_EOD}, {S.INDEX_EOD}"
# Index-looking codes never read the stock table; 900001.BJ is found in the index table only.
RESOLVED = f"""{EOD}, r AS (SELECT s_info_windcode, trade_dt, s_dq_close, s_dq_volume, s_dq_close * f AS adjclose, 'stock' AS source, status FROM eod
  UNION ALL SELECT s_info_windcode, trade_dt, s_dq_close, s_dq_volume, NULL, 'index', NULL FROM ieod)"""


@query("j7_resolve_prices", f"{RESOLVED} SELECT s_info_windcode, source, count(*) AS n, sum(s_dq_close) AS total FROM r GROUP BY 1, 2", nums="total", dates="")
def _(d):
    rows = prices.resolve_prices(d.stock_eod, d.index_eod, d.asked_codes)
    return rows.groupBy("s_info_windcode", F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_dq_close").alias("total"))


@query("j8_pit_align", f"WITH {PIT} SELECT date, code, value, report_period FROM pit", nums="value", dates="date report_period")
def _(d):
    return pit_panel(d)


@query("j9_apply_universe", f"""WITH {S.GRID}, m AS (SELECT date, code FROM bars WHERE volume > 50), x AS (SELECT date, code FROM bars WHERE amount > 1200000)
  SELECT g.date, g.code, CASE WHEN m.code IS NOT NULL AND x.code IS NULL THEN close END AS close FROM grid g LEFT JOIN m ON m.date = g.date AND m.code = g.code LEFT JOIN x ON x.date = g.date AND x.code = g.code""", nums="close")
def _(d):
    return grid.blank_outside(d.panel("close"), d.bars.filter("volume > 50"), d.bars.filter("amount > 1200000"))


@query("j10_outer_align", f"""WITH {S.BARS}, a AS (SELECT date, code, close FROM bars WHERE volume > 200), b AS (SELECT date, code, high FROM bars WHERE volume < 400)
  SELECT coalesce(a.date, b.date) AS date, coalesce(a.code, b.code) AS code, close, high FROM a FULL JOIN b ON a.date = b.date AND a.code = b.code""", nums="close high")
def _(d):
    return grid.outer_align(d.bars.filter("volume > 200").select("date", "code", "close"), d.bars.filter("volume < 400").select("date", "code", "high"))


@query("j12_inner_align", f"""WITH {S.BARS}, a AS (SELECT date, code, close AS value FROM bars WHERE date >= DATE '1996-01-01'), b AS (SELECT date, code, volume AS value FROM bars WHERE date < DATE '2000-01-01' AND volume > 100),
  s AS (SELECT 'close' AS factor, * FROM a UNION ALL SELECT 'volume', * FROM b)
  SELECT factor, date, code, value FROM s WHERE date IN (SELECT date FROM a INTERSECT SELECT date FROM b) AND code IN (SELECT code FROM a INTERSECT SELECT code FROM b)""", nums="value")
def _(d):
    a = d.bars.filter("date >= DATE'1996-01-01'").select("date", "code", F.col("close").alias("value"))
    b = d.bars.filter("date < DATE'2000-01-01' AND volume > 100").select("date", "code", F.col("volume").alias("value"))
    return grid.inner_align({"close": a, "volume": b}).select("factor", "date", "code", "value")


INSTRUMENTS = """WITH b AS (SELECT *, (600000 + s_suppkey) || CASE WHEN s_nationkey < 10 THEN '.SH' WHEN s_nationkey < 20 THEN '.SZ' ELSE '.BJ' END AS code,
  CASE WHEN s_nationkey < 8 THEN '688' WHEN s_nationkey < 14 THEN '300' WHEN s_nationkey < 20 THEN '830' ELSE '600' END || s_suppkey AS num
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT code, s_name AS symbol, num AS trading_code, right(code, 2) AS exchange,
  CASE WHEN s_nationkey < 8 THEN 'STAR' WHEN s_nationkey < 14 THEN 'GEM' WHEN s_nationkey < 20 THEN 'BSE' ELSE 'MainBoard' END AS board_type,
  CASE WHEN s_acctbal < 0 THEN 'Delisted' ELSE 'Active' END AS status, '1995-01-02' AS listed_date, CASE WHEN s_acctbal < 0 THEN '2001-01-01' ELSE '0000-00-00' END AS de_listed_date,
  upper(s_name) AS abbrev_symbol, CASE WHEN s_acctbal < 9000 THEN 'N' || n_nationkey END AS industry_code, CASE WHEN s_acctbal < 9000 THEN n_name END AS industry_name,
  upper(r_name) AS sector_code, r_name AS sector_code_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS issue_price, 'Office ' || n_name AS office_address, r_name AS province,
  CASE WHEN s_acctbal > 1000 THEN '100' END AS round_lot FROM b"""


@query("j1_instruments", INSTRUMENTS, nums="issue_price", dates="")
def _(d):
    return ins.instruments(d.instrument_tables).withColumn("round_lot", F.col("round_lot").cast("string"))


@query("j13_merge_catalogs", """WITH i AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS t, lower(replace(p_name, ' ', '_')) AS f FROM part),
  d AS (SELECT lower(replace(p_type, ' ', '_')) AS t, lower(replace(p_name, ' ', '_')) AS f, min(p_brand) AS name FROM part WHERE p_size > 10 AND p_retailprice > 950 GROUP BY 1, 2)
  SELECT coalesce(i.t, d.t) AS "table", coalesce(i.f, d.f) AS field, name, CASE WHEN d.t IS NOT NULL THEN 'WDS' END AS metadata_source FROM i FULL JOIN d ON i.t = d.t AND i.f = d.f""", dates="")
def _(d):
    from panelweave.plans.registry.scans import catalog
    from panelweave.sources.files import merge_catalogs

    return merge_catalogs(catalog(d), dictionary(d))


def dictionary(d):
    low = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    return (
        d.table("part").filter("p_size > 10 AND p_retailprice > 950").groupBy(low("p_type").alias("table"), low("p_name").alias("field"))
        .agg(F.min("p_brand").alias("name")).withColumn("metadata_source", F.lit("WDS"))
    )


@query("j13_catalog_coverage", """WITH i AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS t, lower(replace(p_name, ' ', '_')) AS f FROM part),
  d AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS t, lower(replace(p_name, ' ', '_')) AS f FROM part WHERE p_size > 10 AND p_retailprice > 950)
  SELECT count(*) AS fields, count(d.t) AS described, count(d.t) / count(*) AS coverage FROM i LEFT JOIN d ON i.t = d.t AND i.f = d.f""", nums="coverage", dates="")
def _(d):
    from panelweave.plans.registry.scans import catalog
    from panelweave.sources.files import catalog_coverage, merge_catalogs

    return catalog_coverage(merge_catalogs(catalog(d), dictionary(d)))


METRIC_OF = "CASE p_brand WHEN 'Brand#1' THEN 'roe_ttm' WHEN 'Brand#2' THEN 'PB' WHEN 'Brand#3' THEN 'FLOAT_MV' ELSE p_brand END"


@query("j14_gate", f"""SELECT p_partkey, {METRIC_OF} AS key, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'reviewed' WHEN p_brand = 'Brand#3' THEN 'disputed' END AS status,
  p_brand IN ('Brand#1', 'Brand#2') AS allowed, p_brand NOT IN ('Brand#1', 'Brand#2') AS requires_warning,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'ok' WHEN p_brand = 'Brand#3' THEN 'disputed' ELSE 'unregistered' END AS gate_reason FROM part""", dates="")
def _(d):
    from panelweave.sources.registry import gate, metrics

    return gate(d.table("part").select("p_partkey", F.expr(METRIC_OF).alias("key")), metrics(d.spark))


# ---- prices --------------------------------------------------------------------------

DAY = "strptime(trade_dt, '%Y%m%d')::DATE"


@query("p1_price_post", f"""{EOD} SELECT s_info_windcode AS code, {DAY} AS date, s_dq_open * f AS open, s_dq_close * f AS close, s_dq_volume AS volume, s_dq_close * 1.1 * (s_dq_close * f / nullif(s_dq_close, 0)) AS limit_up FROM eod""", nums="open close volume limit_up")
def _(d):
    return prices.get_price(d.stock_eod, ["open", "close", "volume", "limit_up"], "post")


@query("p1_price_pre", f"""{EOD} SELECT s_info_windcode AS code, {DAY} AS date, s_dq_low * f AS low, s_dq_close * b AS close, s_dq_high * f AS prev_close FROM eod""", nums="low close prev_close")
def _(d):
    return prices.get_price(d.stock_eod, ["low", "close", "prev_close"], "pre")


@query("p2_skip_suspended", f"""{RESOLVED} SELECT s_info_windcode AS code, {DAY} AS date, coalesce(adjclose, s_dq_close) AS close, s_dq_volume AS volume FROM r WHERE source = 'index' OR status IS NULL OR status = '-1'""", nums="close volume")
def _(d):
    return prices.get_price(prices.resolve_prices(d.stock_eod, d.index_eod, d.asked_codes), ["close", "volume"], "post", skip=True)


@query("p3_latest_adjfactor", f"{EOD} SELECT s_info_windcode AS code, arg_max(f, trade_dt) AS factor, max({DAY}) AS factor_date FROM eod WHERE trade_dt <= '19991231' GROUP BY 1", nums="factor", dates="factor_date")
def _(d):
    return prices.latest_adjfactor(d.stock_eod, "1999-12-31")


# Some rows come twice, the later one with another amount; cells of the trading grid without a row are there, too.
CAP = f"""{EOD}, twice AS (SELECT trade_dt, s_info_windcode, s_dq_amount AS amount, 1 AS n FROM eod UNION ALL SELECT trade_dt, s_info_windcode, CASE WHEN s_dq_volume > 40 THEN s_dq_amount * 2 END, 2 FROM eod WHERE s_dq_volume > 30),
  kept AS (SELECT {DAY} AS date, s_info_windcode AS code, arg_max(CASE WHEN amount IS NULL THEN -1 ELSE amount END, n) AS amount FROM twice GROUP BY 1, 2),
  days AS (SELECT DISTINCT date_trunc('week', CAST(l_shipdate AS DATE))::DATE AS date FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'), cells AS (SELECT days.date, c.code, CASE WHEN amount >= 0 THEN amount END AS amount FROM days CROSS JOIN (SELECT DISTINCT code FROM kept) c LEFT JOIN kept ON kept.date = days.date AND kept.code = c.code)"""


def caps(d, log=False):
    eod = d.stock_eod.select("trade_dt", "s_info_windcode", F.col("s_dq_amount").alias("amount"), F.lit(1).alias("n"), "s_dq_volume")
    again = eod.filter("s_dq_volume > 30").withColumns({"amount": F.when(F.col("s_dq_volume") > 40, F.col("amount") * 2), "n": F.lit(2)})
    days = d.table("lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(F.trunc("l_shipdate", "week").alias("date")).distinct()
    return prices.market_cap(eod.unionByName(again), log=log, column="amount", order="n", dates=days)


@query("p4_market_cap", f"{CAP} SELECT date, code, amount * 10000 AS market_cap FROM cells", nums="market_cap")
def _(d):
    return caps(d)


@query("p4_market_cap_log", f"{CAP} SELECT date, code, ln(amount * 10000) AS market_cap FROM cells", nums="market_cap")
def _(d):
    return caps(d, True)


@query("p5_adjust_type", f"""{EOD} SELECT s_info_windcode AS code, sum(s_dq_close * f) AS by_adjclose, sum(s_dq_close * b) AS by_forward, sum(s_dq_volume) AS by_volume FROM eod GROUP BY 1""", nums="by_adjclose by_forward by_volume", dates="")
def _(d):
    """The confirmed column decides the adjustment of the price that is read."""
    out = None
    for column, field, name in (("s_dq_adjclose", "close", "by_adjclose"), ("s_dq_adjclose_backward", "close", "by_forward"), ("s_dq_volume", "volume", "by_volume")):
        got = prices.get_price(d.stock_eod, [field], prices.adjust_type_for(column)).groupBy("code").agg(F.sum(field).alias(name))
        out = got if out is None else out.join(got, "code")
    return out
