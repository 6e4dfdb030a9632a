"""Scans, sources and sinks, query shapes, calendar, reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import calendar as cal
from panelweave.operators import grid, library, query_shapes as qs
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S
from panelweave.session import scratch
from panelweave.sources import files

# ---- sources and sinks ---------------------------------------------------------------


@query("s2_scan_bars", "SELECT o_custkey AS code, o_orderdate AS date, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'", nums="o_totalprice")
def _(d):
    """Bars of all codes."""
    import datetime as dt

    rows = d.table("orders").withColumnsRenamed({"o_custkey": "code", "o_orderdate": "date"})
    return qs.scan_bars(rows, None, dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31), ["o_totalprice"])


@query("s3_scan_code_table", """SELECT o_custkey AS code, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""", nums="o_totalprice", dates="")
def _(d):
    """A large code list is a table: left-semi join, broadcast by the optimizer only if small."""
    codes = d.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("code"))
    return qs.static_lookup(d.table("orders").withColumnRenamed("o_custkey", "code"), codes, "code", ["o_orderkey", "o_totalprice"])


@query("s4_load_variables", f"""WITH {S.BARS} SELECT date, code, 'close' AS variable, close AS value FROM bars UNION ALL SELECT date, code, 'volume', volume FROM bars""", nums="value")
def _(d):
    """Written once per variable, then read back and stacked."""
    root = scratch(d.spark, "variables")
    for v in ("close", "volume"):
        d.bars.select("date", "code", F.col(v).alias("value")).write.parquet(f"{root}/{v}.parquet")
    return files.load_variables(d.spark, root, ["close", "volume"]).select("date", "code", "variable", "value")


@query("s5_write_factor", f"WITH {S.GRID} SELECT date, code, {S.rank('close')} AS value FROM grid", nums="value")
def _(d):
    from panelweave.plans.formula import evaluate, rank

    root = scratch(d.spark, "factor") + "/out"
    files.write_factor(evaluate(rank("close"), d.panel("close")), root)
    return d.spark.read.parquet(root).select("date", "code", "value")


@query("s6_write_audit", f"""WITH {S.GRID} SELECT 'raw' AS part, count(*) AS n FROM bars UNION ALL SELECT 'aligned/close', count(*) FROM grid
  UNION ALL SELECT 'aligned/volume', count(*) FROM grid UNION ALL SELECT 'universe', count(*) FROM bars WHERE volume > 0 UNION ALL SELECT 'excluded', count(*) FROM bars WHERE volume < 100""", dates="")
def _(d):
    root = scratch(d.spark, "audit")
    long = d.panel("close", "volume").unpivot(["date", "code"], ["close", "volume"], "variable", "value")
    files.write_audit(root, d.bars, long, d.bars.filter("volume > 0").select("date", "code"), d.bars.filter("volume < 100").select("date", "code"))
    out = d.spark.read.parquet(f"{root}/aligned").groupBy(F.concat(F.lit("aligned/"), "variable").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    for part in ("raw", "universe", "excluded"):
        out = out.unionByName(d.spark.read.parquet(f"{root}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n"))
    return out


@query("s7_fingerprint", "SELECT count(*) AS row_count, true AS order_free, true AS sees_change FROM lineitem", dates="")
def _(d):
    """The hash does not depend on row order and does depend on every row."""
    li = d.table("lineitem")
    a = library.fingerprint(li)
    b = library.fingerprint(li.repartition("l_partkey"))
    c = library.fingerprint(li.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, 9.0).otherwise(F.col("l_tax"))))
    keyed = [x.select("row_count", F.col("content_hash").alias(f"h{i}"), F.lit(0).alias("_k")) for i, x in enumerate((a, b, c))]
    both = keyed[0].join(keyed[1].drop("row_count"), "_k").join(keyed[2].drop("row_count"), "_k")
    return both.select("row_count", (F.col("h0") == F.col("h1")).alias("order_free"), (F.col("h0") != F.col("h2")).alias("sees_change"))


CATALOG_SQL = "SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS \"table\", lower(replace(p_name, ' ', '_')) AS field, p_brand AS name FROM part"


def catalog(d):
    """Parts as a field catalog: type = table, name = field."""
    low = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    return d.table("part").select(low("p_type").alias("table"), low("p_name").alias("field"), F.col("p_brand").alias("name")).distinct()


@query("s8_catalog_json", CATALOG_SQL, dates="")
def _(d):
    root = scratch(d.spark, "catalog") + "/out"
    files.write_catalog(catalog(d).withColumn("table", F.upper("table")), root)
    return files.read_catalog(d.spark, root).select("table", "field", "name")


@query("s9_registry_units", """SELECT l_returnflag AS flag, count(*) AS n, sum(CASE l_returnflag WHEN 'A' THEN l_quantity * 100 WHEN 'N' THEN l_quantity * 0.01 END) AS base_value FROM lineitem GROUP BY 1""", nums="base_value", dates="")
def _(d):
    from panelweave.sources.registry import to_base_unit

    unit = F.when(F.col("l_returnflag") == "A", "hand").when(F.col("l_returnflag") == "N", "percent").otherwise("furlong")
    rows = to_base_unit(d.table("lineitem").select("l_returnflag", "l_quantity", unit.alias("unit")), "l_quantity", "unit")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("base_value").alias("base_value"))


@query("s10_panel_from_matrix", f"WITH {S.BARS} SELECT date, code, close AS value FROM bars", nums="value")
def _(d):
    """Bars of even years as one matrix per date (all codes in a row), of odd years as one per code and year (all dates in a column)."""
    bars, text = d.bars.select("date", "code", "close"), F.date_format("date", "yyyy-MM-dd")
    even = F.year("date") % 2 == 0
    rows = bars.filter(even).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("code", "close"))).alias("x"))
    rows = rows.select(F.array(text).alias("dates"), F.col("x.code").alias("codes"), F.array("x.close").alias("values"))
    columns = bars.filter(~even).groupBy("code", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(F.struct(text.alias("date"), "close"))).alias("x"))
    columns = columns.select(F.col("x.date").alias("dates"), F.array("code").alias("codes"), F.transform("x.close", lambda v: F.array(v)).alias("values"))
    return grid.panel_from_matrix(rows.unionByName(columns)).select("date", "code", "value")


@query("s11_export_weights", f"WITH {S.BARS} SELECT date, code, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars", nums="weight")
def _(d):
    from panelweave.operators.cross_section import with_date_stats

    root = scratch(d.spark, "weights") + "/out"
    w = with_date_stats(d.bars.select("date", "code", "volume"), F.sum("volume").alias("t"))
    files.export_weights(w.select("date", "code", (F.col("volume") / F.col("t")).alias("weight")), root)
    return d.spark.read.schema("date date, code string, weight double").csv(root, header=True)


@query("s14_read_events", f"WITH {S.SESSIONS} SELECT session_id, sequence, event_type FROM ev WHERE sequence > 20", dates="")
def _(d):
    return files.read_events(d.session_events, 20).select("session_id", "sequence", "event_type")


# ---- query shapes --------------------------------------------------------------------

O_TEXT = "strftime(o_orderdate, '%Y%m%d')"


def _spans(d):
    """Customer spans as source text: yyyyMMdd and a blank open end."""
    return d.intervals.select("code", F.date_format("start", "yyyyMMdd").alias("entry_dt"), F.coalesce(F.date_format("end", "yyyyMMdd"), F.lit("")).alias("remove_dt"))


@query("q1_point_range", f"SELECT o_custkey, {O_TEXT} AS trade_dt, o_totalprice FROM orders WHERE {O_TEXT} BETWEEN '19960101' AND '19970630'", nums="o_totalprice", dates="")
def _(d):
    """The bounds are compared with the stored column, so they reach the scan."""
    import datetime as dt

    got = qs.point_range(d.table("orders"), None, "o_custkey", "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 6, 30, 23, 59, 59, 999999), ["o_totalprice"])
    return got.select("o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("trade_dt"), "o_totalprice")


REPORT_ROWS = f"WITH {S.REPORTS}"


@query("q2_report_period", f"""{REPORT_ROWS} SELECT code, report_period, announcement_date, value FROM reports WHERE report_period BETWEEN DATE '1996-03-31' AND DATE '1997-12-31' AND announcement_date <= DATE '1997-06-30'""", nums="value", dates="report_period announcement_date")
def _(d):
    import datetime as dt

    return qs.report_period(d.reports, None, "code", "report_period", dt.date(1996, 3, 31), dt.date(1997, 12, 31), ["value"], "announcement_date", dt.date(1997, 6, 30))


@query("q3_announcement_range", f"{REPORT_ROWS} SELECT code, announcement_date, value FROM reports WHERE announcement_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", nums="value", dates="announcement_date")
def _(d):
    import datetime as dt

    return qs.announcement_range(d.reports, None, "code", "announcement_date", dt.date(1998, 1, 1), dt.date(1998, 12, 31), ["value"])


@query("q4_interval_overlap", f"""WITH {S.INTERVALS} SELECT code, strftime(s, '%Y%m%d') AS entry_dt, coalesce(strftime(e, '%Y%m%d'), '') AS remove_dt FROM ivs
  WHERE s <= DATE '1997-03-31' AND (e IS NULL OR e >= DATE '1997-01-01')""", dates="")
def _(d):
    return qs.interval_overlap(_spans(d), None, "code", "entry_dt", "remove_dt", "19970101", "19970331", [])


@query("q5_cross_section_asof", "SELECT o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'", nums="o_totalprice", dates="o_orderdate")
def _(d):
    import datetime as dt

    return qs.cross_section_asof(d.table("orders"), None, "o_custkey", "o_orderdate", dt.datetime(1998, 6, 30), ["o_totalprice"])


@query("q5_cross_section_latest", """SELECT o_custkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30') WHERE rn = 1""".replace("SELECT o_custkey, o_orderdate, o_totalprice FROM", "SELECT o_custkey, o_orderdate, o_totalprice FROM"), nums="o_totalprice", dates="o_orderdate")
def _(d):
    import datetime as dt

    return qs.cross_section_asof(d.table("orders"), None, "o_custkey", "o_orderdate", dt.datetime(1998, 6, 30), ["o_totalprice"], latest=True, tie=["o_orderkey"])


@query("q6_static_lookup", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", nums="c_acctbal", dates="")
def _(d):
    return qs.static_lookup(d.table("customer"), None, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("q7_latest_announcement", f"""{REPORT_ROWS}, m AS (SELECT code, report_period, max((announcement_date, l_orderkey, l_linenumber, value)) AS v FROM reports GROUP BY 1, 2)
  SELECT code, report_period, v[1] AS announcement_date, v[4] AS value FROM m""", nums="value", dates="report_period announcement_date")
def _(d):
    got = qs.latest_announcement(d.reports, ["code", "report_period"], "announcement_date", ["l_orderkey", "l_linenumber", "value"])
    return got.select("code", "report_period", "announcement_date", "value")


@query("q8_normalise_roles", f"""WITH {S.INTERVALS} SELECT code, s AS interval_start, e AS interval_end, n FROM (SELECT code, s, e, CASE WHEN length(code) > 4 THEN NULL ELSE CAST(substr(code, 2) AS DOUBLE) END AS n FROM ivs)""", nums="n", dates="interval_start interval_end")
def _(d):
    """Text days become dates, blank ends NULL, and text that is no number NULL."""
    n = F.when(F.length("code") > 4, "n/a").otherwise(F.substring("code", 2, 10))
    rows = _spans(d).withColumn("n", n)
    return qs.normalise_roles(rows, "code", {"interval_start": "entry_dt", "interval_end": "remove_dt"}, ["n"])


@query("q9_with_lineage", "SELECT s_suppkey, s_acctbal, 'supplier' AS source_table, 's_acctbal' AS source_fields FROM supplier", nums="s_acctbal", dates="")
def _(d):
    return qs.with_lineage(qs.static_lookup(d.table("supplier"), None, "s_suppkey", ["s_acctbal"]), "supplier", ["s_acctbal"])


@query("q11_empty_result", "SELECT o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '2100-01-01'", nums="o_totalprice", dates="o_orderdate")
def _(d):
    """Nothing matches, the typed columns stay."""
    import datetime as dt

    return qs.point_range(d.table("orders"), None, "o_custkey", "o_orderdate", dt.datetime(2100, 1, 1), dt.datetime(2101, 1, 1), ["o_totalprice"])


# ---- calendar ------------------------------------------------------------------------


@query("c1_trading_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(d):
    return cal.trading_days(d.exchange_calendar, "cn")


@query("c2_trading_dates", f"WITH {S.CAL} SELECT date FROM cal WHERE date BETWEEN DATE '1996-02-01' AND DATE '1997-02-28'")
def _(d):
    return cal.trading_dates(d.calendar, "1996-02-01", "1997-02-28")


EV_DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE extract(isodow FROM o_orderdate) < 6)), n AS (SELECT max(i) AS m FROM days)"
PARTS = """ships AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS lines FROM lineitem GROUP BY 1)"""


def _weekdays(d):
    return d.calendar.filter(F.weekday("date") < 5)


def _ships(d):
    return d.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("lines"))


@query("c3_next_trading_date", f"""WITH {EV_DAYS}, {PARTS}, p AS (SELECT ships.*, (SELECT count(*) FROM days WHERE days.date <= ships.date) AS pos FROM ships)
  SELECT p.date, lines, (SELECT date FROM days WHERE i = least(pos + 3, (SELECT m FROM n)) AND pos < (SELECT m FROM n)) AS next_date FROM p""", dates="date next_date")
def _(d):
    return cal.next_trading_date(_ships(d), "date", 3, _weekdays(d))


@query("c4_prev_trading_date", f"""WITH {EV_DAYS}, {PARTS}, p AS (SELECT ships.*, (SELECT count(*) FROM days WHERE days.date < ships.date) AS pos FROM ships)
  SELECT p.date, lines, (SELECT date FROM days WHERE i = greatest(pos - 1, 1) AND pos > 0) AS prev_date FROM p""", dates="date prev_date")
def _(d):
    return cal.prev_trading_date(_ships(d), "date", 2, _weekdays(d))


@query("c5_warmup_start", f"WITH {S.CAL} SELECT date, date - (CAST(floor(1.6 * 20) AS INTEGER) + 5) AS warmup FROM cal", dates="date warmup")
def _(d):
    return d.calendar.select("date", cal.warmup_start(F.col("date"), 20).alias("warmup"))


@query("c6_trim", f"""WITH {S.GRID}, a AS (SELECT date, code, {S.rmean('close', 3)} AS value FROM grid) SELECT date, code, value FROM a WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-01'""", nums="value")
def _(d):
    """Warm-up rows feed the window and are then cut off."""
    from panelweave.plans.formula import evaluate, rolling_mean

    return cal.trim(evaluate(rolling_mean("close", 3), d.panel("close")), "1997-01-01", "1998-12-01")


@query("c7_rebalance_weekly", f"WITH {S.CAL} SELECT max(date) AS date FROM cal GROUP BY date_trunc('week', date)")
def _(d):
    return cal.rebalance_dates(d.calendar, "weekly")


@query("c7_rebalance_monthly", f"WITH {S.CAL} SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date)")
def _(d):
    return cal.rebalance_dates(d.calendar, "monthly")


# ---- reshape -------------------------------------------------------------------------

VARIABLES = ["close", "volume", "amount"]


@query("r1_to_wide", f"WITH {S.BARS} SELECT date, code, close, volume, amount FROM bars", nums="close volume amount")
def _(d):
    """All cells of three variables, one row per variable, made wide by variable."""
    long = d.bars.unpivot(["date", "code"], VARIABLES, "variable", "value")
    return grid.to_wide(long, "value", VARIABLES, "variable", ("date", "code"))


@query("r2_to_long", f"WITH {S.BARS} SELECT date, code, 'close' AS variable, close AS value FROM bars UNION ALL SELECT date, code, 'volume', volume FROM bars UNION ALL SELECT date, code, 'amount', amount FROM bars", nums="value")
def _(d):
    return grid.to_long(d.bars.select("date", "code", *VARIABLES), VARIABLES, name="variable", keys=("date", "code"))


@query("r3_dedup_last", """SELECT date, code, o_orderkey, value FROM (SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS code, o_orderkey, o_totalprice AS value,
  row_number() OVER (PARTITION BY o_orderdate, o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""", nums="value")
def _(d):
    rows = d.table("orders").select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return grid.dedup_last(rows, ["date", "code"], ["o_orderkey"])


@query("r4_densify", f"WITH {S.GRID} SELECT date, code, close, volume FROM grid", nums="close volume")
def _(d):
    return d.panel("close", "volume")


@query("r5_order_like", f"WITH {S.BARS} SELECT date, code, close FROM bars", nums="close")
def _(d):
    return grid.order_like(d.bars.select("date", "code", "close"), ["S7", "S3"])


@query("r6_exchange_code", """SELECT vendor, regexp_replace(regexp_replace(regexp_replace(vendor, '\\.XSHG$', '.SH'), '\\.XSHE$', '.SZ'), '\\.XBSE$', '.BJ') AS code
  FROM (SELECT (600000 + s_suppkey) || CASE WHEN s_nationkey < 8 THEN '.XSHG' WHEN s_nationkey < 16 THEN '.XSHE' WHEN s_nationkey < 20 THEN '.XBSE' ELSE '.HK' END AS vendor FROM supplier)""", dates="")
def _(d):
    from panelweave.functions.codes import to_exchange_code

    k = F.col("s_nationkey")
    suffix = F.when(k < 8, ".XSHG").when(k < 16, ".XSHE").when(k < 20, ".XBSE").otherwise(".HK")
    v = d.table("supplier").select(F.concat((F.lit(600000) + F.col("s_suppkey")).cast("string"), suffix).alias("vendor"))
    return v.withColumn("code", to_exchange_code(F.col("vendor")))


@query("r7_distinct_codes", "SELECT DISTINCT 'S' || l_suppkey AS code FROM lineitem", dates="")
def _(d):
    return d.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code")).distinct()
