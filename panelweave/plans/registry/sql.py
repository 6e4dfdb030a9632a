"""SQL texts of the derived tables, shared by the queries' SQL sides."""

BARS = """bars AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'S' || l_suppkey AS code,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-10, 6) AS close, round(max(l_extendedprice / l_quantity) + 1e-10, 6) AS high,
  round(min(l_extendedprice / l_quantity) + 1e-10, 6) AS low, sum(l_quantity) AS volume, round(sum(l_extendedprice) + 1e-10, 6) AS amount,
  round(sum(l_extendedprice * (1 - l_discount)) + 1e-10, 6) AS net_profit, round(sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) + 1e-10, 6) AS cfo,
  round(sum(l_extendedprice * l_tax) + 1e-10, 6) AS debt
  FROM lineitem GROUP BY 1, 2)"""

GRID = BARS + """, grid AS (SELECT d.date, c.code, b.close, b.high, b.low, b.volume, b.amount, b.net_profit, b.cfo, b.debt
  FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT code FROM bars) c
  LEFT JOIN bars b ON b.date = d.date AND b.code = c.code)"""

DAILY = """daily AS (SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS code, round(sum(value), 6) AS value FROM events GROUP BY 1, 2)"""

INDUSTRIES = """industries AS (SELECT 'S' || s_suppkey AS code, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CAL = "cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"

REPORTS = """reports AS (SELECT 'S' || l_suppkey AS code,
  CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_period,
  CAST(l_shipdate AS DATE) AS announcement_date, l_orderkey, l_linenumber, l_extendedprice AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

INTERVALS = """ivs AS (SELECT 'C' || o_custkey AS code, CAST(min(o_orderdate) AS DATE) AS s,
  CASE WHEN CAST(max(o_orderdate) AS DATE) <= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 90 THEN CAST(max(o_orderdate) AS DATE) END AS e
  FROM orders GROUP BY 1), seg AS (SELECT 'C' || c_custkey AS code, c_mktsegment, c_nationkey FROM customer)"""

STOCK_EOD = """eod0 AS (SELECT (600000 + l_suppkey) || '.SH' AS s_info_windcode, strftime(l_shipdate, '%Y%m%d') AS trade_dt,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-10, 4) AS s_dq_close, round(min(l_extendedprice / l_quantity) + 1e-10, 4) AS s_dq_low,
  round(max(l_extendedprice / l_quantity) + 1e-10, 4) AS s_dq_high, sum(l_quantity) AS s_dq_volume, round(sum(l_extendedprice) + 1e-10, 4) AS s_dq_amount,
  1 + max(l_discount) AS f, 1 - max(l_tax) AS b, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
  eod AS (SELECT *, s_dq_low AS s_dq_open, s_dq_high AS s_dq_preclose, CASE flag WHEN 'R' THEN '0' WHEN 'N' THEN '-1' END AS status FROM eod0)"""

INDEX_EOD = """ieod AS (SELECT CASE l_returnflag WHEN 'A' THEN '000001.SH' WHEN 'N' THEN '399001.SZ' ELSE '900001.BJ' END AS s_info_windcode,
  strftime(l_shipdate, '%Y%m%d') AS trade_dt, round(sum(l_extendedprice) / sum(l_quantity) + 1e-10, 4) AS s_dq_close, sum(l_quantity) AS s_dq_volume
  FROM lineitem GROUP BY 1, 2)"""

SESSIONS = """ev AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type, ts, event_id, value FROM events)"""


def steps(base: str, source: str, *named: tuple[str, str], final: str = "SELECT date, code, value FROM {last}") -> str:
    """``WITH base, …``: each (name, expression) is one more column over the previous step."""
    ctes, last = [base], source
    for i, (name, expr) in enumerate(named):
        ctes.append(f"s{i} AS (SELECT *, {expr} AS {name} FROM {last})")
        last = f"s{i}"
    return f"WITH {', '.join(ctes)} {final.format(last=last)}"


def rank(x: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def over(window: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"


def rmean(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {over(w)} = {w} THEN avg({x}) {over(w)} END"


def rstd(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {over(w)} = {w} THEN stddev_samp({x}) {over(w)} END"


def rret(x: str, w: int) -> str:
    return f"{x} / nullif(lag({x}, {w}) OVER (PARTITION BY code ORDER BY date), 0) - 1"
