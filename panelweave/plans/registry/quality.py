"""Data-quality findings and batch audits of formula specs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.operators import findings as fi
from panelweave.operators import spec_audit as sa
from panelweave.plans.formula import evaluate, rank, rolling_return
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S
from panelweave.sources.registry import metrics

FOUND = "SELECT '{subject}' AS subject, '{severity}' AS severity, '{code}' AS code, {evidence} AS evidence"


def shown(found):
    """Findings with their evidence as ``key=value`` text."""
    pairs = F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("subject", "severity", "code", F.array_join(pairs, ";").alias("evidence"))


def row(subject, severity, code, evidence, where, source):
    return FOUND.format(subject=subject, severity=severity, code=code, evidence=evidence) + f" FROM {source} WHERE {where}"


def daily(d):
    return d.daily


DENSE = f"{S.DAILY}, facts AS (SELECT count(*) AS n, count(value) AS k, count(DISTINCT date) AS nd, count(DISTINCT code) AS nc, min(date) AS d0, max(date) AS d1, min(value) AS lo, max(value) AS hi FROM daily)"


@query("v2_empty_sample", f"WITH {S.DAILY}, facts AS (SELECT count(*) AS n FROM daily WHERE value < -1) " + row("daily", "warning", "empty_sample", "'variable=daily'", "n = 0", "facts"), dates="")
def _(d):
    return shown(fi.check_empty(d.daily.filter("value < -1"), "daily"))


@query("v3_duplicate_key", """WITH c AS (SELECT CAST(ts AS DATE) AS date, user_id, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT count(*) AS k FROM c WHERE n > 1)
  SELECT 'events' AS subject, 'error' AS severity, 'duplicate_key' AS code, 'duplicates=' || k AS evidence FROM t WHERE k > 0""", dates="")
def _(d):
    """Raw events have several rows per user and day."""
    raw = d.table("events").select(F.col("ts").cast("date").alias("date"), F.col("user_id").cast("string").alias("code"), "value")
    return shown(fi.check_duplicates(raw, "events"))


CELLS = "cells AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS code, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), t AS (SELECT count(*) AS k, count(DISTINCT date) * count(DISTINCT code) AS n FROM cells)"


@query("v4_sparse_data", f"WITH {CELLS} SELECT 'shipments' AS subject, 'warning' AS severity, 'sparse_data' AS code, 'non_null_rate=' || round(k / n, 6) AS evidence FROM t WHERE k / n < 0.5", dates="")
def _(d):
    cells = d.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("code")).agg(F.sum("l_quantity").alias("value"))
    return shown(fi.check_sparse(cells, "shipments"))


@query("v5_narrow_cross_section", """WITH t AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem) SELECT 'flags' AS subject, 'warning' AS severity, 'narrow_cross_section' AS code, 'securities=' || n AS evidence FROM t WHERE n < 5""", dates="")
def _(d):
    flags = d.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("code")).agg(F.sum("l_quantity").alias("value"))
    return shown(fi.check_narrow(flags, "flags"))


@query("v6_constant_input", """WITH t AS (SELECT max(k) AS k FROM (SELECT c_custkey, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1))
  SELECT 'nation' AS subject, 'error' AS severity, 'constant_input' AS code, 'variable=nation' AS evidence FROM t WHERE k <= 1""", dates="")
def _(d):
    """Every customer keeps one nation, so the panel never varies within a code."""
    o, c = d.table("orders"), d.table("customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("c_custkey").cast("string").alias("code")).agg(F.max("c_nationkey").cast("double").alias("value"))
    return shown(fi.check_constant(rows, "nation"))


@query("v7_partial_coverage", f"WITH {DENSE} SELECT 'daily' AS subject, 'warning' AS severity, 'partial_coverage' AS code, 'actual_end=' || d1 || ';actual_start=' || d0 AS evidence FROM facts WHERE d0 > DATE '2023-12-01' OR d1 < DATE '2024-03-31'", dates="")
def _(d):
    return shown(fi.check_coverage(d.daily, "2023-12-01", "2024-03-31", "daily"))


@query("v8_input_range", f"WITH {DENSE} SELECT 'daily' AS subject, 'error' AS severity, 'implausible_input_magnitude' AS code, 'high=' || round(hi, 6) || ';low=' || round(lo, 6) || ';metric=PB' AS evidence FROM facts WHERE lo < 0 OR hi > 100", dates="")
def _(d):
    return shown(fi.check_input_range(d.daily, metrics(d.spark), "PB", "daily"))


@query("v9_result_missing", f"""WITH {S.GRID}, r AS (SELECT {S.rret('close', 500)} AS value FROM grid), t AS (SELECT count(*) AS n, count(value) AS k FROM r)
  SELECT 'factor' AS subject, 'error' AS severity, 'all_null_result' AS code, 'subject=factor' AS evidence FROM t WHERE n > 0 AND k = 0""", dates="")
def _(d):
    """A window longer than the panel leaves nothing but missing values."""
    return shown(fi.check_result(evaluate(rolling_return("close", 500), d.panel("close"))))


@query("v10_distribution", f"""WITH {S.DAILY}, t AS (SELECT count(*) AS k, (SELECT count(DISTINCT date) * count(DISTINCT code) FROM daily) AS n FROM daily WHERE value > 40)
  SELECT 'factor' AS subject, 'warning' AS severity, 'sparse_result' AS code, 'non_null_rate=' || round(k / n, 6) AS evidence FROM t WHERE k / n < 0.5 UNION ALL
  SELECT 'one' AS subject, 'warning', 'constant_factor', 'subject=one' FROM t""", dates="")
def _(d):
    thin = d.daily.withColumn("value", F.when(F.col("value") > 40, F.col("value")))
    return shown(fi.check_distribution(thin)).unionByName(shown(fi.check_distribution(d.daily.withColumn("value", F.lit(1.0)), "one").filter("code = 'constant_factor'")))


@query("v11_result_range", f"WITH {DENSE} SELECT 'factor' AS subject, 'error' AS severity, 'implausible_magnitude' AS code, 'high=' || round(hi, 6) || ';low=' || round(lo, 6) || ';metric=' || m AS evidence FROM facts, (VALUES ('ROA_TTM', -50.0, 50.0), ('PB', 0.0, 100.0), ('PS_TTM', 0.0, 500.0)) v(m, a, b) WHERE lo < a OR hi > b", dates="")
def _(d):
    return shown(fi.check_result_range(d.daily, metrics(d.spark), ["ROA_TTM", "PB", "PS_TTM", "S_DQ_VOLUME"]))


@query("v12_unreviewed", """SELECT p_type AS subject, 'warning' AS severity, 'unreviewed_metric' AS code, 'metrics=' || string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS evidence FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1""", dates="")
def _(d):
    reg = d.spark.createDataFrame([("BRAND#1", "unreviewed"), ("BRAND#2", "unreviewed"), ("BRAND#3", "unreviewed"), ("BRAND#4", "reviewed")], "key string, review_status string")
    return shown(fi.check_review(d.table("part").select(F.col("p_type").alias("subject"), F.col("p_brand").alias("key")), reg))


@query("v13_reference_mismatch", f"""WITH {S.BARS}, t AS (SELECT avg(abs(high - close)) / avg(abs(high)) AS r FROM bars)
  SELECT 'factor' AS subject, 'warning' AS severity, 'reference_mismatch' AS code, 'relative_difference=' || round(r, 6) AS evidence FROM t WHERE r > 0.05""", dates="")
def _(d):
    return shown(fi.check_reference(d.bars.select("date", "code", F.col("close").alias("value")), d.bars.select("date", "code", F.col("high").alias("value"))))


@query("v14_severity_counts", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'error' WHEN o_orderstatus = 'O' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM orders GROUP BY 1""", dates="")
def _(d):
    s = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    return fi.severity_counts(d.table("orders").select(s.alias("severity")))


@query("v16_result_summary", f"WITH {S.GRID} SELECT count(DISTINCT date) AS dates, count(DISTINCT code) AS codes, count(close) / count(*) AS non_null_rate FROM grid", nums="non_null_rate", dates="")
def _(d):
    return fi.result_summary(evaluate(rank("close"), d.panel("close")))


# ---- formula specs -------------------------------------------------------------------
# An order is a spec and its lines are the nodes of its tree.


def tables(d):
    li = d.table("lineitem")
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "A", "variable").when(F.col("l_returnflag") == "R", "literal").otherwise("call")
    op = F.when(n == 1, "rank").when(n == 2, "rolling_mean").when(n == 3, "rolling_std").when(n == 4, "rolling_return").otherwise("add")
    name = F.concat(F.when(F.col("l_discount") > 0.08, "V").otherwise("v"), n.cast("string"))
    nodes = li.select(
        F.col("l_orderkey").alias("spec_id"), (n * 4).alias("depth"), kind.alias("type"), F.when(kind == "call", op).alias("op"),
        F.when(kind == "variable", name).alias("name"),
        F.when(kind == "literal", F.when(F.col("l_tax") == 0.0, F.lit(float("inf"))).otherwise(F.col("l_tax"))).alias("value"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("n_params"),
        F.when(F.col("l_discount") > 0.0, (F.col("l_quantity") * 60 + F.when(F.col("l_tax") > 0.07, 0.5).otherwise(0.0) - 60)).alias("window"),
    )
    variables = li.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("spec_id"), name.alias("name"), (F.col("l_tax") > 0.05).alias("point_in_time"), (F.col("l_discount") > 0.05).alias("announcement_required")
    )
    o = d.table("orders")
    specs = o.select(
        F.col("o_orderkey").alias("spec_id"), F.lit(0).alias("signal_offset"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("trade_offset"),
        F.when(F.col("o_totalprice") > 200000, "T_AFTER_CLOSE").otherwise("T_BEFORE_OPEN").alias("available"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "higher_is_better").alias("direction"),
    )
    trace = li.select(
        F.col("l_orderkey").alias("spec_id"), F.when(F.col("l_returnflag") == "A", "zscore").when(F.col("l_returnflag") == "R", "winsorize").otherwise("fillna").alias("operation"),
        F.when(F.col("l_linestatus") == "F", "factor").otherwise("variables").alias("target"),
    )
    return nodes, variables, specs, trace


SPEC_SQL = """WITH nodes AS (SELECT l_orderkey AS spec_id, l_linenumber * 4 AS depth, CASE l_returnflag WHEN 'A' THEN 'variable' WHEN 'R' THEN 'literal' ELSE 'call' END AS type,
  CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber WHEN 1 THEN 'rank' WHEN 2 THEN 'rolling_mean' WHEN 3 THEN 'rolling_std' WHEN 4 THEN 'rolling_return' ELSE 'add' END END AS op,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount > 0.08 THEN 'V' ELSE 'v' END || l_linenumber END AS name, l_returnflag = 'R' AND l_tax = 0 AS bad_literal,
  CAST(floor(l_quantity / 5) AS INTEGER) AS n_params, CASE WHEN l_discount > 0 THEN l_quantity * 60 + CASE WHEN l_tax > 0.07 THEN 0.5 ELSE 0 END - 60 END AS w FROM lineitem),
  vars AS (SELECT l_orderkey AS spec_id, CASE WHEN l_discount > 0.08 THEN 'V' ELSE 'v' END || l_linenumber AS name, l_tax > 0.05 AS pit, l_discount > 0.05 AS ann FROM lineitem WHERE l_linestatus = 'F'),
  used AS (SELECT DISTINCT spec_id, name FROM nodes WHERE type = 'variable'), decl AS (SELECT spec_id, name, count(*) AS n FROM vars GROUP BY 1, 2),
  roll AS (SELECT * FROM nodes WHERE op IN ('rolling_mean', 'rolling_std', 'rolling_return'))"""


def names(severity, code, source):
    return f"SELECT DISTINCT spec_id, '{severity}' AS severity, '{code}' AS code, name AS detail FROM ({source})"


# The lines of a part are the nodes of a spec: chains, binary heaps, chains with a lost link, chains that bite their tail.
PARENT = """CASE WHEN spec_id % 9 = 0 AND n = 5 THEN NULL WHEN n = 1 THEN NULL WHEN spec_id % 4 = 1 THEN CAST(floor(n / 2) AS BIGINT)
  WHEN spec_id % 4 = 2 AND n = 4 THEN n + 1000 WHEN spec_id % 4 = 3 AND n = 2 AND m > 6 THEN CAST(6 AS BIGINT) ELSE n - 1 END"""
TREE_SQL = f"""WITH RECURSIVE l AS (SELECT *, l_partkey AS spec_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag) AS n, count(*) OVER (PARTITION BY l_partkey) AS m FROM lineitem),
  nodes AS (SELECT spec_id, n, {PARENT} AS parent, CASE l_returnflag WHEN 'A' THEN 'variable' WHEN 'R' THEN 'literal' ELSE 'call' END AS type,
    CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber WHEN 1 THEN 'rank' WHEN 2 THEN 'rolling_mean' WHEN 3 THEN 'rolling_std' WHEN 4 THEN 'rolling_return' ELSE 'add' END END AS op,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount > 0.08 THEN 'V' ELSE 'v' END || l_linenumber END AS name, l_returnflag = 'R' AND l_tax = 0 AS bad_literal,
    CAST(floor(l_quantity / 5) AS INTEGER) AS n_params, CASE WHEN l_discount > 0 THEN l_quantity * 60 + CASE WHEN l_tax > 0.07 THEN 0.5 ELSE 0 END - 60 END AS w FROM l),
  vars AS (SELECT l_partkey AS spec_id, CASE WHEN l_discount > 0.08 THEN 'V' ELSE 'v' END || l_linenumber AS name FROM lineitem WHERE l_linestatus = 'F'),
  used AS (SELECT DISTINCT spec_id, name FROM nodes WHERE type = 'variable'), decl AS (SELECT spec_id, name, count(*) AS n FROM vars GROUP BY 1, 2),
  roll AS (SELECT * FROM nodes WHERE op IN ('rolling_mean', 'rolling_std', 'rolling_return')),
  lost AS (SELECT a.spec_id, a.n FROM nodes a ANTI JOIN nodes b ON b.spec_id = a.spec_id AND b.n = a.parent WHERE a.parent IS NOT NULL),
  down AS (SELECT spec_id, n, 1 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT spec_id, n, 1 FROM lost UNION ALL SELECT k.spec_id, k.n, d.depth + 1 FROM down d JOIN nodes k ON k.spec_id = d.spec_id AND k.parent = d.n),
  kids AS (SELECT a.spec_id, a.n, a.type, a.op, count(b.n) AS k FROM nodes a LEFT JOIN nodes b ON b.spec_id = a.spec_id AND b.parent = a.n GROUP BY 1, 2, 3, 4)"""


@query("f1_audit_trees", f"""{TREE_SQL} {names('error', 'duplicate_variable', 'SELECT * FROM decl WHERE n > 1')}
  UNION ALL {names('error', 'invalid_variable_name', "SELECT * FROM decl WHERE name LIKE 'V%'")}
  UNION ALL {names('error', 'unbound_variable', 'SELECT spec_id, name FROM used EXCEPT SELECT spec_id, name FROM decl')}
  UNION ALL {names('warning', 'unused_variable', 'SELECT spec_id, name FROM decl EXCEPT SELECT spec_id, name FROM used')}
  UNION ALL SELECT spec_id, 'error', 'depth_exceeded', CAST(max(depth) AS VARCHAR) FROM down GROUP BY 1 HAVING max(depth) > 20
  UNION ALL SELECT spec_id, 'error', 'node_count_exceeded', CAST(count(*) AS VARCHAR) FROM nodes GROUP BY 1 HAVING count(*) > 200
  UNION ALL SELECT spec_id, 'error', 'root_count', CAST(count(*) - count(parent) AS VARCHAR) FROM nodes GROUP BY 1 HAVING count(*) - count(parent) <> 1
  UNION ALL SELECT spec_id, 'error', 'cycle', CAST(count(*) AS VARCHAR) FROM nodes ANTI JOIN down USING (spec_id, n) GROUP BY 1
  UNION ALL SELECT spec_id, 'error', 'orphan_node', CAST(n AS VARCHAR) FROM lost
  UNION ALL SELECT spec_id, 'error', 'wrong_arity', n || ' ' || coalesce(op, type) || ' ' || k FROM kids WHERE k <> CASE WHEN type <> 'call' THEN 0 WHEN op = 'add' THEN 2 ELSE 1 END
  UNION ALL SELECT spec_id, 'error', 'param_count_exceeded', op FROM nodes WHERE type = 'call' AND n_params > 8
  UNION ALL SELECT spec_id, 'error', 'missing_window', op FROM roll WHERE w IS NULL
  UNION ALL SELECT spec_id, 'error', 'window_out_of_range', op FROM roll WHERE w <> floor(w) OR w < 1 OR w > 2520
  UNION ALL SELECT spec_id, 'error', 'non_finite_literal', 'Infinity' FROM nodes WHERE bad_literal""", dates="")
def _(d):
    """Only parent links are given; depth, roots, lost links, cycles and arity are found by walking them."""
    k, w = F.col("l_linenumber"), Window.partitionBy("l_partkey")
    li = d.table("lineitem").withColumn("n", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")).cast("long")).withColumn("m", F.count(F.lit(1)).over(w)).withColumn("spec_id", F.col("l_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "variable").when(F.col("l_returnflag") == "R", "literal").otherwise("call")
    op = F.when(k == 1, "rank").when(k == 2, "rolling_mean").when(k == 3, "rolling_std").when(k == 4, "rolling_return").otherwise("add")
    name = F.concat(F.when(F.col("l_discount") > 0.08, "V").otherwise("v"), k.cast("string"))
    nodes = li.select(
        "spec_id", F.col("n").alias("node_id"), F.expr(PARENT).alias("parent_id"), F.lit(0).alias("position"), kind.alias("type"), F.when(kind == "call", op).alias("op"), F.when(kind == "variable", name).alias("name"),
        F.when(kind == "literal", F.when(F.col("l_tax") == 0.0, F.lit(float("inf"))).otherwise(F.col("l_tax"))).alias("value"), F.floor(F.col("l_quantity") / 5).cast("int").alias("n_params"),
        F.when(F.col("l_discount") > 0.0, (F.col("l_quantity") * 60 + F.when(F.col("l_tax") > 0.07, 0.5).otherwise(0.0) - 60)).alias("window"),
    )
    variables = d.table("lineitem").filter("l_linestatus = 'F'").select(F.col("l_partkey").alias("spec_id"), name.alias("name"))
    return sa.audit_trees(nodes, variables)


@query("f2_audit_specs", f"""{SPEC_SQL}, specs AS (SELECT o_orderkey AS spec_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS trade, o_totalprice > 200000 AS late, o_orderpriority = '1-URGENT' AS undirected FROM orders),
  tr AS (SELECT l_orderkey AS spec_id, CASE l_returnflag WHEN 'A' THEN 'zscore' WHEN 'R' THEN 'winsorize' ELSE 'fillna' END AS o, CASE l_linestatus WHEN 'F' THEN 'factor' ELSE 'variables' END AS t FROM lineitem)
  SELECT spec_id, 'error' AS severity, 'signal_traded_before_available' AS code, 'T_AFTER_CLOSE' AS detail FROM specs WHERE late AND trade < 1
  UNION ALL {names('error', 'future_financial_data', 'SELECT DISTINCT spec_id, name FROM vars WHERE pit AND NOT ann')}
  UNION ALL {names('error', 'duplicate_standardization', "SELECT spec_id, o || ' on ' || t AS name FROM tr WHERE o <> 'fillna' GROUP BY spec_id, o, t HAVING count(*) > 1")}
  UNION ALL SELECT spec_id, 'warning', 'degenerate_window', op FROM roll WHERE w IS NULL OR w < 2
  UNION ALL SELECT spec_id, 'error', 'direction_unset', '' FROM specs WHERE undirected""", dates="")
def _(d):
    nodes, variables, specs, trace = tables(d)
    return sa.audit_specs(specs, variables, nodes, trace)
