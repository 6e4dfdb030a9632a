"""Batch audit of many formula specs at once.

Specs arrive as tables: ``nodes(spec_id, node_id, parent_id, position, type, op, name, value, n_params, window)``
and ``variables(spec_id, name, …)``. Depth and shape are found by walking the parent links (``trees``). All checks
are filters or groupings that are pre-summed on the map side, and a finding about names is a row per name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.trees import walked
from panelweave.plans.formula import ARITY, MAX_WINDOW, ROLLING
from panelweave.session import land

MAX_NODES = 200
MAX_DEPTH = 20
MAX_PARAMS = 8
NAME_RULE = "^[a-z][a-z0-9_]*$"
AFTER_SESSION = ("T_AFTER_CLOSE", "ANNOUNCEMENT_AFTER_CLOSE")
STANDARDIZING = ("zscore", "winsorize")


def _rows(df: DataFrame, severity: str, code: str, detail) -> DataFrame:
    return df.select("spec_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def _names(df: DataFrame, severity: str, code: str) -> DataFrame:
    """One finding per spec and distinct name; lists are not collected."""
    return _rows(df.select("spec_id", "name").distinct(), severity, code, F.col("name"))


def audit_trees(nodes: DataFrame, variables: DataFrame) -> DataFrame:
    """Shape, binding, size, window and literal findings per spec. ``nodes`` is read once."""
    columns = ["spec_id", "node_id", "parent_id", "type", "op", "name", "value", "n_params", "window"]
    nodes = land(nodes.select(*columns), "nodes")
    shape = land(walked(nodes), "shape")
    used = nodes.filter((F.col("type") == "variable") & F.col("name").isNotNull()).select("spec_id", "name", F.lit(0).alias("_d"), F.lit(1).alias("_u"))
    declared = variables.select("spec_id", "name", F.lit(1).alias("_d"), F.lit(0).alias("_u"))
    bound = declared.unionByName(used).groupBy("spec_id", "name").agg(F.sum("_d").alias("declared"), F.sum("_u").alias("used"))
    d, u = F.col("declared"), F.col("used")
    out = _found(bound, [
        (d > 1, "error", "duplicate_variable", F.col("name")), ((d > 0) & ~F.col("name").rlike(NAME_RULE), "error", "invalid_variable_name", F.col("name")),
        (d == 0, "error", "unbound_variable", F.col("name")), (u == 0, "warning", "unused_variable", F.col("name")),
    ])
    specs = shape.groupBy("spec_id").agg(
        F.sum("copies").alias("n"), F.max("depth").alias("d"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("state") == "cyclic").alias("cyclic"),
    )
    out = out.unionByName(_found(specs, [
        (F.col("n") > MAX_NODES, "error", "node_count_exceeded", F.col("n")), (F.col("d") > MAX_DEPTH, "error", "depth_exceeded", F.col("d")),
        (F.col("roots") != 1, "error", "root_count", F.col("roots")), (F.col("cyclic") > 0, "error", "cycle", F.col("cyclic")),
    ]))
    top = (F.col("state") == "orphaned") & (F.col("depth") == 1)
    out = out.unionByName(_found(shape, [(top, "error", "orphan_node", F.col("node_id")), (F.col("copies") > 1, "error", "duplicate_node", F.col("node_id"))]))
    arity = F.create_map(*[F.lit(x) for pair in ARITY.items() for x in pair])
    wanted = F.when(F.col("type") == "call", F.try_element_at(arity, F.col("op"))).otherwise(0)
    w, v, call = F.col("window"), F.col("value"), F.col("type") == "call"
    rolling = call & F.col("op").isin(*sorted(ROLLING))
    bad = (w != F.floor(w)) | (w < 1) | (w > MAX_WINDOW)
    inf = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    rows = nodes.join(shape.select("spec_id", "node_id", "children"), ["spec_id", "node_id"])
    return out.unionByName(_found(rows, [
        (call & (F.col("n_params") > MAX_PARAMS), "error", "param_count_exceeded", F.col("op")), (rolling & w.isNull(), "error", "missing_window", F.col("op")),
        (rolling & bad, "error", "window_out_of_range", F.col("op")), ((F.col("type") == "literal") & inf, "error", "non_finite_literal", v),
        (wanted != F.col("children"), "error", "wrong_arity", F.concat_ws(" ", F.col("node_id").cast("string"), F.coalesce("op", "type"), F.col("children").cast("string"))),
    ]))


def _found(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """A row for each rule that holds, from one pass over ``df``."""
    made = [F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for when, severity, code, detail in rules]
    return df.select("spec_id", F.explode(F.array_compact(F.array(*made))).alias("_f")).select("spec_id", "_f.*")


def audit_specs(specs: DataFrame, variables: DataFrame, nodes: DataFrame, trace: DataFrame) -> DataFrame:
    """Timing, availability, repeated standardising, degenerate windows, missing direction."""
    earliest = F.col("signal_offset") + F.col("available").isin(*AFTER_SESSION).cast("int")
    out = _rows(specs.filter(F.col("trade_offset") < earliest), "error", "signal_traded_before_available", F.col("available"))
    early = variables.filter(F.col("point_in_time") & ~F.col("announcement_required"))
    out = out.unionByName(_names(early, "error", "future_financial_data"))
    repeats = trace.filter(F.col("operation").isin(*STANDARDIZING)).groupBy("spec_id", "operation", "target").count().filter("count > 1")
    named = repeats.select("spec_id", F.concat_ws(" on ", "operation", "target").alias("name"))
    out = out.unionByName(_names(named, "error", "duplicate_standardization"))
    rolling = nodes.filter((F.col("type") == "call") & F.col("op").isin(*sorted(ROLLING)))
    out = out.unionByName(_rows(rolling.filter(F.col("window").isNull() | (F.col("window") < 2)), "warning", "degenerate_window", F.col("op")))
    return out.unionByName(_rows(specs.filter(F.col("direction").isNull()), "error", "direction_unset", F.lit("")))
