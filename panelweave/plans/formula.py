"""Formula trees: a closed set of eleven operators folded into DataFrame columns.

A node is a tuple: ``("var", name)``, ``("lit", number)`` or ``("call", op, args, params)``.
All variables are columns of one dense long panel, so binary operators need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.numeric import divide as safe_divide, natural_log
from panelweave.operators.cross_section import percentile_rank

MAX_WINDOW = 2520
# fixed values: operator name -> number of arguments
ARITY = {
    "add": 2, "subtract": 2, "multiply": 2, "divide": 2, "negative": 1, "log": 1,
    "rank": 1, "rolling_mean": 1, "rolling_std": 1, "rolling_return": 1, "fillna": 1,
}
ROLLING = {"rolling_mean", "rolling_std", "rolling_return"}
STEP_ONLY = {"winsorize", "zscore", "industry_neutralize"}


def var(name):
    return ("var", name)


def lit_node(value):
    return ("lit", float(value))


def _call(op, *args, **params):
    return ("call", op, tuple(var(a) if isinstance(a, str) else a for a in args), tuple(sorted(params.items())))


def add(a, b):
    return _call("add", a, b)


def subtract(a, b):
    return _call("subtract", a, b)


def multiply(a, b):
    return _call("multiply", a, b)


def divide(a, b):
    return _call("divide", a, b)


def negative(a):
    return _call("negative", a)


def log(a):
    return _call("log", a)


def rank(a):
    return _call("rank", a)


def rolling_mean(a, window):
    return _call("rolling_mean", a, window=window)


def rolling_std(a, window):
    return _call("rolling_std", a, window=window)


def rolling_return(a, window, keep_inf=True):
    return _call("rolling_return", a, window=window, **({} if keep_inf else {"keep_inf": False}))


def fillna(a, value=0.0):
    return _call("fillna", a, value=value)


def check_window(op: str, raw) -> int:
    """A window is a whole number from 1 to 2520; a bool is not a number here."""
    if raw is None:
        raise ValueError(f"{op} needs a window")
    if isinstance(raw, bool) or not isinstance(raw, (int, float)) or raw != int(raw):
        raise ValueError(f"{op}: window must be a whole number, got {raw!r}")
    if not 1 <= raw <= MAX_WINDOW:
        raise ValueError(f"{op}: window must be between 1 and {MAX_WINDOW}, got {raw!r}")
    return int(raw)


def check_tree(tree, columns) -> set[str]:
    """Names used by the tree; raises on unknown operators, arity, windows and unbound names."""
    kind = tree[0]
    if kind == "var":
        if tree[1] not in columns:
            raise ValueError(f"variable {tree[1]!r} is not bound")
        return {tree[1]}
    if kind == "lit":
        return set()
    if kind != "call":
        raise ValueError(f"unknown node {kind!r}")
    _, op, args, params = tree
    if op in STEP_ONLY:
        raise ValueError(f"{op} is a preprocessing step and not a formula operator")
    if op not in ARITY:
        raise ValueError(f"unknown operator {op!r}")
    if len(args) != ARITY[op]:
        raise ValueError(f"{op} takes {ARITY[op]} argument(s), got {len(args)}")
    if op in ROLLING:
        check_window(op, dict(params).get("window"))
    return set().union(*[check_tree(a, columns) for a in args])


def max_window(tree) -> int:
    """Largest single window in the tree; nested windows are not summed."""
    if tree[0] != "call":
        return 0
    own = int(dict(tree[3]).get("window", 0))
    return max([own] + [max_window(a) for a in tree[2]])


def evaluate(tree, panel: DataFrame, out: str = "value") -> DataFrame:
    """``(date, code, out)`` of the tree over a dense panel."""
    if not check_tree(tree, panel.columns):
        raise ValueError("a formula needs at least one variable")
    fold = _Fold(panel)
    col = fold.column(tree)
    return fold.df.select("date", "code", col.cast("double").alias(out))


def evaluate_all(trees: dict, panel: DataFrame) -> DataFrame:
    """``(date, code, …)`` with one column per named tree, from a single pass over the panel."""
    fold = _Fold(panel)
    cols = []
    for name, tree in trees.items():
        if not check_tree(tree, panel.columns):
            raise ValueError("a formula needs at least one variable")
        cols.append(fold.column(tree).cast("double").alias(name))
    return fold.df.select("date", "code", *cols)


class _Fold:
    """Turns nodes into columns; rolling and rank nodes become named columns, each once."""

    def __init__(self, panel: DataFrame):
        self.df = panel
        self.named: dict = {}

    def column(self, node) -> Column:
        if node in self.named:
            return F.col(self.named[node])
        if node[0] == "var":
            return F.col(node[1])
        if node[0] == "lit":
            return F.lit(node[1])
        _, op, args, params = node
        params = dict(params)
        parts = [self.column(a) for a in args]
        if op == "add":
            return parts[0] + parts[1]
        if op == "subtract":
            return parts[0] - parts[1]
        if op == "multiply":
            return parts[0] * parts[1]
        if op == "divide":
            return safe_divide(parts[0], parts[1])
        if op == "negative":
            return -parts[0]
        if op == "log":
            return natural_log(parts[0])
        if op == "fillna":
            return F.coalesce(parts[0], F.lit(float(params["value"])))
        held = self._held(args[0], parts[0])
        name = f"_n{len(self.named)}"
        if op == "rank":
            self.df = percentile_rank(self.df, held, name)
        else:
            self.df = self.df.withColumn(name, rolling(op, F.col(held), int(params["window"]), bool(params.get("keep_inf", True))))
        self.named[node] = name
        return F.col(name)

    def _held(self, node, col: Column) -> str:
        """A column name for an argument, adding the column if it is an expression."""
        if node[0] == "var":
            return node[1]
        if node in self.named:
            return self.named[node]
        name = f"_n{len(self.named)}"
        self.df = self.df.withColumn(name, col)
        self.named[node] = name
        return name


def rolling(op: str, x: Column, window: int, keep_inf: bool = True) -> Column:
    """A window over grid rows of one code. A code has one row per date, so it is never hot."""
    by_code = W.partitionBy("code").orderBy("date")
    if op == "rolling_return":
        was = F.lag(x, window).over(by_code)
        if not keep_inf:
            return F.try_divide(x, was) - 1
        return F.when(was != 0, F.try_divide(x, was) - 1).when((was == 0) & (x != 0), F.signum(x) * F.lit(float("inf")))
    frame = by_code.rowsBetween(1 - window, 0)
    whole = F.count(x).over(frame) == window
    stat = F.avg(x) if op == "rolling_mean" else F.stddev_samp(x)
    return F.when(whole, stat.over(frame))
