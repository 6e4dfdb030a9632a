"""Ordered preprocessing: a list of steps applied to the inputs and to the factor."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.operators import cross_section as xs
from panelweave.operators.grid import value_columns
from panelweave.operators.ordering import groups_fit
from panelweave.session import freeze

OPERATIONS = ("winsorize", "zscore", "industry_neutralize", "fillna")
TARGETS = ("variables", "factor")


@dataclass(frozen=True)
class Step:
    order: int
    operation: str
    target: str
    parameters: dict = field(default_factory=dict)


def check_steps(steps: list[Step]) -> None:
    """Orders are unique, and no operation runs twice on one target."""
    orders = [s.order for s in steps]
    if len(set(orders)) != len(orders):
        raise ValueError("two steps share an order")
    pairs = [(s.operation, s.target) for s in steps]
    if len(set(pairs)) != len(pairs):
        raise ValueError("an operation is listed twice for one target")
    for s in steps:
        if s.operation not in OPERATIONS or s.target not in TARGETS:
            raise ValueError(f"unknown step {s.operation!r} on {s.target!r}")


def apply_steps(panel: DataFrame, steps: list[Step], target: str, industries: DataFrame | None = None) -> DataFrame:
    """Run the steps of one target in order over every value column."""
    check_steps(steps)
    cols = value_columns(panel)
    todo = [s for s in sorted(steps, key=lambda s: s.order) if s.target == target]
    fits = None
    for s in todo:
        if s.operation == "fillna":
            panel = xs.fillna(panel, cols, **s.parameters)
            continue
        if fits is None:
            # Asked once: no step changes how many rows a date has.
            fits = groups_fit(panel, ["date"])
        elif not fits:
            # Aggregated statistics read the panel twice; a written copy keeps that from doubling per step.
            panel = freeze(panel)
        if s.operation == "industry_neutralize":
            if industries is None:
                raise ValueError("industry_neutralize needs an industry map")
            panel = xs.industry_neutralize(panel, cols, industries, fits)
        elif s.operation == "winsorize":
            panel = xs.winsorize(panel, cols, **s.parameters, fits=fits)
        else:
            panel = xs.zscore(panel, cols, fits)
    return panel


def step_trace(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """What ran, in the order it ran: inputs first, then the factor."""
    check_steps(steps)
    ran = [s for t in TARGETS for s in sorted(steps, key=lambda s: s.order) if s.target == t]
    rows = [(i + 1, s.order, s.operation, s.target) for i, s in enumerate(ran)]
    return spark.createDataFrame(rows, "position int, step_order int, operation string, target string")


def step_traces(steps: DataFrame, spec: str = "spec_id") -> DataFrame:
    """``step_trace`` of many factors at once: what each ran, in the order it ran.

    ``steps(spec_id, step_order, operation, target)``; a step with an unknown operation or target did not run and is
    left out. Steps of one order go by operation.
    """
    rank = F.when(F.col("target") == TARGETS[0], 0).otherwise(1)
    ran = steps.filter(F.col("operation").isin(*OPERATIONS) & F.col("target").isin(*TARGETS))
    w = Window.partitionBy(spec).orderBy(rank, "step_order", "operation")  # a factor's own steps
    return ran.select(spec, F.row_number().over(w).alias("position"), "step_order", "operation", "target")


def run_factor(tree, panel: DataFrame, steps: list[Step] = (), industries: DataFrame | None = None, out: str = "value") -> DataFrame:
    """Inputs' steps, then the formula, then the factor's steps."""
    from panelweave.plans.formula import evaluate

    ready = apply_steps(panel, list(steps), "variables", industries)
    return apply_steps(evaluate(tree, ready, out), list(steps), "factor", industries)
