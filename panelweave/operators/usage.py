"""Operations and acceptance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.trees import same_trees

MAX_ATTEMPTS = 2
# fixed values: error codes where only the expression is wrong
REPAIRABLE = [
    "invalid_window", "window_out_of_range", "invalid_parameter", "type_mismatch", "divide_by_zero_policy",
    "alignment_error", "missing_window", "param_count_exceeded",
]
# fixed values: categories that no change of the formula can repair
NEVER_REPAIRABLE = ["field", "empty_data", "time_basis", "resource", "infrastructure"]


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0))), F.lit(empty))


def usage_summary(usage: DataFrame, by: list[str] = ()) -> DataFrame:
    """Calls, failures, failure rate (0 without calls), tokens and cost."""
    calls, failed = F.count(F.lit(1)), F.count_if(~F.col("success"))
    return usage.groupBy(*by).agg(
        calls.alias("calls"), failed.alias("failures"), F.count_if("blocked").alias("blocked"),
        ratio(failed, calls, 0.0).alias("failure_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )


def latency_stats(usage: DataFrame, by: str = "model") -> DataFrame:
    """Mean and exact 95th percentile per model.

    Latencies are counted per distinct value first (a model may make most calls, and whole
    milliseconds repeat), so the percentile reads value counts and not calls.
    """
    counts = usage.filter(F.col("latency_ms").isNotNull()).groupBy(by, "latency_ms").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(
        F.sum("_n").alias("calls"), (F.sum(F.col("latency_ms") * F.col("_n")) / F.sum("_n")).alias("mean_ms"),
        F.percentile("latency_ms", F.lit(0.95), F.col("_n")).alias("p95_ms"),
    )


def route_errors(errors: DataFrame, attempts: str = "attempts_used") -> DataFrame:
    """May the formula be repaired? Attempts first, then the category, then the code."""
    left = F.greatest(F.lit(0), F.lit(MAX_ATTEMPTS) - F.col(attempts))
    reason = (
        F.when(F.col(attempts) >= MAX_ATTEMPTS, "attempts_exhausted").when(F.col("category").isin(NEVER_REPAIRABLE), "category_refused")
        .when(~F.col("code").isin(REPAIRABLE), "code_not_registered").otherwise("repairable")
    )
    return errors.withColumns({"reason": reason, "repairable": reason == "repairable", "attempts_remaining": left})


def score_cases(cases: DataFrame) -> DataFrame:
    """Per case: caught, missed and spurious questions.

    ``cases(case_id, category, parsed, ast_match, expected ARRAY, raised ARRAY)``.
    """
    return cases.withColumns({
        "caught": F.size(F.array_intersect("expected", "raised")), "missed": F.array_except("expected", "raised"), "spurious": F.array_except("raised", "expected"),
    })


def with_tree_match(cases: DataFrame, expected: DataFrame, parsed: DataFrame, labels: list[str]) -> DataFrame:
    """``cases`` with ``ast_match``: whether the parsed tree of a case is the expected one; no tree on either side is a match.

    Both are tables of nodes ``(spec_id, node_id, parent_id, position, …)`` with ``spec_id`` the case.
    """
    same = same_trees(expected, parsed, labels).select(F.col("spec_id").alias("case_id"), "same")
    return cases.join(same, "case_id", "left").withColumn("ast_match", F.coalesce("same", F.lit(True))).drop("same")


def suite_metrics(cases: DataFrame) -> DataFrame:
    """Acceptance figures over all cases; a rate over nothing is 1, the needless rate 0."""
    s = score_cases(cases)
    concrete = F.col("category") != "ambiguous"
    bad = ~F.col("parsed") | (concrete & ~F.col("ast_match")) | (F.size("missed") > 0) | (F.size("spurious") > 0)
    n = F.count(F.lit(1))
    return s.agg(
        n.alias("cases"), F.count_if(bad).alias("failed"), (n - F.count_if(bad)).alias("passed"),
        ratio(F.count_if("parsed"), n, 1.0).alias("parse_success_rate"),
        ratio(F.count_if(concrete & F.col("parsed") & F.col("ast_match")), F.count_if(concrete), 1.0).alias("ast_match_rate"),
        ratio(F.sum("caught"), F.sum(F.size("expected")), 1.0).alias("blocking_recall"),
        ratio(F.sum("caught"), F.sum(F.size("raised")), 1.0).alias("blocking_precision"),
        ratio(F.count_if(concrete & (F.size("raised") > 0)), F.count_if(concrete), 0.0).alias("unnecessary_question_rate"),
        F.count_if(F.size("missed") > 0).alias("missed_cases"), F.count_if(F.size("spurious") > 0).alias("spurious_cases"),
    )


def failures_by_kind(cases: DataFrame) -> DataFrame:
    """Failure rows ``(case_id, kind, detail)``: what went wrong in each case."""
    s = score_cases(cases)
    concrete = F.col("category") != "ambiguous"
    made = F.array_compact(F.array(
        F.when(~F.col("parsed"), F.struct(F.lit("model").alias("kind"), F.lit("parse_failed").alias("detail"))),
        F.when(F.col("parsed") & concrete & ~F.col("ast_match"), F.struct(F.lit("model").alias("kind"), F.lit("tree_differs").alias("detail"))),
        F.when(F.size("missed") > 0, F.struct(F.lit("model").alias("kind"), F.concat(F.lit("missed:"), F.array_join(F.array_sort("missed"), ",")).alias("detail"))),
        F.when(F.size("spurious") > 0, F.struct(F.lit("model").alias("kind"), F.concat(F.lit("spurious:"), F.array_join(F.array_sort("spurious"), ",")).alias("detail"))),
    ))
    return s.select("case_id", F.explode(made).alias("_f")).select("case_id", "_f.kind", "_f.detail")


def failure_breakdown(failures: DataFrame) -> DataFrame:
    """Failures by kind and by what went wrong: the part of the detail before its list."""
    what = F.substring_index("detail", ":", 1).alias("what")
    return failures.groupBy("kind", what).agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("case_id").alias("cases"))


def tool_accuracy(cases: DataFrame) -> DataFrame:
    """Share of scored cases whose chosen tools are the expected set. Cases without expectation are not scored."""
    scored = F.size("expected_tools") > 0
    same = F.array_sort(F.array_distinct("chosen_tools")) == F.array_sort(F.array_distinct("expected_tools"))
    return cases.agg(
        ratio(F.count_if(scored & same), F.count_if(scored), 1.0).alias("tool_selection_accuracy"), F.count_if(scored).alias("planned_cases")
    )
