"""Data-quality findings: tables of ``(subject, severity, code, evidence)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE_THRESHOLD = 0.5
MIN_SECURITIES = 5
REFERENCE_TOLERANCE = 0.05
SCHEMA = "subject string, severity string, code string, evidence map<string,string>"


def _num(c: Column) -> Column:
    return F.round(c, 6).cast("string")


def _emit(facts: DataFrame, subject: Column, rules: list[tuple[str | Column, str, Column, dict[str, Column]]]) -> DataFrame:
    """One row per rule that holds on the (single-row or small) ``facts``."""
    made = [
        F.when(F.coalesce(holds, F.lit(False)), F.struct(
            (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"),
            F.lit(code).alias("code"),
            F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]).alias("evidence"),
        ))
        for sev, code, holds, evidence in rules
    ]
    return facts.select(subject.alias("subject"), F.explode(F.array_compact(F.array(*made))).alias("_f")).select(
        "subject", "_f.severity", "_f.code", "_f.evidence"
    )


def panel_facts(panel: DataFrame, value: str = "value", cells: bool = True) -> DataFrame:
    """One row of counts about a long panel.

    Codes are counted first, then the total: every step is pre-summed. Cells are counted before them
    where ``duplicates`` are asked for (``cells``); without that a task holds its codes and not its cells. The
    number of dates comes from a set with one entry per day.
    """
    n_dates = panel.agg(F.size(F.collect_set("date"))).scalar()
    one = {"n": F.count(F.lit(1)), "k": F.count(value), "lo": F.min(value), "hi": F.max(value)}
    if cells:
        panel = panel.groupBy("code", "date").agg(*[c.alias(n) for n, c in one.items()])
        one = {"n": F.sum("n"), "k": F.sum("k"), "lo": F.min("lo"), "hi": F.max("hi"), "dup": F.count_if(F.col("n") > 1)}
    by_code = panel.groupBy("code").agg(*[c.alias(n) for n, c in one.items()], F.min("date").alias("first"), F.max("date").alias("last"))
    return by_code.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("non_null"),
        F.count(F.lit(1)).alias("codes"),
        (F.coalesce(F.sum("dup"), F.lit(0)) if cells else F.lit(None).cast("long")).alias("duplicates"),
        F.coalesce(F.bool_or(F.col("lo") != F.col("hi")), F.lit(False)).alias("some_code_varies"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    ).withColumn("dates", n_dates).withColumn("rate", F.try_divide("non_null", F.col("dates") * F.col("codes")))


def check_inputs(variables: dict) -> None:
    if not variables:
        raise ValueError("no_input_data: no input variable to compute from")


def data_findings(
    panel: DataFrame, name: str, value: str = "value", start: str | None = None, end: str | None = None,
    metric: str | None = None, registry: DataFrame | None = None, only: str | None = None,
) -> DataFrame:
    """Every input check in one pass over the panel, or the ``only`` one named."""
    facts = panel_facts(panel, value, only in (None, "duplicate_key"))
    some = F.col("rows") > 0
    rules = [
        ("warning", "empty_sample", F.col("rows") == 0, {"variable": F.lit(name)}),
        ("error", "duplicate_key", F.col("duplicates") > 0, {"duplicates": F.col("duplicates")}),
        ("warning", "sparse_data", some & (F.col("rate") < SPARSE_THRESHOLD), {"non_null_rate": _num(F.col("rate"))}),
        ("warning", "narrow_cross_section", some & (F.col("codes") < MIN_SECURITIES), {"securities": F.col("codes")}),
        ("error", "constant_input", (F.col("non_null") > 0) & ~F.col("some_code_varies"), {"variable": F.lit(name)}),
    ]
    if start and end:
        narrower = (F.col("first") > F.lit(start).cast("date")) | (F.col("last") < F.lit(end).cast("date"))
        rules.append(("warning", "partial_coverage", some & narrower, {"actual_start": F.col("first"), "actual_end": F.col("last")}))
    if metric is not None:
        facts = _with_range(facts, metric, registry)
        severity = F.when(F.col("_status") == "reviewed", "error").otherwise("warning")
        outside = (F.col("non_null") > 0) & ((F.col("lo") < F.col("_low")) | (F.col("hi") > F.col("_high")))
        rules.append((severity, "implausible_input_magnitude", outside, {"metric": F.lit(metric), "low": _num(F.col("lo")), "high": _num(F.col("hi"))}))
    return _emit(facts, F.lit(name), [r for r in rules if only in (None, r[1])])


def _with_range(facts: DataFrame, metric: str, registry: DataFrame) -> DataFrame:
    one = registry.filter(F.upper("key") == metric.upper())
    return facts.withColumns({
        "_low": one.agg(F.max("low")).scalar(), "_high": one.agg(F.max("high")).scalar(), "_status": one.agg(F.max("review_status")).scalar(),
    })


def check_empty(panel, name="panel", value="value"):
    return data_findings(panel, name, value, only="empty_sample")


def check_duplicates(panel, name="panel", value="value"):
    return data_findings(panel, name, value, only="duplicate_key")


def check_sparse(panel, name="panel", value="value"):
    return data_findings(panel, name, value, only="sparse_data")


def check_narrow(panel, name="panel", value="value"):
    return data_findings(panel, name, value, only="narrow_cross_section")


def check_constant(panel, name="panel", value="value"):
    return data_findings(panel, name, value, only="constant_input")


def check_coverage(panel, start, end, name="panel", value="value"):
    return data_findings(panel, name, value, start, end, only="partial_coverage")


def check_input_range(panel, registry, metric, name="panel", value="value"):
    return data_findings(panel, name, value, metric=metric, registry=registry, only="implausible_input_magnitude")


def check_result(factor: DataFrame, name: str = "factor", value: str = "value") -> DataFrame:
    return _result_rules(factor, name, value, ("empty_result", "all_null_result"))


def check_distribution(factor: DataFrame, name: str = "factor", value: str = "value") -> DataFrame:
    return _result_rules(factor, name, value, ("constant_factor", "sparse_result"))


def _result_rules(factor, name, value, codes):
    facts = panel_facts(factor, value, cells=False)
    has = F.col("non_null") > 0
    rules = [
        ("error", "empty_result", F.col("rows") == 0, {"subject": F.lit(name)}),
        ("error", "all_null_result", (F.col("rows") > 0) & ~has, {"subject": F.lit(name)}),
        ("warning", "constant_factor", has & (F.col("lo") == F.col("hi")), {"subject": F.lit(name)}),
        ("warning", "sparse_result", has & (F.col("rate") < SPARSE_THRESHOLD), {"non_null_rate": _num(F.col("rate"))}),
    ]
    return _emit(facts, F.lit(name), [r for r in rules if r[1] in codes])


def check_result_range(factor: DataFrame, registry: DataFrame, keys: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    """A finding per metric whose registered range the result leaves."""
    facts = factor.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    reg = registry.filter(F.upper("key").isin([k.upper() for k in keys])).filter("low is not null")
    both = reg.withColumns({"lo": facts.select("lo").scalar(), "hi": facts.select("hi").scalar()})
    outside = (F.col("lo") < F.col("low")) | (F.col("hi") > F.col("high"))
    return _emit(both, F.lit(name), [("error", "implausible_magnitude", outside, {"metric": F.col("key"), "low": _num(F.col("lo")), "high": _num(F.col("hi"))})])


def check_review(df: DataFrame, registry: DataFrame, key: str = "key") -> DataFrame:
    """A warning per subject that uses unreviewed metrics. ``df`` has (subject, key)."""
    reg = F.broadcast(registry.filter("review_status = 'unreviewed'").select(F.upper("key").alias("_k")))
    used = df.join(reg, F.upper(key) == F.col("_k"), "left_semi").groupBy("subject").agg(
        F.array_join(F.array_sort(F.collect_set(key)), ",").alias("metrics")
    )
    return _emit(used, F.col("subject"), [("warning", "unreviewed_metric", F.lit(True), {"metrics": F.col("metrics")})])


def check_reference(factor: DataFrame, reference: DataFrame, name: str = "factor") -> DataFrame:
    """Mean absolute difference to an independent recomputation, relative to its mean size.

    Averages skip missing cells; the grid both share is compared.
    """
    r = reference.select("date", "code", F.col("value").alias("_r"))
    both = factor.select("date", "code", F.col("value").alias("_f")).join(r, ["date", "code"])
    facts = both.agg(F.avg(F.abs("_r")).alias("scale"), F.avg(F.abs(F.col("_f") - F.col("_r"))).alias("diff"))
    facts = facts.withColumn("rel", F.try_divide("diff", F.nullif("scale", F.lit(0.0))))
    return _emit(facts, F.lit(name), [("warning", "reference_mismatch", F.col("rel") > REFERENCE_TOLERANCE, {"relative_difference": _num(F.col("rel"))})])


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def raise_on_errors(findings: DataFrame) -> None:
    """Stop when any finding is an error; the message shows at most twenty."""
    bad = findings.filter("severity = 'error'").select("subject", "code").limit(20).collect()
    if bad:
        raise ValueError("validation failed: " + "; ".join(f"{r.subject}: {r.code}" for r in bad))


def result_summary(factor: DataFrame, value: str = "value", trace: DataFrame | None = None) -> DataFrame:
    """Grid size, non-missing share and, if given, the executed steps."""
    facts = panel_facts(factor, value, cells=False).select("dates", "codes", F.col("rate").alias("non_null_rate"))
    if trace is None:
        return facts
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "operation"))), lambda s: s.operation), ",")
    return facts.withColumn("trace", trace.agg(steps).scalar())
