"""Composite factors and rebalanced index weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.operators.calendar import rebalance_dates
from panelweave.operators.cross_section import with_date_stats
from panelweave.operators.grid import shared_by_all, stack, within_shared
from panelweave.session import land

LIMITATION_NOTE = "weights are a research sample and not an investable index"
SCORE_FLOOR = 1e-9


def check_combination(factors: dict, weights: dict, directions: dict) -> None:
    if not factors or set(factors) != set(weights) or set(factors) != set(directions):
        raise ValueError("factors, weights and directions must name the same factors")
    if any(d not in (1, -1) for d in directions.values()):
        raise ValueError("a direction is +1 or -1")
    if any(not math.isfinite(w) for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite and sum above zero")


def check_overlap(factors: dict[str, DataFrame]) -> None:
    """Factors without a common date or a common code cannot be combined."""
    _check_shared(stack(factors), len(factors))


def _check_shared(stacked: DataFrame, n: int) -> None:
    for what in ("date", "code"):
        if shared_by_all(stacked, what, n).isEmpty():
            raise ValueError(f"the factors share no {what}")


def combine_factors(factors: dict[str, DataFrame], weights: dict[str, float], directions: dict[str, int]) -> DataFrame:
    """Weighted sum of per-date z-scores; a missing or spreadless score counts as 0.

    The factors are stacked, so any number of them costs one grouping per date and one per
    cell. The per-(factor, date) statistics are at most one row per factor and day. The stack is written once,
    and factors that share no date or no code raise an error.
    """
    check_combination(factors, weights, directions)
    whole = stack(factors)
    _check_shared(whole, len(factors))
    stacked = within_shared(whole, len(factors))
    sign = F.create_map(*[F.lit(x) for f, d in directions.items() for x in (f, float(d))])
    total = float(sum(weights.values()))
    share = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w) / total)])
    signed = stacked.select("date", "code", "factor", (F.col("value") * sign[F.col("factor")]).alias("v"))
    stats = signed.groupBy("factor", "date").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    z = F.coalesce(F.try_divide(F.col("v") - F.col("_m"), F.nullif("_s", F.lit(0.0))), F.lit(0.0))
    scored = signed.join(F.broadcast(stats), ["factor", "date"]).withColumn("_z", z * share[F.col("factor")])
    return scored.groupBy("date", "code").agg(F.sum("_z").alias("value"))


def combine_columns(panel: DataFrame, weights: dict[str, float], directions: dict[str, int]) -> DataFrame:
    """As ``combine_factors`` for factors that are columns of one dense panel.

    The cells are aligned already, so the only step beside the scan is the per-date statistics.
    """
    check_combination(weights, weights, directions)
    total = float(sum(weights.values()))
    signed = panel.select("date", "code", *[(F.col(f) * d).alias(f) for f, d in directions.items()])
    stats = [a for f in weights for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))]
    score = F.lit(0.0)
    for f, w in weights.items():
        z = F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.nullif(F.col(f"_s_{f}"), F.lit(0.0)))
        score = score + F.coalesce(z, F.lit(0.0)) * (float(w) / total)
    return with_date_stats(signed, *stats).select("date", "code", score.alias("value"))


def generate_index(composite: DataFrame, top_n: int, weighting: str = "equal", rebalance: str = "monthly") -> DataFrame:
    """Top names and weights per rebalance date; ties go to the first code.

    The row-number filter is a top-k per date, which Spark cuts on the map side before the
    shuffle, so only ``top_n`` rows per task and date move. The composite is written once; one that is empty, without
    any value on a rebalance date, or with a (date, code) twice on one raises an error.
    """
    if top_n < 1 or weighting not in ("equal", "factor_score"):
        raise ValueError("need top_n >= 1 and weighting 'equal' or 'factor_score'")
    composite = land(composite.select("date", "code", "value"), "composite")
    if composite.isEmpty():
        raise ValueError("the composite is empty")
    days = land(rebalance_dates(composite, rebalance), "days")
    check_unique_dates(composite.join(F.broadcast(days), "date", "left_semi"))
    scores = composite.filter(F.col("value").isNotNull()).join(F.broadcast(days), "date", "left_semi")
    if scores.isEmpty():
        raise ValueError("no rebalance date has a usable selection")
    order = W.partitionBy("date").orderBy(F.col("value").desc(), F.col("code"))
    chosen = scores.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top_n)
    day = W.partitionBy("date")
    if weighting == "equal":
        return chosen.select("date", "code", (F.lit(1.0) / F.count(F.lit(1)).over(day)).alias("weight"))
    lifted = chosen.withColumn("_s", F.col("value") - F.min("value").over(day) + SCORE_FLOOR)
    return lifted.select("date", "code", (F.col("_s") / F.sum("_s").over(day)).alias("weight"))


def check_unique_dates(composite: DataFrame) -> None:
    """A repeated (date, code) makes the cross-section ambiguous."""
    if composite.groupBy("date", "code").count().filter("count > 1").limit(1).count():
        raise ValueError("the composite has duplicate rows for a date")


def review_gate(metric_keys: list[str], registry: DataFrame) -> DataFrame:
    """One row (status, note): refuses missing and disputed metrics, labels unreviewed ones."""
    from panelweave.sources.registry import gate

    spark = registry.sparkSession
    if not metric_keys:
        return spark.createDataFrame([("unreviewed", "no metric declared")], "review_status string, review_note string")
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(metric_keys)], "pos int, key string")
    gated = gate(keys, registry)
    refused = [r.key for r in gated.filter(~F.col("allowed")).select("key").collect()]
    if refused:
        raise ValueError(f"metrics not allowed in an index: {refused}")
    # 'reviewed' sorts before 'unreviewed', so the maximum is the weaker label.
    note = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "unreviewed", F.struct("pos", "key")))), lambda s: F.concat(s.key, F.lit(" unreviewed"))), "；"
    )
    return gated.agg(F.max("status").alias("review_status"), note.alias("review_note"))


def review_gates(declared: DataFrame, registry: DataFrame, by: str = "index_id") -> DataFrame:
    """``review_gate`` of many indices at once: a row each, with ``refused`` metrics in place of an error.

    ``declared(index_id, pos, key)`` is the metrics of each index; a missing key is none. Of equal metrics of an
    index one counts.
    """
    from panelweave.sources.registry import gate

    gated = gate(declared.groupBy(by, "key").agg(F.min("pos").alias("pos")), registry)
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "key")))), lambda s: s["key"])
    found = gated.groupBy(by).agg(
        listed(F.col("key").isNotNull() & ~F.col("allowed")).alias("refused"), listed(F.col("status") == "unreviewed").alias("weak"), F.count("key").alias("n"),
    )
    note = F.when(F.col("n") == 0, "no metric declared").otherwise(F.array_join(F.transform("weak", lambda k: F.concat(k, F.lit(" unreviewed"))), "；"))
    status = F.when(F.size("refused") > 0, "refused").when((F.col("n") == 0) | (F.size("weak") > 0), "unreviewed").otherwise("reviewed")
    return found.select(by, status.alias("review_status"), note.alias("review_note"), F.array_join("refused", ",").alias("refused"))


def with_limitation_note(df: DataFrame, note: str = LIMITATION_NOTE) -> DataFrame:
    return df.withColumn("limitation", F.lit(note))
