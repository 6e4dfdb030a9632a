"""Ranks and positions inside groups that may be very large.

A window over ``date`` puts the whole cross-section of a date in one task. That is right
while the job's input is small or no group is large, which is checked first. Otherwise the rows
are cut into ordered buckets per group: splitters come from a hash-chosen sample, each bucket
is ranked in its own task, and the buckets' exact counts shift the local ranks to their place
in the group. Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.session import freeze

ONE_TASK_BYTES = 64 << 20
ONE_TASK_KEY = "panelweave.oneTaskBytes"
GROUP_ROWS = 1_000_000
SPLIT_BYTES = 16 << 20
GROUP_KEY = "panelweave.groupRows"
SPLITS = 128
SAMPLE_PER_SPLIT = 100


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables ``df`` reads, from the optimizer's own statistics (no job runs)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def groups_fit(df: DataFrame, keys: list[str]) -> bool:
    """Whether every group is small enough for a single task.

    True if the whole input is, which needs no job. Otherwise the largest group is counted: that
    is one pass over the key columns, pre-summed on the map side.
    """
    conf = df.sparkSession.conf
    if input_bytes(df) <= int(conf.get(ONE_TASK_KEY, str(ONE_TASK_BYTES))):
        return True
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
    return (largest or 0) <= int(conf.get(GROUP_KEY, str(GROUP_ROWS)))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """More tasks for costly work on few input splits; large inputs have splits enough.

    A table in one file and row group is one task, whatever it costs per row. Below 16 MB per
    core the rows are hashed over the cores first.
    """
    sc = df.sparkSession.sparkContext
    if input_bytes(df) >= sc.defaultParallelism * SPLIT_BYTES:
        return df
    return df.repartition(sc.defaultParallelism, *cols)


def positions(df: DataFrame, value: str, keys: list[str], row_id: list[str]) -> DataFrame:
    """Add ``_lt``, ``_le`` and ``_n``: how many non-missing values of the group are below the
    row's value, how many are at most it, and how many there are.

    ``row_id`` names columns that tell rows of a group apart; it only drives the sample.
    """
    v = F.col(value)
    if groups_fit(df, keys):
        by = W.partitionBy(*keys)
        up = by.orderBy(v.asc_nulls_last())
        return df.select(
            "*",
            (F.rank().over(up) - 1).cast("long").alias("_lt"),
            F.count(v).over(up).alias("_le"),
            F.count(v).over(by).alias("_n"),
        )

    df = freeze(df)
    cut = _with_bucket(df, [v], keys, row_id, ties_apart=True)
    totals = _bucket_offsets(cut, keys)
    placed = cut.join(totals, [*keys, "_b"], "left")
    # Rows equal to a splitter need no ordering at all, however many they are.
    tied = placed.filter("_b % 2 = 1").select(
        *df.columns, F.col("_off").alias("_lt"), (F.col("_off") + F.col("_size")).alias("_le"), "_n"
    )
    up = W.partitionBy(*keys, "_b").orderBy(v)
    open_ = placed.filter("_b % 2 = 0").select(
        *df.columns,
        (F.col("_off") + F.rank().over(up) - 1).alias("_lt"),
        (F.col("_off") + F.count(v).over(up)).alias("_le"),
        "_n",
    )
    empty = _group_sizes(df, v, keys)
    missing = df.filter(v.isNull()).join(empty, keys, "left").select(
        *df.columns, F.lit(None).cast("long").alias("_lt"), F.lit(None).cast("long").alias("_le"),
        F.coalesce("_n", F.lit(0)).alias("_n"),
    )
    return tied.unionByName(open_).unionByName(missing)


def numbered(df: DataFrame, order: list[Column], keys: list[str], out: str = "_rn") -> DataFrame:
    """Add the 1-based position of each row in its group and the group's size ``_n``.

    ``order`` must be a total order without missing values, ascending.
    """
    if groups_fit(df, keys):
        by = W.partitionBy(*keys)
        return df.select(
            "*",
            F.row_number().over(by.orderBy(*order)).cast("long").alias(out),
            F.count(F.lit(1)).over(by).alias("_n"),
        )
    df = freeze(df)
    cut = _with_bucket(df, order, keys, None, ties_apart=False)
    placed = cut.join(_bucket_offsets(cut, keys), [*keys, "_b"], "left")
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return placed.select(*df.columns, (F.col("_off") + inside).cast("long").alias(out), "_n")


def _group_sizes(df: DataFrame, v: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(v).alias("_n"))


def _with_bucket(
    df: DataFrame, order: list[Column], keys: list[str], row_id: list[str] | None, ties_apart: bool
) -> DataFrame:
    """Bucket number per row: even numbers are the gaps between splitters, and with
    ``ties_apart`` odd ones are the splitters' own values."""
    key = order[0] if len(order) == 1 else F.struct(*order)
    present = df.filter(order[0].isNotNull()).withColumn("_key", key)
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64(*[F.col(c) for c in (row_id or [])], "_key"), F.lit(1 << 40))
    keep = F.lit(float(SPLITS * SAMPLE_PER_SPLIT * (1 << 40))) / F.col("_n")
    # Only large groups are cut. The sample holds about SPLITS * SAMPLE_PER_SPLIT rows of each.
    bound = int(df.sparkSession.conf.get(GROUP_KEY, str(GROUP_ROWS)))
    sample = (
        present.join(sizes.filter(F.col("_n") > bound), keys)
        .filter(draw < keep)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_key")).alias("_s"))
    )
    splitters = sample.select(*keys, F.expr(
        f"array_distinct(transform(sequence(1, {SPLITS} - 1),"
        f" i -> element_at(_s, cast(least(size(_s), i * greatest(1, size(_s) div {SPLITS})) as int))))"
    ).alias("_cuts"))
    cut = present.join(sizes, keys).join(splitters, keys, "left")
    below = F.coalesce(F.size(F.filter("_cuts", lambda s: s < F.col("_key"))), F.lit(0))
    bucket = 2 * below
    if ties_apart:
        bucket = bucket + F.coalesce(F.array_contains("_cuts", F.col("_key")).cast("int"), F.lit(0))
    return cut.withColumn("_b", bucket).drop("_cuts", "_key")


def _bucket_offsets(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in earlier buckets of the same group; at most ``2 * SPLITS`` rows per group."""
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0)))
