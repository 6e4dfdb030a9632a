"""Groups of similar items from colliding bands: linking, checking and connected components.

Items that share a bucket are candidates. All pairs of a bucket are never listed. Rounds compare each
item with one other of its buckets, the one with most links so far, check the pair exactly, and join
what is alike; a bucket whose items have all come together is closed. What is left (buckets with items
of several groups) is compared in full, but only from the side of the items outside the bucket's
largest group, since a pair inside one group adds nothing. There, blocks of outsiders meet blocks of
the bucket's items in a task, which gets all overlaps of two blocks from one product of their feature
tables and keeps as many links as join the groups. No bucket size is cut off.

Everything is a join or a grouping by number; small driver values are counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave.session import scratch

#: Rounds of one comparison per item before the rest is compared in full.
ROUNDS = 2
#: About as many items are in a block of outsiders, and in a block of the bucket that they are compared with.
BLOCK = 384
#: Columns of a block's feature table that are multiplied at a time.
COLUMNS = 8192
#: Groups that a task remembers the links of.
KEPT_GROUPS = 100_000
#: Bits of the largest table that tells which keys are surely absent: 64 MB.
MAX_BITS = 1 << 29
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of numbers, texts, and cells of texts that go to Python at a time: a batch lies in memory several times, on both sides.
NUMBERS, TEXTS, CELLS = 10_000, 1_000, 4


def small_batches(spark: SparkSession) -> None:
    """From here on the session gives Python at most TEXTS rows at a time, as a plan of texts that runs later should. Results are the same."""
    if not 0 < int(spark.conf.get(BATCH)) <= TEXTS:
        spark.conf.set(BATCH, str(TEXTS))


def landed(df: DataFrame, name: str, batch: int = NUMBERS) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: compressed, and safe from lost executors.

    What was shuffled for it goes once it is written, not when the driver next collects its garbage. Python
    gets ``batch`` rows at a time at most.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    settings = {CLEAN_UP: "true", BATCH: str(batch)}
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_landed_at"] = path
    return out


def held(df: DataFrame, batch: int = NUMBERS) -> DataFrame:
    """``df`` landed, for links, labels and other rows that are small beside the texts."""
    return landed(df, "held", batch)


def spent(*frames: DataFrame | None) -> None:
    """Give back the room of landed frames that nothing reads any more: an empty one takes their place."""
    for df in frames:
        path = df.__dict__.pop("_landed_at", None) if df is not None else None
        if path:
            empty(df.sparkSession, df.schema).write.mode("overwrite").parquet(path)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema, without Python on the executors."""
    return spark.range(0, numPartitions=1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def bit_table(keys: DataFrame, key: str) -> bytes:
    """One bit for each hash of ``key`` that occurs, in a table of 16 bits a key or more, up to MAX_BITS; it may be sent to every task.

    Beyond MAX_BITS / 16 keys the table fills up and tells less, at the cost of a larger shuffle.
    """
    size, n = 1 << 16, keys.count()
    while size < min(16 * n, MAX_BITS):
        size *= 2
    at = F.pmod(F.col(key), F.lit(size)) + 1
    rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in rows:
        a = (r["b"] - 1) * 4096
        out[a : a + 4096] = r["bits"]
    return bytes(out)


def in_bits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the longs may be among the keys of a bit table."""
    at = h % (8 * len(table))
    return (table[at >> 3] >> (at & 7)) & 1 == 1


def maybe_in(keys: DataFrame, key: str):
    """A filter on longs that drops only those surely not among ``keys``."""
    bits = keys.sparkSession.sparkContext.broadcast(bit_table(keys, key))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(in_bits(np.frombuffer(bits.value, np.uint8), h.to_numpy()))

    return test


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``edges`` (a, b): the least node that each is linked to.

    Each node takes its least neighbour; labels jump to their label's label until they end at nodes that have
    none below. Only edges between such ends are left for the next turn, so an edge is met once or a few times.
    """
    ends = lambda df, a, b: df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    left, labels = held(ends(edges, "a", "b")), None
    while labels is None or not left.isEmpty():
        below = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
        hooks = held(below.select(F.col("u").alias("node"), F.least("u", "v").alias("comp"), F.lit(True).alias("moved")))
        while not hooks.filter("moved").isEmpty():
            before, far = hooks, hooks.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            hooks = held(before.join(far, "comp").select("node", F.col("far").alias("comp"), (F.col("far") < F.col("comp")).alias("moved")))
            spent(before)
        before = left, labels
        for c in ("u", "v"):
            left = left.join(hooks.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")), c)
        left = held(ends(left, "u_comp", "v_comp"))
        if labels is None:
            labels = hooks
        else:
            labels = held(relabelled(labels, hooks))
            before = *before, hooks
        spent(*before)
    spent(left)
    return labels.select("node", "comp")


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` (node, comp) by what became of their comps in ``merged`` (node, comp), if anything did."""
    far = merged.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    return labels.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))


def merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the links ``found`` (a, b); only links between different groups are followed."""
    pairs = found
    for c in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")), c, "left")
    new = components(pairs.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti")
    out = held(relabelled(comps.unionByName(nodes.select("node", F.col("node").alias("comp"))), new))
    spent(new)
    return out


def _pairs_alike(features: Callable, least: float):
    """Of (a, b, body_a, body_b), the pairs whose feature sets have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = features()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                f, g = ready(x.as_py()), ready(y.as_py())
                both = len(np.intersect1d(f, g, assume_unique=True))
                keep.append(both > 0 and both >= least * (len(f) + len(g) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many features each left set shares with each right one."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    for a in range(0, len(common), COLUMNS):
        part = common[a : a + COLUMNS]
        tables = []
        for (values, owner), n in zip(sides, (len(left), len(right)), strict=True):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            t = np.zeros((n, len(part)), np.float32)
            t[owner[hit], at[hit]] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out


def _sized(size: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which sets are near enough in size to one of the others that the two can be alike."""
    others = np.sort(others)
    return np.searchsorted(others, least * size - 1e-6) < np.searchsorted(others, (size + 1e-6) / least, "right")


def _blocks_alike(features: Callable, least: float):
    """Links between the two blocks of a cell, enough to join all groups that are alike; a task gives none between groups that it has joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = features()
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(0)[i].values
                out = items.field("out").to_numpy(zero_copy_only=False)
                node, comp = (items.field(c).to_numpy() for c in ("node", "comp"))
                sets = [ready(x.as_py()) for x in items.field("body")]
                size = np.array([len(x) for x in sets])
                left, right = (np.flatnonzero(out == side) for side in (True, False))
                left, right = left[_sized(size[left], size[right], least)], right[_sized(size[right], size[left], least)]
                if not len(left) or not len(right):
                    continue
                both = overlaps([sets[k] for k in left], [sets[k] for k in right])
                size = np.add.outer(size[left], size[right])
                if len(parent) > KEPT_GROUPS:
                    parent.clear()
                found = []
                for k, j in zip(*(at.tolist() for at in np.nonzero((both > 0) & (both >= least * (size - both)))), strict=True):
                    x, y = left[k], right[j]
                    a, b = root(int(comp[x])), root(int(comp[y]))
                    if a != b:
                        parent[a] = b
                        found.append((min(node[x], node[y]), max(node[x], node[y])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def groups(members: DataFrame, bodies: DataFrame, features: Callable, least: float) -> DataFrame:
    """``node, comp`` of the nodes that are linked to another one.

    ``members`` is (bucket, node), distinct, in buckets of two or more; ``bodies`` is (node, body) of all
    its nodes. ``features()`` gives a task's function from a body to its distinct features (64-bit
    numbers); two nodes are alike at a Jaccard similarity of ``least``.
    """
    spark = members.sparkSession
    links = empty(spark, StructType.fromDDL("a long, b long"))
    comps = empty(spark, StructType.fromDDL("node long, comp long"))
    for round_ in range(ROUNDS + 1):
        of = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if round_ < ROUNDS:
            # Of either end of a bucket's groups: the item with most links, or any one.
            degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
            of = of.join(degree, "node", "left")
            rep = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("node").alias("h"), "node")
            of = held(of.select("bucket", "node", "comp", rep.alias("rep")))
            by_comp = of.groupBy("bucket", "comp").agg(F.max("rep").alias("rep"))
            ends = by_comp.groupBy("bucket").agg(F.max(F.struct("rep", "comp")).alias("main"), F.min(F.struct("comp", "rep")).alias("low"), F.max(F.struct("comp", "rep")).alias("high")).filter("low.comp < high.comp")
            rest = F.when(F.col("low.comp") == F.col("main.comp"), F.col("high.rep.node")).otherwise(F.col("low.rep.node"))
            other = F.when(F.col("comp") == F.col("main.comp"), rest).otherwise(F.col("main.rep.node"))
            offers = of.join(ends, "bucket").select("node", other.alias("other")).groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
            best = offers.groupBy("node").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
            pairs = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            for c in ("a", "b"):
                pairs = pairs.join(bodies.select(F.col("node").alias(c), F.col("body").alias(f"body_{c}")), c)
            found = pairs.select("a", "b", "body_a", "body_b").mapInArrow(_pairs_alike(features, least), "a long, b long")
        else:
            of = held(of.select("bucket", "node", "comp"))
            by_comp = of.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
            main = by_comp.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size")).filter("comps > 1")
            of = of.join(main, "bucket").withColumns({"slices": F.ceil((F.col("size") - F.col("main.n")) / BLOCK), "chunks": F.ceil(F.col("size") / BLOCK)})
            of = held(of.select("bucket", "node", "comp", (F.col("comp") != F.col("main.comp")).alias("out"), "slices", "chunks"))
            if of.isEmpty():
                spent(of)
                break
            # Outsiders go to every chunk of their bucket, all items to every slice: a row of text moves once per cell.
            upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
            part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
            left = of.filter("out").select("bucket", "node", "comp", "out", part("slices").alias("slice"), upto("chunks").alias("chunk"))
            right = of.select("bucket", "node", "comp", F.lit(False).alias("out"), upto("slices").alias("slice"), part("chunks").alias("chunk"))
            items = F.collect_list(F.struct("out", "node", "comp", "body")).alias("items")  # about two BLOCKs
            cells = left.unionByName(right).join(bodies, "node").groupBy("bucket", "slice", "chunk").agg(items)
            found = cells.select("items").mapInArrow(_blocks_alike(features, least), "a long, b long")
        found = held(found, TEXTS if round_ < ROUNDS else CELLS)
        spent(of)
        if not found.isEmpty():
            old = links, comps
            links = held(links.unionByName(found)) if round_ < ROUNDS - 1 else None  # for the next round's degrees
            comps = merged(comps, found)
            spent(*old)
        spent(found)
    spent(links)
    return comps
