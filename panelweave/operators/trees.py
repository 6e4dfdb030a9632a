"""Trees given as tables of parent links: depth and shape by pointer doubling, equality by hashes from the leaves up.

A node is ``(spec_id, node_id, parent_id, position, …)``; a root has no parent. A spec of up to ``ROW_NODES`` nodes is
walked in a row of its own. The nodes of a larger one are told apart by (spec, node), so it is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import land

KEY = ["spec_id", "node_id"]
ROW_NODES = 256


def walked(nodes: DataFrame) -> DataFrame:
    """Per distinct (spec, node): ``parent_id, depth, state, copies, children``.

    ``state`` is ``rooted``, ``orphaned`` (its topmost ancestor names a parent that is not there) or ``cyclic``
    (going up never ends; ``depth`` is then NULL). A topmost node has depth 1. Of a node given twice, the
    least parent counts. Each round doubles how far every node sees up its way, so a chain of n nodes takes
    log2(n) rounds. Both ways, in a row and over tasks, give the same.
    """
    links = land(nodes.groupBy(*KEY).agg(F.min("parent_id").alias("parent_id"), F.count(F.lit(1)).alias("copies")), "links")
    large = land(links.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROW_NODES).select("spec_id"), "large")
    if large.isEmpty():
        return _walked_in_rows(links)
    return _walked_in_rows(links.join(large, "spec_id", "left_anti")).unionByName(_walked_over_tasks(links.join(large, "spec_id", "left_semi")))


def _walked_in_rows(links: DataFrame) -> DataFrame:
    """A spec's links are an array in its row. A node's place is its number in the array, 0 is beyond the top."""
    spec = links.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "copies"))).alias("_n"))
    spec = spec.select("spec_id", "_n", F.col("_n.node_id").alias("_ids"), F.col("_n.parent_id").alias("_ups"))
    place = F.transform("_ups", lambda p: F.coalesce(F.array_position("_ids", p), F.lit(0)))
    spec = spec.withColumn("_first", F.transform(place, lambda up, i: F.struct(up.alias("up"), F.when(up == 0, 0).otherwise(1).cast("long").alias("far"), F.when(up == 0, i + 1).otherwise(up).cast("long").alias("top"))))

    def further(seen, _):
        def step(x):
            above = F.element_at(seen, x["up"].cast("int"))
            return F.when(x["up"] == 0, x).otherwise(F.struct(above["up"].alias("up"), (x["far"] + above["far"]).alias("far"), above["top"].alias("top")))

        return F.transform(seen, step)

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_n").cast("double"))).cast("int") + 1)
    seen = spec.withColumn("_seen", F.aggregate(rounds, F.col("_first"), further))
    kids = F.transform("_ids", lambda n: F.coalesce(F.size("_ups") - F.size(F.array_remove("_ups", n)), F.lit(0)).cast("long"))
    one = seen.select("spec_id", "_ups", F.explode(F.arrays_zip("_n", "_seen", kids.alias("_kids"))).alias("_x"))
    far, up = F.col("_x._seen.far"), F.col("_x._seen.up")
    orphan = F.element_at("_ups", F.col("_x._seen.top").cast("int")).isNotNull()
    return one.select(
        "spec_id", "_x._n.node_id", "_x._n.parent_id", "_x._n.copies", F.col("_x._kids").alias("children"), F.when(up == 0, far + 1).alias("depth"),
        F.when(up != 0, "cyclic").when(orphan, "orphaned").otherwise("rooted").alias("state"),
    )


def _walked_over_tasks(links: DataFrame) -> DataFrame:
    """Rounds of joins; only nodes that do not see their top yet take part in the next."""
    there = links.select("spec_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    kids = links.filter("parent_id is not null").groupBy("spec_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    known = links.join(there, ["spec_id", "parent_id"], "left").withColumn("up", F.when(F.col("there"), F.col("parent_id")))
    orphan = F.col("parent_id").isNotNull() & F.col("up").isNull()
    base = land(known.join(kids, KEY, "left").select(*KEY, "parent_id", "copies", F.coalesce("children", F.lit(0).cast("long")).alias("children"), "up", orphan.alias("orphan")), "base")
    seen = base.select(*KEY, "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"), F.when(F.col("up").isNull(), F.col("orphan")).alias("orphan"))
    largest = links.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ended, reach = None, 1
    while True:
        done = seen.filter("up is null")
        ended = done if ended is None else ended.unionByName(done)
        left = seen.filter("up is not null")
        if reach >= largest or left.isEmpty():  # whoever sees on past as many nodes as there are goes round
            break
        above = seen.unionByName(ended.join(left.select("spec_id").distinct(), "spec_id", "left_semi")).dropDuplicates(KEY)
        above = above.select("spec_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("orphan").alias("then"))
        seen = land(left.join(above, ["spec_id", "up"]).select(*KEY, F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("then").alias("orphan")), "seen")
        reach *= 2
    shape = ended.select(*KEY, (F.col("far") + 1).alias("depth"), F.when(F.col("orphan"), "orphaned").otherwise("rooted").alias("state"))
    return base.select(*KEY, "parent_id", "copies", "children").join(shape, KEY, "left").withColumn("state", F.coalesce("state", F.lit("cyclic")))


def tree_hashes(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """``spec_id, hash`` of every spec: equal for trees of equal labels in equal places, whatever their node numbers.

    A node's hash is of its labels (missing ones left out) and its children's hashes in order of position. Levels are
    hashed from the deepest up, each from the one below. The hash is NULL where the nodes are no tree:
    several roots, orphans, cycles, repeated nodes.
    """
    nodes = land(nodes.select(*KEY, "parent_id", "position", F.to_json(F.struct(*labels)).alias("label")), "nodes")
    shape = land(walked(nodes), "shape")
    rows = land(nodes.select(*KEY, "position", "label").join(shape.select(*KEY, "parent_id", "depth"), KEY), "levels")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = rows.filter(F.col("depth") == depth)
        if below is not None:
            kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "hash"))), lambda c: c["hash"]), ",")  # a formula's arguments
            level = level.join(below.groupBy("spec_id", F.col("parent_id").alias("node_id")).agg(kids.alias("kids")), KEY, "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast("string"))
        below = land(level.select("spec_id", "parent_id", "position", F.sha2(F.concat("label", F.lit("("), F.coalesce("kids", F.lit("")), F.lit(")")), 256).alias("hash")), "hashes")
    whole = shape.groupBy("spec_id").agg((F.count_if(F.col("parent_id").isNull()) == 1).alias("one"), F.every((F.col("state") == "rooted") & (F.col("copies") == 1)).alias("sound"))
    if below is None:
        return whole.select("spec_id", F.lit(None).cast("string").alias("hash"))
    return whole.join(below.groupBy("spec_id").agg(F.min("hash").alias("hash")), "spec_id", "left").select("spec_id", F.when(F.col("one") & F.col("sound"), F.col("hash")).alias("hash"))


def same_trees(expected: DataFrame, got: DataFrame, labels: list[str]) -> DataFrame:
    """``spec_id, same`` for every spec of either table of nodes."""
    a, b = (tree_hashes(t, labels).withColumnRenamed("hash", n) for t, n in ((expected, "a"), (got, "b")))
    return a.join(b, "spec_id", "full").select("spec_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))
