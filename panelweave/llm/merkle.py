"""A Merkle manifest of a dataset: leaf, root, and a proof for every row, with tampered versions.

Every row is a leaf. Per group (language), leaves ascend by id; eight neighbouring nodes become one until one
is left, the group's subroot; subroots, in order of their groups, become the root in the same way.

The tree is cut into aligned blocks of 8 ** LEVELS leaves. A task holds one block as a persistent tree:
changing a leaf makes a new version that copies the leaf's ancestors inside the block and shares every
other node. Block roots are the leaves of the next tier of blocks, up to one node per group, so no task
holds more than a block. Then the siblings of each block's ancestors come down tier by tier, and every
version goes on through those upper levels: the copy of an ancestor above the block is its own child
between the original siblings.

Places in a group come from one range partitioning: a row's number in its partition plus the counts of the
partitions before it. So a group of any size is spread over tasks.

Defined cases: any column may be null and is hashed as ``-``; null ids come first and are never tampered
with; rows of one id ascend by leaf, and equal rows are leaves of their own. A null group comes before
all others and differs from an empty name. A lone leaf is its own subroot, a lone subroot the root, with
an empty proof. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import fresh
from panelweave.llm.links import landed

ARITY = 8
#: Levels of a block: a task holds at most ARITY ** LEVELS leaves.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` where it is null."""
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def levels_over(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


class Versions:
    """Trees over one list of leaves that share their nodes. A version is the number of its root."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.digests: list[str] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = range(len(leaves))
        for _ in range(levels):
            row = [self._node(tuple(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
        self.levels, self.base = levels, row[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def _way(self, version: int, at: int) -> list[tuple[int, int]]:
        """The ancestors of leaf ``at`` from the root down, each with the number of the child to take."""
        way = []
        for level in range(self.levels - 1, -1, -1):
            k = at // ARITY**level % ARITY
            way.append((version, k))
            version = self.children[version][k]
        return way

    def changed(self, version: int, at: int, leaf: str) -> int:
        """A version with another leaf at ``at``: only the leaf's ancestors are copied."""
        self.digests.append(leaf)
        self.children.append(())
        new = len(self.digests) - 1
        for node, k in reversed(self._way(version, at)):
            c = self.children[node]
            new = self._node((*c[:k], new, *c[k + 1 :]))
        return new

    def siblings(self, version: int, at: int) -> list[tuple[str, str]]:
        """From the leaf up, what stands to the left and to the right of each node on its way."""
        d = self.digests
        join = lambda nodes: "".join([d[c] for c in nodes])
        return [(join(self.children[n][:k]), join(self.children[n][k + 1 :])) for n, k in reversed(self._way(version, at))]


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The digest at the end of ``path``, from ``node`` and the siblings on the way."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (with ``g``) with ``pos``, the place in ``g`` by ``order`` from 0, and ``n``, the size of ``g``."""
    first = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    id_ = F.monotonically_increasing_id()  # the number of the partition, and of the row in its sorted partition
    rows = landed(nodes.repartitionByRange(*first).sortWithinPartitions(*first).withColumn("at", id_), "ordered").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("g", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("g")  # a row per partition that holds some of the group
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (before - F.col("start")).alias("shift"), F.sum("k").over(w).alias("n"))
    return rows.join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of nodes (g, pos, node, n): ``nodes`` first, each next one the roots of its blocks; the last has one node per ``g``."""
    size = ARITY**levels

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        tree = Versions(block["node"].tolist(), min(levels, levels_over(n)))
        return pd.DataFrame({"g": block["g"].iloc[:1], "pos": [block["pos"].iloc[0] // size], "node": [tree.digests[tree.base]], "n": [-(-n // size)]})

    tiers = [nodes]
    while True:
        part = tiers[-1].select("g", "pos", "node", "n", F.expr(f"pos div {size}").alias("block"))
        tiers.append(landed(part.groupBy("g", "block").applyInPandas(top, "g string, pos long, node string, n long"), "tier"))
        most = tiers[-1].agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return tiers


def _upper(above: pd.DataFrame) -> tuple[list[tuple[str, str]], str, str]:
    r = above.iloc[0]
    return [(x["left"], x["right"]) for x in r["path"]], r["subroot"], r["root"]


def descend(tiers: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """(g, pos, path, subroot, root) of the nodes of the second tier, from those (g, pos, …) of the last."""
    size = ARITY**levels

    def down(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        path, subroot, root = _upper(above)
        tree = Versions(block["node"].tolist(), min(levels, levels_over(int(block["n"].iloc[0]))))
        paths = [[{"left": a, "right": b} for a, b in (*tree.siblings(tree.base, i), *path)] for i in range(len(block))]
        return pd.DataFrame({"g": block["g"].tolist(), "pos": block["pos"].tolist(), "path": paths, "subroot": subroot, "root": root})

    paths = top
    for tier in reversed(tiers[1:-1]):
        part = tier.select("g", "pos", "node", "n", F.expr(f"pos div {size}").alias("block"))
        above = paths.withColumnRenamed("pos", "block")
        paths = part.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInPandas(down, f"g string, pos long, path {PATH}, subroot string, root string")
    return paths


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, text: str = "text", tamper: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root`` and ``verified``.

    Rows for which ``tamper`` holds are folded from the leaf with ``text`` lower-cased (A-Z), the others from
    their own; ``proof`` is the digest of all siblings on the way to the root.
    """
    size = ARITY**levels
    lower = {c: F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields}
    name = fresh(docs)
    id_ = name("__id")
    changed = F.when(F.coalesce(tamper, F.lit(False)), leaf_of([lower[c] for c in fields])) if tamper is not None else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others
    leaves = landed(docs.select(F.col(key).alias(id_), g.alias("g"), leaf_of([F.col(c) for c in fields]).alias("node"), changed.alias("changed")), "leaves")
    rows = landed(placed(leaves, [id_, "node"]), "placed")
    tiers = climb(rows, levels)
    subroots = tiers[-1].select("g", "node")
    # The same tree again, over the subroots.
    named = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"])
    above = climb(landed(named, "subroots"), levels)
    start = above[-1].select("g", "pos", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))

    def top(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        path, _, root = _upper(over)
        tree = Versions(block["node"].tolist(), min(levels, levels_over(int(block["n"].iloc[0]))))
        paths = [[{"left": a, "right": b} for a, b in (*tree.siblings(tree.base, i), *path)] for i in range(len(block))]
        return pd.DataFrame({"g": block["name"].tolist(), "pos": 0, "path": paths, "subroot": block["node"].tolist(), "root": root})

    part = above[0].select("g", "name", "pos", "node", "n", F.expr(f"pos div {size}").alias("block"))
    over = descend(above, start, levels).withColumnRenamed("pos", "block")
    tops = part.groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInPandas(top, f"g string, pos long, path {PATH}, subroot string, root string")
    paths = descend(tiers, landed(tops, "tops"), levels).withColumnRenamed("pos", "block")

    def prove(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        path, subroot, root = _upper(over)
        rest = "".join([a + b for a, b in path])
        tree = Versions(block["node"].tolist(), min(levels, levels_over(int(block["n"].iloc[0]))))
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(block["node"], block["changed"], strict=True)):
            own = tree.siblings(tree.base, i)
            proofs.append(digest("".join([a + b for a, b in own]) + rest))
            within = fold(leaf, own) if other is None else tree.digests[tree.changed(tree.base, i, other)]
            folded.append(fold(within, path))
        return pd.DataFrame({id_: block[id_], "leaf": block["node"], "subroot": subroot, "root": root, "proof": proofs, "folded_root": folded})

    kind = docs.schema[key].dataType.simpleString()
    part = rows.select(id_, "g", "pos", "node", "changed", "n", F.expr(f"pos div {size}").alias("block"))
    out = part.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInPandas(prove, f"{id_} {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed(id_, key)


def op13(docs: DataFrame) -> DataFrame:
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs.select(*FIELDS), tamper=tamper)
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UINTEGER) AS bytes FROM documents),
  c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes), lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda k: 0::UINTEGER)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UINTEGER) ELSE x >> 1 END)), 4294967295::UINTEGER) AS crc FROM d),
  h AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed FROM c),
  p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
  t AS (SELECT 0 AS lvl, g, pos, leaf AS node, n FROM p
    UNION ALL SELECT lvl + 1, g, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lvl, g, pos // 8, n),
  s AS (SELECT g, lvl AS top, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
  u AS (SELECT 0 AS lvl, pos, subroot AS node, n FROM s UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
  a AS (SELECT x.doc_id, x.g, x.pos AS own, t.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < x.pos // (8 ** t.lvl)::BIGINT), '') AS l, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > x.pos // (8 ** t.lvl)::BIGINT), '') AS r
    FROM p x JOIN t ON t.g = x.g AND t.n > 1 AND t.pos // 8 = x.pos // (8 ** (t.lvl + 1))::BIGINT GROUP BY 1, 2, 3, 4),
  b AS (SELECT s.g, u.lvl, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < s.pos // (8 ** u.lvl)::BIGINT), '') AS l, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > s.pos // (8 ** u.lvl)::BIGINT), '') AS r
    FROM s JOIN u ON u.n > 1 AND u.pos // 8 = s.pos // (8 ** (u.lvl + 1))::BIGINT GROUP BY 1, 2),
  w AS (SELECT g, pos, list({'l': l, 'r': r} ORDER BY lvl) AS path FROM (SELECT g, own AS pos, lvl, l, r FROM a UNION ALL SELECT p.g, p.pos, 1000 + b.lvl, b.l, b.r FROM p JOIN b ON b.g = p.g) GROUP BY 1, 2),
  e AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM u WHERE n = 1) AS root, coalesce(w.path, []) AS path, coalesce(p.changed, p.leaf) AS start FROM p JOIN s ON s.g = p.g LEFT JOIN w ON w.g = p.g AND w.pos = p.pos)
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'l': start, 'r': ''}, path), lambda v, x: {'l': sha256(x.l || v.l || x.r), 'r': ''}).l AS folded_root, folded_root = root AS verified FROM e"""
