"""The Merkle manifest against a plain one, and the persistent trees it is made of."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from panelweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `pos` string, g string, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = row[4] if row[4] is None or not lower else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
    values = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Levels from the leaves to the one node that is left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_way(levels, at):
    way = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        way.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return way


def plain_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in langs[name]])
    over = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(langs[name]):
            way = plain_way(trees[name], i) + plain_way(over, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = plain_leaf(r, bad)
            for left, right in way:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in way))
            out.append((r[0], plain_leaf(r), trees[name][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def run(spark, rows, levels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return rows_of(merkle.manifest(docs, tamper=tamper, levels=levels))


def made(n, langs, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Élan ABC xyz", "lower only", "Zz" * rng.randrange(300)])
        rows.append((i, rng.choice([None, "src", "Ü"]), langs(i), rng.choice([None, 7]), text, "clash", "clash", "clash"))
    rows += rows[:3]  # repeated rows
    rows += [(None, "src", langs(i), 1, t, "", "", "") for i, t in enumerate(("A", "B", None))]
    rows += [(5, "other", langs(5), 2, "same id", "", "", "")]
    rng.shuffle(rows)
    return rows


def test_manifest_is_the_plain_one_over_several_tiers(spark):
    # A hot group of over 64 leaves, many small ones, a null one and an empty name: two tiers and more everywhere.
    rows = made(160, lambda i: "en" if i % 2 else (None, "", "ß", *"abcdefgh")[i // 2 % 11], 1)
    assert run(spark, rows, 1) == plain_manifest(rows)


def test_manifest_in_whole_blocks(spark):
    rows = made(90, lambda i: ("en", None)[i % 3 == 0], 2)
    assert run(spark, rows, merkle.LEVELS) == plain_manifest(rows)


def test_long_text_and_lone_leaf(spark):
    rows = [(3, None, None, None, "Abc " * 500_000, "", "", "")]
    got = run(spark, rows, merkle.LEVELS)
    assert got == plain_manifest(rows)
    assert got[0][4] == sha("") and got[0][1] == got[0][2] == got[0][3]


def test_empty_table(spark):
    assert run(spark, [], 1) == []


def test_versions_share_what_is_untouched():
    leaves = [sha(str(i)) for i in range(70)]
    tree = merkle.Versions(leaves, 3)
    before = len(tree.digests)
    other = tree.changed(tree.base, 9, "x")
    assert len(tree.digests) == before + 1 + 3  # the leaf and its three ancestors
    assert tree.digests[tree.base] == plain_tree(leaves)[-1][0]
    assert tree.digests[other] == plain_tree([*leaves[:9], "x", *leaves[10:]])[-1][0]
    assert sum(a == b for a, b in zip(tree.children[tree.base], tree.children[other])) == 1
    # A version of a version keeps both changes; going back gives the first digest again.
    third = tree.changed(other, 69, "y")
    assert tree.digests[third] == plain_tree([*leaves[:9], "x", *leaves[10:69], "y"])[-1][0]
    assert tree.digests[tree.changed(tree.changed(third, 9, leaves[9]), 69, leaves[69])] == tree.digests[tree.base]
    assert merkle.fold("x", tree.siblings(tree.base, 9)) == tree.digests[other]


def test_levels_over():
    assert [merkle.levels_over(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
