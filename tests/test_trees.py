"""Trees from parent links: shapes against plain walks, hashes against plain comparison."""

import random

from panelweave.operators import trees
from panelweave.operators import usage as us

NODES = "spec_id long, node_id long, parent_id long, position int, op string, value double"


def plain_walk(rows):
    """(spec, node) -> (depth, state) by going up link by link."""
    parent = {}
    for s, n, p, *_ in rows:
        old = parent.get((s, n), 0)
        parent[s, n] = p if (s, n) not in parent else (old if p is None else p if old is None else min(old, p))
    out = {}
    for s, n in parent:
        at, depth, seen = n, 1, {n}
        while True:
            up = parent[s, at]
            if up is None:
                out[s, n] = (depth, "rooted")
            elif (s, up) not in parent:
                out[s, n] = (depth, "orphaned")
            elif up in seen:
                out[s, n] = (None, "cyclic")
            else:
                at, depth = up, depth + 1
                seen.add(up)
                continue
            break
    return out


def test_walk_is_the_plain_one(spark):
    rng = random.Random(5)
    rows = []
    for s in range(40):
        m = rng.choice([1, 2, 5, 9, 40, 130])
        for n in range(1, m + 1):
            how = rng.random()
            parent = None if n == 1 else n - 1 if s % 3 else rng.randrange(1, n)
            if how < 0.03:
                parent = rng.choice([None, 999, m, n])
            rows.append((s, n, parent, 0, "x", 1.0))
    rows += [(100, 1, 1, 0, "x", 1.0), (101, 1, 2, 0, "x", 1.0), (101, 2, 1, 0, "x", 1.0), (102, 1, None, 0, "x", 1.0), (102, 1, None, 0, "x", 1.0)]
    got = {(r.spec_id, r.node_id): (r.depth, r.state) for r in trees.walked(spark.createDataFrame(rows, NODES)).collect()}
    want = plain_walk(rows)
    assert got == want and {v[1] for v in want.values()} == {"rooted", "orphaned", "cyclic"} and max(v[0] or 0 for v in want.values()) > 60


def test_walk_in_rows_and_over_tasks(spark, monkeypatch):
    """Small specs take a fixed number of jobs, whatever their depth; both ways give the same rows."""
    rng = random.Random(8)
    rows = [(s, n, rng.choice([None, n - 1, n // 2, n + 1, 77]) if n > 1 else None, 0, "x", 1.0) for s in range(30) for n in range(1, rng.choice([2, 7, 30]))]
    rows += [(50, n, n - 1 or None, 0, "x", 1.0) for n in range(1, 60)] + [(51, 1, None, 0, "x", 1.0)] * 2
    table = spark.createDataFrame(rows, NODES)
    columns = ["spec_id", "node_id", "parent_id", "copies", "children", "depth", "state"]
    landed = []
    monkeypatch.setattr(trees, "land", lambda df, name, land=trees.land: landed.append(name) or land(df, name))
    found = []
    for limit in (256, 0, 10):  # all in rows, none, some of both
        monkeypatch.setattr(trees, "ROW_NODES", limit)
        landed.clear()
        found.append(sorted(trees.walked(table).select(columns).collect(), key=lambda r: (r.spec_id, r.node_id)))
        assert limit < 256 or landed == ["links", "large"]
    assert found[0] == found[1] == found[2] and max(r.depth or 0 for r in found[0]) == 59


def test_equal_trees_have_equal_hashes(spark):
    def nested(rng, depth):
        return (rng.choice("ab"), rng.choice([None, 1.0]), [nested(rng, depth - 1) for _ in range(rng.randrange(3) if depth else 0)])

    def table(spec, tree, rng, out):
        ids = rng.sample(range(1000), 200)

        def put(node, parent, position):
            me = ids.pop()
            out.append((spec, me, parent, position, node[0], node[1]))
            for i, kid in enumerate(node[2]):
                put(kid, me, 2 * i + 5)

        put(tree, None, 0)

    rng = random.Random(9)
    kinds = [nested(rng, d) for d in (0, 1, 1, 2, 3, 4, 5, 5)]
    a, b, want = [], [], {}
    for s in range(60):
        x, y = rng.choice(kinds), rng.choice(kinds)
        table(s, x, rng, a)
        table(s, y, rng, b)
        want[s] = x == y
    rng.shuffle(a)
    # Only on one side; and no tree: two roots, a cycle, a node given twice.
    a += [(70, 1, None, 0, "a", None), (71, 1, None, 0, "a", None), (71, 2, None, 1, "b", None), (72, 1, 1, 0, "a", None), (73, 1, None, 0, "a", None), (73, 1, None, 0, "a", None)]
    b += a[-5:]
    want |= {70: False, 71: False, 72: False, 73: False}
    got = {r.spec_id: r.same for r in trees.same_trees(spark.createDataFrame(a, NODES), spark.createDataFrame(b, NODES), ["op", "value"]).collect()}
    assert got == want and sum(want.values()) > 5


def test_failures_are_broken_down(spark):
    rows = [("a", "model", "missed:x,y"), ("a", "model", "missed:z"), ("b", "model", "tree_differs"), ("c", "field", "missed:x")]
    got = us.failure_breakdown(spark.createDataFrame(rows, "case_id string, kind string, detail string")).collect()
    assert sorted(tuple(r) for r in got) == [("field", "missed", 1, 1), ("model", "missed", 2, 1), ("model", "tree_differs", 1, 1)]


def test_no_trees_at_all(spark):
    none = spark.createDataFrame([], NODES)
    assert trees.same_trees(none, none, ["op"]).collect() == [] and trees.walked(none).collect() == []
