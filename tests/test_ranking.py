import random

import numpy as np
import pyarrow as pa
import pytest

from panelweave.operators import ranking as rk
from panelweave.operators import search as se


def _frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def _best(scores, k):
    """(query, rank, document) by brute force."""
    found = {}
    for q, d, score in scores:
        found.setdefault(q, []).append((-round(score, 9), d))
    return {(q, i, x[1]) for q, rows in found.items() for i, x in enumerate(sorted(rows)[:k], 1)}


def test_only_the_best_of_each_task_are_shuffled(spark):
    """Long queries that share words with every document make no row per pair: nothing is joined after the tasks."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs, queries = [(i, " ".join(rng.choices(words, k=30))) for i in range(500)], [(q, " ".join(rng.choices(words, k=15))) for q in range(20)]
    d, q = _frames(spark, docs, queries)
    best = se.bm25_topk(d, q, 3)
    execution = best._jdf.queryExecution()
    assert "Join" not in execution.optimizedPlan().toString()
    files = best.inputFiles()
    assert 60 <= spark.read.parquet(*files).count() <= 60 * len(files)
    scores = [tuple(r) for r in se.bm25_scores(d, q).select("query_id", "doc_id", "score").collect()]
    assert len(scores) > 9000 and {(r.query_id, r["rank"], r.doc_id) for r in best.collect()} == _best(scores, 3)


@pytest.mark.parametrize("cells, products, waiting, look_up", [(1, 1, 1, 8), (200, 300, 10, 0), (10**6, 10**6, 10**6, 10**6), (60, 10**6, 40, 1e-9)])
def test_best_equals_brute_force(monkeypatch, cells, products, waiting, look_up):
    """However the work is cut and whichever words are weak, with copies, negative and zero weights."""
    for name, x in (("CELLS", cells), ("PRODUCTS", products), ("WAITING", waiting), ("LOOK_UP", look_up)):
        monkeypatch.setattr(rk, name, x)
    rng = np.random.default_rng(5)
    weight = {(q, t): float(w) for q in range(12) for t in rng.choice(30, 8, replace=False) for w in [rng.choice([0.0, -0.4, 0.3, 5.0, rng.random() * 4])]}
    pairs = pa.table({"query_id": [100 + q for q, _ in weight], "term": [f"t{t:02}" for _, t in weight], "w": list(weight.values())})
    rows = [{int(t): float(rng.random() * 2.4) for t in rng.choice(30, rng.integers(0, 9), replace=False)} for _ in range(150)]
    rows += rows[:60] + [{3: 1.0, 4: 2.0}] * 30
    ids = rng.permutation(len(rows))
    block = rk.Block(pairs, 2.5)
    number = {t: i for i, t in enumerate(block.terms.to_pylist())}
    best = rk.Best(block, 4)
    for a in range(0, len(rows), 50):
        part = [(i, number[f"t{t:02}"], s) for i, row in enumerate(rows[a : a + 50]) for t, s in sorted(row.items()) if f"t{t:02}" in number]
        doc, term, sat = (np.array([x[j] for x in part], kind) for j, kind in enumerate((np.int64, np.int64, float)))
        best.add(pa.array(ids[a : a + 50]), doc, term, sat)
    got = {}
    for r in pa.Table.from_batches(list(best.rows())).to_pylist():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["doc_id"]))
    want = {}
    for q in range(12):
        for i, row in enumerate(rows):
            if any((q, t) in weight for t in row):
                want.setdefault(100 + q, []).append((-round(sum(weight.get((q, t), 0.0) * s for t, s in sorted(row.items())), 9), int(ids[i])))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:4] for q, x in want.items()}


def test_blocks_of_queries_repeated_and_missing_ids(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 9))) for i in range(80)] + [(200, None), (201, "")]
    queries = [(q, text(5)) for q in range(15)] + [(None, "w1 w2"), (20, "absent"), (21, "")]
    for more in ([], [(7, text(4)), (7, text(6)), (9, docs[9][1]), (None, "w1 w2")]):
        d, q = _frames(spark, docs + more, queries)
        want = _best([tuple(r) for r in se.bm25_scores(d, q).filter("doc_id is not null").select("query_id", "doc_id", "score").collect()], 3)
        for size in (500_000, 20):
            monkeypatch.setattr(rk, "BLOCK_WORDS", size)
            assert {(r.query_id, r["rank"], r.doc_id) for r in se.bm25_topk(d, q, 3).collect()} == want
    nothing = se.bm25_topk(d, q.filter("query_id = 20"), 3)
    assert nothing.columns == ["query_id", "doc_id", "score", "rank"] and not nothing.count()
