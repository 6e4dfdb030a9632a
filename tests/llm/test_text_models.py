"""Packing, near copies, repeated passages, toxicity, quality and the pipeline on small made tables."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import cotraining, links, near_dedup, packing, shingles, substring_dedup, toxicity
from panelweave.llm.common import running

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_running_sums(spark, block):
    df = spark.createDataFrame([([],), ([5],), (list(range(1, 40)),)], "x array<int>")
    got = [r[0] for r in df.select(running(F.col("x"), lambda v: v, block=block)).collect()]
    assert got == [[], [0], [sum(range(1, i)) for i in range(1, 40)]]


def test_pack_shard_keeps_all_and_never_overfills():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))), reverse=True)
        sizes, costs = [2, 4, 8], [2.5, 4.0, 9.0]
        where, size = packing.pack_shard(lengths, sizes, costs)
        used = Counter()
        for b, n in zip(where, lengths):
            used[b] += n
        for b, u in used.items():
            assert size[b] >= u and all(costs[sizes.index(s)] >= costs[sizes.index(size[b])] for s in sizes if s >= u)


def best_fit(lengths, size):
    """Plain best fit: the room left in each bin, and where each length goes."""
    room, where = [], []
    for n in lengths:
        fit = [b for b in range(len(room)) if room[b] >= n]
        b = min(fit, key=lambda k: room[k]) if fit else len(room)
        if not fit:
            room.append(size)
        room[b] -= n
        where.append(b)
    return sorted(room)


def test_one_size_is_plain_best_fit():
    rng = random.Random(9)
    lengths = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    where, size, _ = packing.pack_once(lengths, [64], [1.0], 64)
    left = Counter({b: 64 for b in range(len(size))})
    for b, n in zip(where, lengths):
        left[b] -= n
    assert sorted(left.values()) == best_fit(lengths, 64)


def test_pack_edges(spark):
    rng = random.Random(1)
    texts = [None, "", words(rng, 5), words(rng, 5), words(rng, 20_000), "a"] + [words(rng, rng.randrange(1, 600)) for _ in range(200)]
    got = packing.op1(table(spark, texts, [None, *range(1, 5), 4, *range(6, 206)])).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for t in texts)
    assert [r.bin for r in got if not r.n_tokens] == [None, None]
    used = defaultdict(list)
    for r in got:
        if r.bin:
            used[r.bin, r.capacity].append((r.offset, r.n_tokens))
    for (_, capacity), places in used.items():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= capacity
    assert packing.op1(table(spark, [])).collect() == []


def test_signatures_are_unbiased_and_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(10):
        base = rng.integers(0, 2**63, size=60).astype(np.uint64)
        a = rng.integers(0, 30, 60)
        b = np.where(rng.random(60) < 0.5, a, rng.integers(0, 30, 60))
        bags = [(base[w > 0], w[w > 0]) for w in (a, b)]
        s = near_dedup.bagminhash(bags, 1024)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert (near_dedup.bagminhash(bags[:1], 1024)[0] == s[0]).all()
    assert abs(np.mean(off)) < 0.02


def plain_classes(texts):
    bags = []
    for t in texts:
        w = (t or "").split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = words(rng, 1)
    return " ".join(w)


def near_texts():
    rng = random.Random(11)
    base = [words(rng, 120) for _ in range(12)]
    texts = [None, "", " ", "two words", "two words", "again " * 60, "again " * 61, "again " * 200]
    for b in base:
        texts += [b, b] + [edited(rng, b, rng.randrange(1, 5)) for _ in range(12)]
    return texts


def test_near_copies_equal_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in near_dedup.op9(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_classes(texts)
    assert near_dedup.op9(table(spark, [])).collect() == []


def test_keep_one_of_each_class(spark):
    texts = near_texts()
    docs = table(spark, texts, [None, 1, *range(1, len(texts) - 1)])  # ids that are missing or repeated
    got = near_dedup.keep_one(docs)
    want = plain_classes(texts)
    assert got.columns == docs.columns and got.count() == len(set(want))


def test_groups_without_rounds_compare_every_outsider(spark, monkeypatch):
    monkeypatch.setattr(links, "ROUNDS", 0)
    monkeypatch.setattr(links, "BLOCK", 2)
    values = [0, 1, 2, 10, 11, 30, 31, 32, 50]
    members = spark.createDataFrame([(7, i) for i in range(9)], "bucket long, node long")
    bodies = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "node long, body string")
    # Ten features from the value on: only neighbouring values share enough.
    got = links.groups(members, bodies, lambda: lambda v: np.arange(int(v), int(v) + 10, dtype=np.uint64), 0.8)
    assert {(r.node, r.comp) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5)}


def test_overlaps_of_blocks(monkeypatch):
    monkeypatch.setattr(links, "COLUMNS", 3)
    rng = np.random.default_rng(0)
    sides = [[np.unique(rng.integers(0, 30, rng.integers(0, 20))).astype(np.uint64) for _ in range(n)] for n in (7, 5)]
    assert links.overlaps(*sides).tolist() == [[len(set(a) & set(b)) for b in sides[1]] for a in sides[0]]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2)], "a long, b long")
    assert {(r.comp, r["count"]) for r in links.components(chain).groupBy("comp").count().collect()} == {(100, 41), (1, 2)}


def test_python_gets_texts_by_small_batches(spark):
    rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    before = spark.conf.get(links.BATCH)
    try:
        spark.conf.set(links.BATCH, "10000")
        counted = docs.mapInArrow(rows, "n long")
        assert max(r.n for r in links.landed(counted, "rows", 100).collect()) == 100
        assert spark.conf.get(links.BATCH) == "10000"
        # Scores are made when the caller reads them.
        toxicity.score(docs, toxicity.Model({"=some": 0}, np.ones(1), np.ones(1), 0.0))
        assert max(r.n for r in counted.collect()) == links.TEXTS
    finally:
        spark.conf.set(links.BATCH, before)


def test_components_of_a_dense_group_and_long_ways(spark):
    rng = random.Random(7)
    pairs = [(i, j) for i in range(30) for j in range(i)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    least = {v: v for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    got = {r.node: r.comp for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: c for v, c in least.items() if any(a != b and v in (a, b) for a, b in pairs)}


def test_old_links_are_not_followed_again(spark, monkeypatch):
    monkeypatch.setattr(links, "ROUNDS", 1)
    monkeypatch.setattr(links, "BLOCK", 2)
    followed, real = [], links.components
    monkeypatch.setattr(links, "components", lambda edges: followed.append(edges.filter("a <> b").distinct().count()) or real(edges))
    values = [*range(0, 60, 2), *range(1, 60, 2), 200]
    members = spark.createDataFrame([(b, i) for b in (7, 8) for i in range(len(values))], "bucket long, node long")
    bodies = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "node long, body string")
    got = links.groups(members, bodies, lambda: lambda v: np.arange(int(v), int(v) + 10, dtype=np.uint64), 0.8)
    assert {(r.node, r.comp) for r in got.collect()} == {(i, 0) for i in range(60)}
    # 59 links join all; those of the first round come again in no later one.
    assert len(followed) == 2 and sum(followed) == 59


def test_a_task_links_two_groups_once():
    kind = pa.list_(pa.struct([("out", pa.bool_()), ("node", pa.int64()), ("comp", pa.int64()), ("body", pa.string())]))
    cell = [{"out": i < 3, "node": i, "comp": i, "body": "x"} for i in range(6)]
    run = links._blocks_alike(lambda: lambda v: np.arange(10, dtype=np.uint64), 0.8)
    cells = pa.RecordBatch.from_arrays([pa.array([cell, cell, cell], kind)], names=["items"])
    assert sum(b.num_rows for b in run(iter([cells, cells]))) == 5


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(3)
    passage, inner, clean = words(rng, 60), words(rng, 60), [words(rng, 80) for _ in range(5)]
    near = edited(rng, passage, 1)
    texts = [
        f"{clean[0]}\n{passage}\nend", f"start\n{passage}", f"{clean[1]}\n{near}\nshort line", f"{words(rng, 40)} {inner} {words(rng, 40)}",
        clean[2], None, "", "short line", clean[3], f"{clean[4]}\n\n  spaced   words  ", f"{words(rng, 30)} {inner} {words(rng, 30)}",
    ]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    same = (0, 4, 5, 6, 7, 8, 9)
    assert [got[i].text for i in same] == [texts[i] for i in same]
    assert got[1].text == "start\n" and got[2].text == f"{clean[1]}\n\nshort line" and (got[1].words_removed, got[2].words_removed) == (60, 60)
    kept, cut = sorted((got[3], got[10]), key=lambda r: r.words_removed)
    assert kept.text == texts[kept.doc_id] and 16 <= cut.words_removed <= 60
    assert set(texts[cut.doc_id].split()) - set(cut.text.split()) <= set(inner.split())
    assert got[0].score == "x" and substring_dedup.dedup(table(spark, [])).collect() == []


def test_repeated_rows_lose_all_but_one(spark):
    text = words(random.Random(5), 50)
    got = sorted(r.text for r in substring_dedup.dedup(table(spark, [text] * 3 + ["other"], [None, None, 4, 4])).collect())
    assert got == sorted(["", "", "other", text])


def test_segments_of_a_passage_are_the_same_anywhere():
    rng = np.random.default_rng(0)
    inner = rng.integers(0, 2**63, 300).astype(np.uint64)
    for n in (1, 7, 30):
        outer = np.concatenate((rng.integers(0, 2**63, n).astype(np.uint64), inner))
        a = set(substring_dedup.segment_starts(inner, np.array([0])))
        b = {s - n for s in substring_dedup.segment_starts(outer, np.array([0]))}
        assert {x for x in a if x > 60} == {x for x in b if x > 60}


def test_shingles_of_flat_paragraphs():
    w = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    start = np.array([0, 9, 20])
    flat, at = substring_dedup.flat_shingles(w, start)
    for part, want in zip(np.split(flat, at[1:]), np.split(w, start[1:])):
        assert (part == shingles.shingles(want)).all()


def test_nnpu_ranks_positives_first():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.0, 1, (400, 5)), rng.normal(-0.5, 1, (3000, 5))
    hidden = rng.normal(1.0, 1, (300, 5))
    x = np.concatenate((pos, hidden, neg)).astype(np.float32)
    w, b = toxicity.fit_nnpu(x, np.arange(len(x)) < 400, 300 / 3300)
    z = x[400:] @ w + b
    rank = z.argsort().argsort() + 1
    assert (rank[:300].sum() - 300 * 301 / 2) / (300 * 3000) > 0.95


def toxic_tables(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        texts.append(words(rng, 30) + (" vile rotten scoundrel" if bad else "") + " " + words(rng, 30))
        if i % 7 < 4:
            labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None)]
    return table(spark, texts + [None, ""], [*range(600), None, 601]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_sums_leave_a_task_before_they_pile_up(monkeypatch):
    monkeypatch.setattr(toxicity, "SUMS_HELD", 500)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(60)] + ["", None]
    sides = [i % 3 == 0 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(sides)], names=["text", "positive"])
    most = max(len(toxicity.text_values(t)) for t in texts)
    got, want = defaultdict(float), defaultdict(float)
    for part in toxicity._sums(iter([batch])):
        assert part.num_rows < 500 + most
        for r in part.to_pylist():
            got[r["feature"], r["positive"]] += r["s"] + 2 * r["ss"]
    for t, side in zip(texts, sides, strict=True):
        for f, x in toxicity.text_values(t).items():
            want[f, side] += x + 2 * x * x
    assert got == pytest.approx(want)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.op8(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all((r.predicted == 1) == (r.doc_id % 6 == 0) for r in held) and len(held) > 50


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert {r.score for r in toxicity.op8(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.op8(docs.limit(0), labels).collect() == []


def test_quality_by_two_views(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = "### $$$ ".join(words(rng, 20).split()) if bad else words(rng, 60)
        rows.append((i, text, "en", "junk" if bad and i % 2 else f"s{i % 4}", len(text), "x"))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    rows.append((400, None, None, None, None, "x"))
    docs, pages = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0, "https://a.example.com/en/5?x=1", ""), (1, None, None)], "page_id long, url string, html string")
    got = cotraining.op10(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), pages).collect()
    assert len(got) == 401
    assert all((r.predicted == 1) == (r.doc_id % 5 != 0) for r in got if r.held_out and r.doc_id < 400)
    assert cotraining.op10(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), pages).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_pipeline_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = links.landed(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert out.columns == docs.columns and (out.count() <= before if name in ("toxicity", "near_dedup") else out.count() == docs.count())
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
