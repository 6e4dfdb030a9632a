"""Repeated passages against brute force: wrapped, in the middle of paragraphs, and chains of common pieces."""

import glob
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelweave.llm import links, near_dedup, shingles, substring_dedup, wordtable
from tests.llm.test_text_models import edited, table, words

RUN, PARAGRAPH = substring_dedup.MIN_RUN, substring_dedup.MIN_WORDS


def plain_passages(texts):
    """Remaining words of each text, in order: similar lines, copies of whole texts, and all runs of RUN words that stood before."""
    flat = [(t or "").split() for t in texts]
    lines = []
    for d, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) >= PARAGRAPH:
                lines.append((d, at, w, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(w)
    gone, alike = [set() for _ in texts], [set() for _ in texts]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][3], lines[j][3]
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    for i, (d, at, w, _) in enumerate(lines):
        if group[i] != i:
            gone[d] |= set(range(at, at + len(w)))
            if w != lines[group[i]][2]:
                alike[d] |= set(range(at, at + len(w)))
    seen, places = set(), {}
    for d, w in enumerate(flat):
        if len(w) >= RUN and tuple(w) in seen:
            gone[d] |= set(range(len(w)))
            continue
        seen.add(tuple(w))
        for p in range(len(w) - RUN + 1):
            earlier = places.setdefault(tuple(w[p : p + RUN]), [])
            for e, q in earlier:
                if e != d or p - q >= RUN:
                    gone[d] |= {p + k for k in range(RUN) if q + k not in alike[e]}
            earlier.append((d, p))
    return [[x for k, x in enumerate(w) if k not in g] for w, g in zip(flat, gone)]


def remaining(spark, texts):
    return [(r.text or "").split() for r in substring_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()]


def wrapped(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_passages_in_short_lines_go(spark):
    rng = random.Random(21)
    passage, verse = words(rng, 60), words(rng, 66)
    texts = [wrapped(passage, 20), f"{words(rng, 9)}\n{wrapped(passage, 20)}\n{words(rng, 9)}", f"{words(rng, 40)} {passage} tail", wrapped(verse, 6), f"head\n{wrapped(verse, 11)}\n"]
    got = substring_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.words_removed for r in got] == [0, 60, 60, 0, 66]
    assert got[1].text.split() == texts[1].split()[:9] + texts[1].split()[-9:] and got[1].text.count("\n") == texts[1].count("\n")
    assert got[4].text.split() == ["head"]


def test_passages_inside_paragraphs_go_whole(spark):
    rng = random.Random(22)
    inner = [words(rng, rng.choice((50, 51, 55, 60))) for _ in range(150)]
    texts = [f"{words(rng, 40)} {p} {words(rng, 40)}" for p in inner * 2]
    got = substring_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.words_removed for r in got] == [0] * 150 + [len(p.split()) for p in inner]


def test_chains_of_common_pieces_stay(spark):
    rng = random.Random(23)
    chains = [[words(rng, 7) for _ in range(12)] for _ in range(12)]
    # Any two neighbouring pieces stood together before, in one place or another; three never did.
    texts = [f"{words(rng, 30)} {a} {b} {words(rng, 30)}" for c in chains for a, b in zip(c, c[1:])] + [f"{words(rng, 30)} {' '.join(c)} {words(rng, 30)}" for c in chains]
    assert {r.words_removed for r in substring_dedup.dedup(table(spark, texts)).collect()} == {0}


def test_passages_equal_brute_force(spark):
    rng = random.Random(24)
    pieces = [words(rng, n) for n in (5, 9, 15, 16, 17, 24, 25, 31, 52, 70) for _ in range(4)]
    texts = ["again " * 200, "again " * 70, None, "", "a b c " * 40, "x a b c " + "a b c " * 30]
    for _ in range(110):
        part = [wrapped(p, rng.choice((7, 20))) if rng.random() < 0.3 else edited(rng, p, 1) if rng.random() < 0.15 else p for p in rng.choices(pieces, k=rng.randrange(1, 6))]
        texts.append("".join(f"{x}{rng.choice((' ', chr(10)))}" for p in part for x in (words(rng, rng.choice((0, 3, 30))), p)))
    texts += texts[20:26]
    assert remaining(spark, texts) == plain_passages(texts)


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(25)
    passage = [words(rng, 60) for _ in range(10)]
    texts = [f"{words(rng, rng.randrange(1, 300))}\n{p}" for p in passage for _ in range(6)]
    path, size = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    table(spark, texts).repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)

    def later(f):
        def run(*a):
            out = f(*a)
            spark.conf.set(size, "2k")  # files are split otherwise from here on
            return out

        return run

    monkeypatch.setattr(substring_dedup, "repeated", later(substring_dedup.repeated))
    monkeypatch.setattr(near_dedup, "classes", later(near_dedup.classes))
    try:
        got = " ".join(r.text for r in substring_dedup.dedup(docs).collect())
        assert [got.count(p) for p in passage] == [1] * 10
        spark.conf.unset(size)
        near = spark.read.parquet(path).withColumn("text", F.element_at(F.split("text", "\n"), 2))
        assert sorted(r.text for r in near_dedup.keep_one(near).collect()) == sorted(passage)
    finally:
        spark.conf.unset(size)


def test_words_of_many_texts_at_once_are_those_of_each():
    """Line numbers, digests and bodies do not depend on what else is in the batch."""
    rng = random.Random(8)
    texts = [None, "", " \n", words(rng, 30), words(rng, 30) + "\n\x0b" + words(rng, 26) + "\r é", words(rng, 24), "A a\n\n" + words(rng, 40)]
    texts.append(texts[3])
    w, line, row, at, distinct = substring_dedup.hashed_words(pa.array(texts))
    assert [[distinct[a].decode() for a, r in zip(at, row) if r == i] for i in range(len(texts))] == [(t or "").split() for t in texts]
    assert {r: len({x for x, q in zip(line, row) if q == r}) for r in set(row)} == {i: sum(bool(x.split()) for x in (t or "").split("\n")) for i, t in enumerate(texts) if (t or "").split()}
    parts = [substring_dedup._parts(iter([pa.RecordBatch.from_arrays([pa.array(r), pa.array(t, pa.string())], names=["row", "text"])])) for r, t in [([*range(len(texts))], texts), *([[i], [t]] for i, t in enumerate(texts))]]
    whole, *single = [[x for b in p for x in b.to_pylist()] for p in parts]
    assert whole == [x for s in single for x in s] and [len(x["paragraphs"]) for x in whole] == [1, 2, 0, 1, 1]
    assert (whole[0]["d1"], whole[0]["d2"]) == (whole[-1]["d1"], whole[-1]["d2"]) and len({(x["d1"], x["d2"]) for x in whole}) == 4


def test_word_hashes_go_by_bytes_and_size():
    """Alone or among others, up to and beyond LONG_WORD bytes; zero bytes count."""
    kinds = ["a", "a\0", "\0a", "\0", "\0\0", "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "b" * 8 + "a" * 8, "é" * 9]
    kinds += ["x" * n for n in (wordtable.LONG_WORD - 1, wordtable.LONG_WORD, wordtable.LONG_WORD + 1)] + ["x" * 400 + "y", "x" * 400 + "z"]
    whole, line, row = substring_dedup.word_hashes(pa.array([" ".join(kinds), None, "", "\n".join(reversed(kinds))]))
    assert len(set(whole.tolist())) == len(kinds) and whole[len(kinds) :].tolist() == whole[: len(kinds)][::-1].tolist()
    assert whole[: len(kinds)].tolist() == [int(substring_dedup.word_hashes(pa.array([k]))[0][0]) for k in kinds]
    assert row.tolist() == [0] * len(kinds) + [3] * len(kinds) and len(set(line.tolist())) == 1 + len(kinds)


def test_bodies_are_the_paragraph_shingles():
    rng = random.Random(9)
    texts = [words(rng, 40), words(rng, 10) + "\n" + words(rng, 30) + "\n" + words(rng, 25), None]
    bits = type("Bits", (), {"value": b"\xff" * 8192})
    got = [r["body"] for b in substring_dedup._bodies({"bits": bits})(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])) for r in b.to_pylist()]
    lines = [t for text in texts for t in (text or "").split("\n") if len(t.split()) >= PARAGRAPH]
    want = [np.unique(shingles.shingles(substring_dedup.word_hashes(pa.array([t]))[0])) for t in lines]
    assert len(got) == 3 and all((substring_dedup._sets()(g) == w).all() for g, w in zip(got, want, strict=True))


def test_only_sets_of_near_sizes_are_compared():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 60, 40), rng.integers(1, 60, 3)
    assert links._sized(a, b, 0.8).tolist() == [any(min(x, y) / max(x, y) >= 0.8 - 1e-9 for y in b) for x in a]


def test_what_was_shuffled_goes_once_it_is_written(spark):
    before = spark.conf.get(links.CLEAN_UP, None)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    there = files()
    landed = links.landed(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "x")
    assert not files() - there
    assert landed.count() == 7 and spark.conf.get(links.CLEAN_UP, None) == before


def test_words_of_runs_join_over_blocks(spark):
    rng = random.Random(5)
    runs = [(row, at, rng.choice([0, 0, rng.randrange(2**RUN)])) for row in range(4) for at in rng.sample(range(400), 25 + 20 * row)] + [(9, 63, 0), (9, 64, 0), (9, 112, 2**RUN - 1), (10, 64, 0)]
    want = {(row, at + k) for row, at, kept in runs for k in range(RUN) if not kept >> k & 1}
    cut = spark.createDataFrame(runs, "row long, at int, kept long").mapInArrow(lambda batches: batches, "row long, at int, kept long")
    joined = substring_dedup.joined_runs(cut)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the runs are made once
    got = joined.collect()
    assert {(r.row, w) for r in got for w in range(r.start, r.end)} == want
    assert all(r.start < r.end for r in got) and [(r.start, r.end) for r in got if r.row == 10] == [(64, 64 + RUN)]
