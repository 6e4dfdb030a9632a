"""Phrase mining against counting everything, and the automata it is made of."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import phrases
from panelweave.llm.transducers import Transducer, build, of_sorted, union

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `rank` string, phrase string, h string"


def plain(rows, least, most, top):
    """By counting all runs of every length and trying every cut and every longer phrase."""
    count, total = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        c = count.setdefault(lang or ("und" if lang is None else lang), Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(ws)
            for k in range(1, most + 1):
                c.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in count.items():
        cands = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cands.items():
            inside = any(len(q) > len(g) and 100 * b >= 100 * a and any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1)) for q, b in cands.items())
            if not inside:
                s, k = min((1000 * a * total[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]], total[lang], s))
        for rank, (_, _, phrase, *rest) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), *rest))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    common = ["the", "OF", "Ünï", "a\x1fb", "…", "x y", "|", "ab"]
    fixed = ["New York City", "alpha beta gamma delta epsilon", "to be, or not to be", "the the the the the the"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randrange(40))]
        rows.append((rng.choice([" ", "  ", "\t", ". ", "\n"]).join(parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \n ", "de")] + rows[:3]


def run(spark, rows, least, most=5, top=2000, parts=3):
    docs = spark.createDataFrame([(i, t, x, "s", 1, "r", "p", "h") for i, (t, x) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in phrases.mine(docs.repartition(parts), least=least, most_words=most, top=top).collect())


def test_phrases_are_those_of_plain_counting(spark):
    rows = made(1, 150)
    want = plain(rows, 5, 5, 20)
    assert len(want) > 60
    assert run(spark, rows, 5, top=20) == want


def test_many_shards_small_memories_and_chunks(spark, monkeypatch):
    """Shards united in steps, tables flushed early, and texts read in small parts change nothing."""
    monkeypatch.setattr(phrases, "FAN", 2)
    monkeypatch.setattr(phrases, "CHUNK", 300)
    monkeypatch.setattr(phrases, "HELD", 40)
    rows = made(2, 120)
    assert run(spark, rows, 4, most=4, top=None, parts=7) == plain(rows, 4, 4, 10**9)


def test_word_symbols_that_clash_take_another_seed(spark, monkeypatch):
    whole = phrases._symbol
    monkeypatch.setattr(phrases, "_symbol", lambda word, seed: len(word) if seed == 0 else whole(word, seed))
    rows = made(3, 40)
    assert run(spark, rows, 5) == plain(rows, 5, 5, 2000)


def test_hot_prefix_and_long_text(spark):
    rows = [("hot line " * 150_000 + "end", "en"), ("hot line " * 3 + "x", "en")]
    got = run(spark, rows, 100)
    assert got == plain(rows, 100, 5, 2000) and any(r[2].startswith("hot line hot") for r in got)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two three", "en")]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows, 2) == []


def test_scores_pass_64_bits(spark):
    """The score's product is 1000 * a * n; at a = n = 2 ** 40 it needs 91 bits."""
    from pyspark.sql import functions as F

    d = lambda x: f"cast({x}L as decimal(19, 0))"
    big = 2**40 + 3
    got = spark.range(1).select(F.expr(f"(cast(1000 as decimal(4, 0)) * {d(big)} * {d(big)}) div ({d(big - 1)} * {d(97)})")).first()[0]
    assert got == 1000 * big * big // ((big - 1) * 97)


@pytest.mark.parametrize("seed", range(4))
def test_transducers_hold_and_add_counts(seed):
    rng = random.Random(seed)
    shards = [Counter(tuple(rng.randrange(5) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(60))) for _ in range(4)]
    for s in shards:
        t = build(sorted(s.items()))
        assert [*t.items()] == sorted(s.items()) and Transducer.of_row(t.row()) == t
        assert all(t.find(k) == n for k, n in s.items()) and t.find((9,)) == 0 == t.find((0, 0, 0, 0))
    length = seed + 1
    shards = [Counter(tuple(rng.randrange(5) for _ in range(length)) for _ in range(rng.randrange(1, 60))) for _ in range(4)]
    made = [of_sorted([np.array(c) for c in zip(*sorted(s))], np.array([s[k] for k in sorted(s)])) for s in shards]
    whole = Counter()
    for s, t in zip(shards, made):
        t = Transducer.of_row(t.row())
        assert [*t.items()] == sorted(s.items()) and all(t.find(k) == n for k, n in s.items()) and t.find((9,) * length) == 0
        whole.update(s)
    assert [*union(made, length).items()] == sorted(whole.items())
    assert [*union([*made, union(made, length)], length, 3).items()] == sorted((k, 2 * n) for k, n in whole.items() if 2 * n >= 3)


def test_transducers_share_ends():
    keys = [(a, b, c) for a in range(20) for b in range(20) for c in range(20)]
    t = build((k, i) for i, k in enumerate(keys))
    assert len(t.final) == 4 and len(t.label) == 60
    assert [n for _, n in t.items()] == [*range(8000)] and t.find((7, 3, 19)) == 7 * 400 + 3 * 20 + 19


def test_split_words():
    at, words, piece, row = phrases.split_words(pa.array(["A b", None, "b.c", "", "éA"]), phrases._KIND)
    assert [words[i].as_py() for i in at.tolist()] == [b"a", b"b", b"b", b"c", "éa".encode()]
    assert row.tolist() == [0, 0, 2, 2, 4] and np.diff(piece).astype(bool).tolist() == [False, True, True, True]


def test_rare_pairs_of_frequent_words_are_left_out_by_few_bytes(spark, monkeypatch):
    """Automata of pairs hold the frequent ones and hardly any other; what is counted before takes a few bytes a pair."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) + " a b c", "en") for _ in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    seen = []
    held = phrases._frequent
    monkeypatch.setattr(phrases, "_frequent", lambda shards, tasks, least: seen.append(shards.selectExpr("size", "size(counts) as n").groupBy("size").sum("n").collect()) or held(shards, tasks, least))
    got = phrases.mine(docs, least=90, top=None).collect()
    assert sorted(r.phrase for r in got) == ["a b c"] and 2 <= seen[0][0]["sum(n)"] < 20  # of some 25,000
    none = type("None", (), {"value": bytes(8192)})
    every = pa.RecordBatch.from_arrays([pa.array(["x y z y"] * 3), pa.array(["en"] * 3)], names=["text", "lang"])
    assert [*phrases._tallies(none, 0, 4, 2)(iter([every]))] == []
    full = type("Full", (), {"value": b"\xff" * 8192})
    made = pa.Table.from_batches(phrases._tallies(full, 0, 4, 2)(iter([every]))).to_pandas()
    assert made["rows"].sum() == 3 and len(phrases._enough(3)(made)) == 0 and len(phrases._enough(2)(made)) == 3
