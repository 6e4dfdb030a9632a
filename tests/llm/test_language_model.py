"""The log-bilinear model: counts and scores against plain ones, gradients, normalisation, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import language_model as lm

SCHEMA = "doc_id long, text string, lang string, score double, word string, row long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "w", 1) for i, t in rows], SCHEMA)


def ending(word):
    """The class of a word's last three bytes."""
    return (int.from_bytes(word.encode()[-3:], "big") * 2654435761 % 2**32) * lm.CLASSES >> 32


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(rows):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = [*words_of(t), None]
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    return c, out


def made(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["The", "a", "ÀÉ", "b.", "x" * 400, "…", "N\x1fM"] + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(vocab[min(int(rng.expovariate(0.15)), len(vocab) - 1)] for _ in range(rng.randrange(25)))) for k in range(n)]
    return rows + [(None, "the a nullid"), (3, None), (4, ""), (5, " \n\t"), (4, ""), (16, "unseen words only"), (None, None)]


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[:5]), r[5])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("head", [8, 200_000])
def test_base_scores_are_the_plain_ones(spark, monkeypatch, head):
    """With few words sent to tasks most come from the join; with many none does."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    rows = made()
    got = lm.op11(frame(spark, rows).repartition(3))
    same([tuple(r)[:6] for r in got.collect()], plain(rows)[1])
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_scores_are_sums_of_normalised_logs(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 14)
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    rows = made(2, 60)
    docs = frame(spark, rows)
    table, v = lm.count(docs.filter(~lm.fold("doc_id")))
    m = lm.Model.start(v.noise, 6, seed=3)
    c, _ = plain(rows)
    ranked = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w.encode()))
    token = {w: 1 + lm.CLASSES + i for i, w in enumerate(ranked[:4])} | {None: 0}
    kind = lambda w: 1 + ending(w)
    rest = Counter()
    for w in ranked[4:]:
        rest[kind(w)] += c[w] + 1
    want = []
    for i, t in rows:
        total, before = 0.0, (0, 0)
        for w in [*words_of(t), None]:
            k = token.get(w) if w in token else kind(w)
            s = (m.context[before[0]] * m.place[0] + m.context[before[1]] * m.place[1]).astype(float) @ m.target.T.astype(float) + m.bias
            total += (s[k] - np.log(np.exp(s).sum())) / np.log(10)
            total += 0 if w in token else math.log10((c[w] + 1) / (rest[k] + 1))
            before = (k, before[0])
        want.append((i, round(total, 3)))
    got = lm.score(docs, table, v, m).collect()
    assert np.allclose([x for _, x in sorted((str(r.doc_id), r.score) for r in got)], [x for _, x in sorted((str(i), x) for i, x in want)], atol=2e-3)


def test_all_probabilities_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    table, v = lm.count(frame(spark, made(5)).filter(~lm.fold("doc_id")))
    m = lm.Model.start(v.noise, 6, seed=9)
    n = len(v.noise)
    log_sum = lm.normalisers(spark, m)
    for one, two in ((0, 0), (3, n - 1), (n - 1, 2)):
        assert abs((10 ** lm.log10_probabilities(m, log_sum, np.full(n, one), np.full(n, two), np.arange(n))).sum() - 1) < 1e-5
    # Inside a class: the shares of its words and of what was never seen.
    inside = Counter({k: 1 / v.rest[k] for k in range(lm.CLASSES)})
    words = [r.word for r in table.collect()]
    for w, t, s in zip(words, *v.look_up(pa.array([w.encode() for w in words], pa.large_binary()))[::2]):
        if t <= lm.CLASSES:
            assert t == 1 + ending(w)
            inside[ending(w)] += 10**s
    assert all(abs(x - 1) < 1e-9 for x in inside.values())


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    noise = rng.random(9)
    noise /= noise.sum()
    m = lm.Model(*(p.astype(np.float64) + rng.standard_normal(p.shape) * 0.3 for p in lm.Model.start(noise, 4).parts()))
    one, two, token, drawn = (rng.integers(0, 9, k) for k in (12, 12, 12, 5))
    f = lambda: lm.nce_loss(m, np.log(noise), one, two, token, drawn)
    gradient = lm.nce_gradient(m, np.log(noise), one, two, token, drawn)
    for part, (rows, g) in zip(m.parts(), gradient):
        full = np.zeros_like(part)
        full[rows] = g
        for at in np.ndindex(*part.shape):
            keep = part[at]
            part[at] = keep + 1e-5
            up = f()
            part[at] = keep - 1e-5
            down = f()
            part[at] = keep
            assert abs((up - down) / 2e-5 - full[at]) < 1e-4


def test_contexts_stop_at_ends():
    token, one, two, owner = lm.with_ends(np.array([5, 6, 7, 8]), np.array([0, 0, 2, 2]), 4)
    assert token.tolist() == [5, 6, 0, 0, 7, 8, 0, 0]
    assert one.tolist() == [0, 5, 6, 0, 0, 7, 8, 0]
    assert two.tolist() == [0, 0, 5, 0, 0, 0, 7, 0]
    assert owner.tolist() == [0, 0, 0, 1, 2, 2, 2, 3]
    assert [len(x) for x in lm.with_ends(np.zeros(0, int), np.zeros(0, int), 0)] == [0, 0, 0, 0]


def test_held_out_texts_gain_from_context(spark):
    rng = random.Random(8)
    cycle = "one two three four five six seven eight".split()

    def text():
        k = rng.randrange(8)
        return " ".join(cycle[(k + i) % 8] if rng.random() < 0.9 else rng.choice(cycle) for i in range(60))

    got = lm.op11(frame(spark, [(i, text()) for i in range(1500)])).filter("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() > 0.7 * got.base_score.sum()


@pytest.mark.parametrize("rows", [[], [(None, None)], [(next(i for i in range(99) if held(i)), "only held out")]])
def test_nothing_to_learn_from(spark, rows):
    got = [tuple(r) for r in lm.op11(frame(spark, rows)).collect()]
    same([r[:6] for r in got], plain(rows)[1])
    assert all(r[4] or r[6] == 0 for r in got)


def test_long_text_and_hot_id(spark):
    rows = [(1, "long Text here " * 120_000)] + [(1, f"copy {k % 3}") for k in range(300)]
    same([tuple(r)[:6] for r in lm.op11(frame(spark, rows)).collect()], plain(rows)[1])
