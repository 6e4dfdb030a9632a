"""Best paths against all cuts of short strings, and whole texts."""

import itertools
import math
import random

from panelweave.operators import search, segment as sg


def by_brute_force(run, words):
    """The first of the best of all cuts, longest first word first."""
    total = sum(words.values())
    weight = lambda w: round((math.log(words[w]) - math.log(total)) * sg.UNIT) if w in words else round(-math.log(total) * sg.UNIT) if len(w) == 1 else None
    best = None
    for marks in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
        cut = [run[a:b] for a, b in zip(at, at[1:])]
        ws = [weight(w) for w in cut]
        if None not in ws:
            best = max(best or (-math.inf, []), (sum(ws), [len(w) for w in cut]))
    out, i = [], 0
    for n in best[1]:
        out.append(run[i : i + n])
        i += n
    return out


def test_best_of_all_cuts(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))): rng.choice([1, 1, 2, 4]) for _ in range(14)} | {"c": 3, "ca": 1}
    runs = sorted({"".join(rng.choice("aaabbc") for _ in range(rng.randint(1, 10))) for _ in range(150)})
    table = spark.createDataFrame([*words.items(), ("", 5), (None, 5)], "word string, n int")
    got = sg.segment(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), table, letters="a-c")
    assert {r.doc_id: r.tokens for r in got.collect()} == {i: by_brute_force(r, words) for i, r in enumerate(runs)}


def test_ties_take_the_longest_first_word():
    assert sg.best_path("abc", [1, 3, 1, 2], [2, 1, 1, 2], [-5, -5, -5, -5], -9) == ["ab", "c"]
    assert sg.best_path("x", [], [], [], -1) == ["x"]


def test_texts_with_other_letters(spark):
    names = spark.createDataFrame([("净利润",), ("营业收入",), ("净利润（TTM）",), ("营业",), (None,), ("",)], "name string")
    words = sg.word_list(names)
    assert {(r.word, r.n) for r in words.collect()} == {("净利润", 2), ("营业收入", 1), ("营业", 1)}
    rows = [(1, "S_DQ净利润2024年营业收入ABC"), (2, None), (3, ""), (4, "!!"), (5, "利"), (6, "完全陌生"), (7, "x" * 3 + "净利润" * 4000)]
    got = {r.doc_id: r.tokens for r in sg.segment(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()}
    assert got[1] == ["s", "dq", "净利润", "2024", "年", "营业收入", "abc"]
    assert got[2] == got[3] == got[4] == [] and got[5] == ["利"] and got[6] == ["完", "全", "陌", "生"]
    assert got[7] == ["xxx"] + ["净利润"] * 4000
    nothing = {r.doc_id: r.tokens for r in sg.segment(spark.createDataFrame(rows[:2], "doc_id long, text string"), words.limit(0)).collect()}
    assert nothing == {1: ["s", "dq", "净", "利", "润", "2024", "年", "营", "业", "收", "入", "abc"], 2: []}


def test_ranking_by_words(spark):
    """Pairs of letters that cross words match nothing once words are known."""
    docs = spark.createDataFrame([(1, "净利润增长"), (2, "利润净增长"), (3, "营业收入"), (4, "现金")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "净利润")], "query_id long, text string")
    words = spark.createDataFrame([("净利润", 5), ("利润", 5), ("增长", 5), ("营业收入", 5)], "word string, n long")
    assert {r.doc_id for r in search.bm25_topk(docs, asked, 4).collect()} == {1, 2}
    assert {r.doc_id for r in search.bm25_topk(docs, asked, 4, words).collect()} == {1}
    assert {r.doc_id for r in search.bm25_scores(docs, asked, words).collect()} == {1}
