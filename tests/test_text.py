import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.functions.text import tokens
from panelweave.operators import documents as dc
from panelweave.operators import fields as fl
from panelweave.operators import outbound as ob
from panelweave.operators import search as se
from panelweave.sources.registry import aliases, metrics


def test_tokens(spark):
    t = lambda s: spark.createDataFrame([(s,)], "t string").select(tokens(F.col("t"))).first()[0]
    assert t("S_DQ_Close, MA20 20ma") == ["s", "dq", "close", "ma", "20", "20ma"]
    assert t("净利润 roe") == ["净利", "利润", "roe"] and t("净") == ["净"] and t("") == []


def test_bm25_equals_a_plain_loop(spark):
    docs = {1: "close price close", 2: "open price", 3: "price volume of trades", 4: "unrelated words here"}
    queries = {10: "close price", 11: "volume volume", 12: "nothing"}
    words = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    want = {}
    for q, text in queries.items():
        for d, w in words.items():
            if set(w) & set(text.split()):
                want[(q, d)] = sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in text.split())
    mk = lambda d, name: spark.createDataFrame(list(d.items()), f"{name} int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in se.bm25_scores(mk(docs, "doc_id"), mk(queries, "query_id")).collect()}
    assert got == pytest.approx(want)
    assert [(r.query_id, r.doc_id) for r in se.bm25_topk(mk(docs, "doc_id"), mk(queries, "query_id"), 1).orderBy("query_id").collect()] == [(10, 1), (11, 3)]


def test_best_documents_without_pairs_from_stop_words(spark):
    import random

    rng = random.Random(6)
    rare = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["the"] * rng.randrange(1, 4) + ["of"] * rng.randrange(3) + rng.choices(rare, k=rng.randrange(1, 8)))) for i in range(400)]
    queries = [(q, " ".join(["the", "of", *rng.sample(rare, 2)])) for q in range(15)] + [(50, "the"), (51, "absent"), (52, "the the w1"), (53, "w2 w2 nothing")]
    mk = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    d, q = mk(docs, "doc_id"), mk(queries, "query_id")
    best = {}
    for r in se.bm25_scores(d, q).collect():
        best.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    want = {(k, i, x[1]) for k, rows in best.items() for i, x in enumerate(sorted(rows)[:3], 1)}
    assert {(r.query_id, r["rank"], r.doc_id) for r in se.bm25_topk(d, q, 3).collect()} == want
    kept = {(r.query_id, r.term) for r in se.essential_terms(*se._postings(d, q), 3).collect()}
    assert (50, "the") in kept and not any((k, w) in kept for k in range(15) for w in ("the", "of"))


def _broadcasts(df):
    """The parts of the physical plan that are broadcast, as text."""
    lines, out = df._jdf.queryExecution().sparkPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        if "Join" in line and "Broadcast" in line:
            deep = lambda x: len(x) - len(x.lstrip(" :+-"))
            kids = [j for j in range(i + 1, len(lines)) if deep(lines[j]) == deep(line) + 3]
            side = kids[0] if "BuildLeft" in line else kids[1]
            end = next((j for j in range(side + 1, len(lines)) if deep(lines[j]) <= deep(lines[side])), len(lines))
            out.append("\n".join(lines[side:end]))
    return out


def test_requests_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A small file of requests offers many times its size; only the short list of aliases goes to every task."""
    spark.range(300).selectExpr("id as query_id", "concat('ask ', id, ' 收盘价 动量') as text").write.parquet(f"{tmp_path}/q")
    q, al = spark.read.parquet(f"{tmp_path}/q"), aliases(spark)
    met = se.alias_match(q, al)
    sides = _broadcasts(met)
    assert sides and not any("FileScan" in s for s in sides)
    monkeypatch.setattr(se, "FEW_ALIASES", 3)
    merged = se.alias_match(q, al)
    assert not _broadcasts(merged) and sorted(merged.collect()) == sorted(met.collect())
    found = met.select("query_id", "table", "field", F.lit(1).alias("position"))
    assert not any("FileScan" in s for s in _broadcasts(se.price_rerank(found, q, al, 3)))


def test_pairs_are_shuffled_without_their_words(spark):
    """No array of a query's words or map of a document's travels with each pair."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} the") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the w{q}") for q in range(6)], "query_id long, text string")
    best = se.bm25_topk(docs, asked, 3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "map_from_entries" not in plan and best.count() == 18


def test_longest_alias_of_a_large_table(spark):
    import random

    rng = random.Random(1)
    names = list({"".join(rng.choices("abc价 ", k=rng.randrange(1, 6))).strip() for _ in range(800)} - {""})
    table = [(n, "t", f"f{i}", rng.choice([None, "stock"]), None) for i, n in enumerate(names)]
    texts = ["".join(rng.choices("abc价 ", k=rng.randrange(0, 12))) for _ in range(60)] + names[:20] + ["zzz", ""]
    q = spark.createDataFrame([(i, t, rng.choice([None, "stock", "index"])) for i, t in enumerate(texts)], "query_id int, text string, asset_type string")
    got = {r.query_id: (r.alias, r.score) for r in se.alias_match(q, spark.createDataFrame(table, "alias string, table string, field string, asset_type string, frequency string")).collect()}
    want = {}
    for i, text, asset in q.collect():
        fits = [(n == text.strip(), len(n), n) for n, _, _, a, _ in table if n in text.strip() and (a is None or asset is None or a == asset)]
        if fits:
            best = max(fits, key=lambda x: (x[0], x[1], x[2].encode()))
            want[i] = (best[2], 1.0 if best[0] else 0.9)
    assert got == want and len(want) > 40


def test_aliases(spark):
    q = spark.createDataFrame([(1, "收盘价"), (2, "用后复权收盘价算"), (3, "hello")], "query_id int, text string")
    got = {r.query_id: (r.alias, r.score) for r in se.alias_match(q, aliases(spark)).collect()}
    assert got == {1: ("收盘价", 1.0), 2: ("后复权收盘价", 0.9)}


@pytest.mark.parametrize("text, want", [
    ("收盘价", "inferred_adjusted"), ("不复权收盘价", "explicit_none"), ("前复权收盘价", "explicit_forward"), ("adj close momentum", "explicit_backward"),
    ("return on equity", None), ("daily return", "inferred_adjusted"), ("资产收益率", None), ("成交量", None), ("20日收益率", "inferred_adjusted"),
])
def test_price_family(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(se.price_family(F.col("t"))).first()[0] == want


def test_rerank_injects_and_keeps_places(spark):
    c = spark.createDataFrame([(1, "t", f"f{i}", i) for i in range(5)] + [(1, "ashareeodprices", "s_dq_close", 5)], "query_id int, table string, field string, position int")
    r = spark.createDataFrame([(1, "动量")], "query_id int, text string")
    got = [(x.field, x.injected, x.price_adjustment) for x in se.price_rerank(c, r, aliases(spark), 3).orderBy("rank").collect()]
    assert got == [("s_dq_adjclose", True, "backward"), ("s_dq_close", False, "none"), ("f0", False, None)]


def test_intents_and_questions(spark):
    ideas = spark.createDataFrame([(1, "后复权收盘价"), (2, "停牌股票"), (3, "x")], "query_id int, text string")
    got = {r.query_id: (r.tool, r.field, r.adjust_type) for r in fl.match_intent(ideas).collect()}
    assert got == {1: ("get_price", "close", "post"), 2: ("suspended", None, None)}
    q = spark.createDataFrame([("估值因子", "", "up", "monthly"), ("复合因子 估值", "", "up", None), ("PE_TTM 估值", "", None, "monthly")], "idea string, draft string, direction string, rebalance string")
    assert [(r.blocking, r.optional) for r in fl.blocking_questions(q).collect()] == [(["valuation_definition"], []), ([], ["rebalance_frequency"]), (["direction"], [])]


def test_profile_and_fill(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "v") for i in range(300)], "id int, v string")
    got = fl.profile_sample(df, "v", "static_lookup", ["id"]).first()
    assert (got.row_count, got.status, got.samples) == (10, "data_sparse", ["v"] * 4)
    assert fl.profile_sample(df.limit(0), "v", "static_lookup", ["id"]).first().status == "no_data_in_sample"
    assert {r.field: r.filled for r in fl.fill_rate(df).collect()} == {"id": 300, "v": 100}
    with pytest.raises(ValueError, match="time_role_invalid"):
        fl.profile_sample(df, "v", "report_period", ["id"], roles=True)


def test_discovery_puts_the_registry_first(spark):
    req = spark.createDataFrame([(1, "pb"), (2, "FLOAT_MV")], "query_id int, logical_name string")
    hits = spark.createDataFrame([(1, "t", "f", 99.0), (2, "t", "f", 1.0)], "query_id int, table string, field string, score double")
    got = [(r.query_id, r.field) for r in fl.discover_fields(req, metrics(spark), hits).orderBy("query_id", "position").collect()]
    assert got == [(1, "s_val_pb_new"), (1, "f"), (2, "f")]


def test_blocks_and_pages(spark):
    b = spark.createDataFrame([(1, 1, 0, "本因子定义 " + "x" * 700), (1, 2, 0, "rank FACTOR"), (1, 3, 0, "nothing")], "doc_id int, page int, block int, text string")
    got = dc.score_blocks(b).orderBy("rank").collect()
    assert [(r.evidence_id, r.score) for r in got] == [("p1b0", 5.5), ("p2b0", 4.5)] and len(got[0].excerpt) == 600
    lines = spark.createDataFrame([(1, 1, 0, "b", 0.5, 9.0, 0.4), (1, 1, 1, "a", 0.9, 1.0, 0.3), (1, 1, 2, "", 0.7, 0.0, 5.0)], "doc_id int, page int, line int, text string, confidence double, x double, y double")
    m = dc.merge_lines(lines).first()
    assert (m.text, m.uncertain_lines) == ("a\nb", 1) and m.mean_confidence == pytest.approx(0.7)


DOCS = [
    ({"messages": [{"role": "u", "content": "hello"}], "n": 3}, None),
    ({"a": {"b": ["x", {"S_DQ_CLOSE": 1.5}]}}, ("raw_data", "a.b.1")),
    ({"s_dq_close": "收盘价"}, None),
    ({"trade_dt": "20240101"}, ("raw_data", "<root>")),
    ({"ok": 1, "db_password": "x"}, ("secret", "db_password")),
    ({"z": "-----BEGIN RSA PRIVATE KEY-----", "api_key": "k"}, ("secret", "z")),
    ({"q": "jdbc:mysql"}, ("connection_string", "q")),
    ({"q": "def f(x):"}, ("internal_code", "q")),
    ({"script": "x"}, ("internal_code", "script")),
    ({"values": [1]}, ("full_result_data", "values")),
    ({"values": 1}, None),
    ([{"k": "v"}] * 21, ("full_result_data", "<root>")),
    ([{"k": "v"}] * 20, None),
    ({"pdf_text": "x"}, ("full_report_body", "pdf_text")),
    ({"report_excerpt": "short"}, ("full_report_body", "report_excerpt")),
    ({"x": None, "y": [], "z": {}}, None),
]


def test_outbound_rules(spark):
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, (d, _) in enumerate(DOCS)], "id int, doc string")
    got = {r.id: (r.category, r.location) if r.category else None for r in ob.scan_json(rows, "id", "doc").collect()}
    assert got == {i: want for i, (_, want) in enumerate(DOCS)}


def test_excerpts_may_be_allowed_up_to_a_length(spark):
    rows = spark.createDataFrame([(1, json.dumps({"excerpt": "x" * 2000})), (2, json.dumps({"excerpt": "x" * 2001}))], "id int, doc string")
    got = {r.id: r.category for r in ob.scan_json(rows, "id", "doc", allow_excerpt=True).collect()}
    assert got == {1: None, 2: "full_report_body"}


def test_json_values_are_told_from_texts_like_them(spark, monkeypatch):
    """By their beginnings, and by their parsed values alone."""
    values = ["5", '"5"', "-1.5e3", '"-"', "true", '"true"', r'"true\n"', r'"tru\u0065"', r'"\u0035"', r'"\t5"', '"truely"', '""', "null", '"null"', "{}", '"{"', "[ ]", '"[]"', '"20240101"', r'"a\"5\""', ' "x"']
    docs = [f'{{"{k}" : {v}}}' for k in ("values", "s_x") for v in values] + [f'[[{v}], {{"values":{v}}}]' for v in values]
    rows = spark.createDataFrame([*enumerate(docs)], "id int, doc string")

    def wanted(doc):
        whole = json.loads(doc)
        inner, at = (whole, "") if isinstance(whole, dict) else (whole[1], "1.")
        (key, v), = inner.items()
        if key == "s_x":
            observed = isinstance(v, (bool, int, float)) or v == "20240101"
            return ("raw_data", "<root>") if observed else (None, None)
        return ("full_result_data", f"{at}values") if isinstance(v, (str, dict, list)) else (None, None)

    for unclear in (ob.UNCLEAR, ""):
        monkeypatch.setattr(ob, "UNCLEAR", unclear)
        got = {r.id: (r.category, r.location) for r in ob.scan_json(rows, "id", "doc").collect()}
        assert got == {i: wanted(d) for i, d in enumerate(docs)}


def plain_walk(node, path=()):
    """The first hit of a plain depth-first walk that knows one rule: a key named password."""
    if isinstance(node, dict):
        for k, v in node.items():
            if k == "password":
                return ".".join((*path, k))
            found = plain_walk(v, (*path, k))
            if found:
                return found
    elif isinstance(node, list):
        for i, v in enumerate(node):
            found = plain_walk(v, (*path, str(i)))
            if found:
                return found
    return None


def test_documents_of_any_depth_are_walked_to_the_end(spark):
    import random

    rng = random.Random(2)

    def made(depth):
        if depth == 0:
            return rng.choice(["fine", None, 3, [], {}])
        kids = [made(depth - 1)] + [made(0) for _ in range(rng.randrange(3))]
        rng.shuffle(kids)
        return kids if rng.random() < 0.4 else {("password" if rng.random() < 0.06 else f"k{i}"): v for i, v in enumerate(kids)}

    docs = [made(d) for d in [*range(1, 31), 30, 29, 40, 60] for _ in range(2)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    want = {i: plain_walk(d) for i, d in enumerate(docs)}
    assert sum(v is None for v in want.values()) > 10 and max(v.count(".") for v in want.values() if v) > 15
    for levels in (1, 4):
        got = {r.id: r.location for r in ob.scan_json(rows, "id", "doc", levels=levels).collect()}
        assert got == want


def test_json_scan_fails_closed(spark):
    deep = '{"a":' * 12 + '{"token":"x"}' + "}" * 12
    rows = spark.createDataFrame([(1, deep), (2, '{"password":"x"'), (3, "sk-" + "a" * 30), (4, None), (5, '{"fine":1}'), (6, "")], "id int, doc string")
    scanned = ob.scan_json(rows, "id", "doc")
    got = {r.id: (r.category, r.location) for r in scanned.collect()}
    assert got == {1: ("secret", "a." * 12 + "token"), 2: ("unreadable", "<root>"), 3: ("secret", "<root>"), 4: (None, None), 5: (None, None), 6: ("unreadable", "<root>")}
    blocked = ob.audit_rows(scanned.join(rows, "id"), "id", "doc").collect()
    assert {r.id for r in blocked if r.blocked} == {1, 2, 3, 6}
