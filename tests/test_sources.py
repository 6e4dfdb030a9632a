import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import panel, wide
from pyspark.sql import functions as F

from panelweave.operators import library as lb
from panelweave.operators import prices, query_shapes as qs, usage as us
from panelweave.sources import files, markdown as md
from panelweave.sources.registry import metrics


def test_field_index(spark):
    text = "# T\n> intro\n## 章\n### AShareEODPrices（行情）\nS_DQ_CLOSE, s_dq_open,,\n\n### broken header\nlost\n### Other(x)\na"
    got = [(r.table, r.field) for r in md.parse_field_index(spark.createDataFrame([("p", text)], "path string, text string")).collect()]
    assert got == [("ashareeodprices", "s_dq_close"), ("ashareeodprices", "s_dq_open"), ("other", "a")]


def test_dictionary_rows(spark):
    text = (
        "# AShareX_数据字典\n**所属模块**: 中国A股-股票信息\n**注释说明**: 业务主键：代码,报告期 所属数据库：中国A股数据库\n| 序号 | 名称 |\n|---|---|\n"
        "| 1 | 净利 | NET_PROFIT | NUMBER (20,4) | 93.6% | 元 |\n| 2 | a | b | REPORT_PERIOD | VARCHAR2(8) |\n| 3 | 报 | OLD DATE x | 净资产 S_FA_ROE FLOAT | 说明 |\n| bad |\n| 4 | 无 | 中文 |\n"
    )
    got = {r.field: r for r in md.parse_dictionary(spark.createDataFrame([("x/AShareX.md", text)], "path string, text string")).collect()}
    assert set(got) == {"net_profit", "report_period", "s_fa_roe"}
    n = got["net_profit"]
    assert (n.name, n.data_type, n.fill_rate, n.description) == ("净利", "NUMBER(20,4)", pytest.approx(0.936), "元")
    assert (n.table, n.asset_type, n.frequency, n.market, n.report_period_field) == ("asharex", "stock", "quarterly", "cn_a", "report_period")
    assert (got["report_period"].name, got["s_fa_roe"].name, got["s_fa_roe"].data_type) == ("a b", "净资产", "FLOAT")


def test_dictionary_rows_are_read_once(spark):
    """No filter below the opening of rows parses them as well, to leave out files without any."""
    files = spark.createDataFrame([("a.md", "| 1 | x | AAA_B | DATE |"), ("b.md", "no rows"), ("c.md", None)], "path string, text string")
    got = md.parse_dictionary(files)
    assert [(r.path, r.field) for r in got.collect()] == [("a.md", "aaa_b")]
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert len(below) == 2 and "Filter" not in below[1]


def test_publish_never_replaces(spark, tmp_path):
    root, reg = str(tmp_path / "lib"), metrics(spark)
    p = panel(spark, {"a": [1, 2]})
    assert [lb.publish(p, root, "m", ["PB"], reg), lb.publish(p.limit(1), root, "m", ["PB"], reg)] == [1, 2]
    lib = lb.read_library(spark, root)
    assert lb.get_version(lib, "m", 1).count() == 2
    assert "PartitionFilters: [isnotnull(factor_id" in lb.get_version(lib, "m", 1)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        lb.publish(p, root, "m", ["FLOAT_MV"], reg)
    with pytest.raises(Exception):
        p.write.mode("errorifexists").parquet(f"{root}/factor_id=m/version=1")


def test_publish_is_one_step(spark, tmp_path):
    """A version without its entry, whole or in part, is neither listed, read nor numbered over; 007 is no 7."""
    root, reg = str(tmp_path / "lib"), metrics(spark)
    p = panel(spark, {"a": [1, 2]})
    assert lb.read_entries(spark, root).count() == 0
    assert lb.publish(p, root, "007", ["PB"], reg) == 1
    # A publisher that has claimed a number and written its rows, but no entry; and an entry that is cut off.
    name = hashlib.sha256(b"007").hexdigest()
    assert files.create_once(spark, f"{root}/_claims/{name}.2", "") and not files.create_once(spark, f"{root}/_claims/{name}.2", "")
    p.withColumn("review_status", F.lit("x")).withColumn("review_note", F.lit("y")).write.parquet(f"{root}/factor_id=007/version=2")
    (tmp_path / "lib" / "_entries" / f"{name}.2.json").write_text('{"factor_id": "007", "vers')
    assert [(r.factor_id, r.version) for r in lb.read_entries(spark, root).collect()] == [("007", 1)]
    assert {(r.factor_id, r.version) for r in lb.read_library(spark, root).collect()} == {("007", 1)}
    assert [(r.factor_id, r.version) for r in lb.unpublished(spark, root).collect()] == [("007", 2)]
    assert lb.publish(p.limit(1), root, "007", ["PB"], reg) == 3
    assert lb.publish(p, root, "a/b c", [], reg) == 1
    assert lb.get_version(lb.read_library(spark, root), "007", 3).count() == 1 and lb.get_version(lb.read_library(spark, root), "a/b c", 1).count() == 2
    assert [r.unchanged for r in lb.verify_version(spark, root, "007", 3).collect()] == [True] and lb.verify_version(spark, root, "007", 2).count() == 0
    p.withColumn("review_status", F.lit("x")).withColumn("review_note", F.lit("y")).write.mode("append").parquet(f"{root}/factor_id=007/version=3")
    assert [r.unchanged for r in lb.verify_version(spark, root, "007", 3).collect()] == [False]
    with pytest.raises(ValueError):
        lb.publish(p, root, "", ["PB"], reg)


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path):
    root, reg = str(tmp_path / "lib"), metrics(spark)
    p = panel(spark, {"a": [1, 2, 3, 4]})
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: lb.publish(p.limit(n), root, "m", ["PB"], reg), range(1, 5)))
    assert sorted(got) == [1, 2, 3, 4]
    sizes = {r.version: r["count"] for r in lb.read_library(spark, root).groupBy("version").count().collect()}
    assert sizes == {v: n for v, n in zip(got, range(1, 5))}
    with ThreadPoolExecutor(8) as pool:
        for make in (files.create_once, files.hadoop_create_once):
            made = list(pool.map(lambda _: make(spark, f"{tmp_path}/{make.__name__}", "x"), range(16 if make is files.create_once else 1)))
            assert made.count(True) == 1 and not make(spark, f"{tmp_path}/{make.__name__}", "y")
            assert (tmp_path / make.__name__).read_text() == "x"


def test_fingerprint_and_verify(spark):
    p = panel(spark, {"a": [1, 2], "b": [3, None]})
    assert lb.fingerprint(p).first() == lb.fingerprint(p.repartition(3).select("value", "code", "date")).first()
    assert lb.fingerprint(p).first() != lb.fingerprint(p.union(p.limit(1))).first()
    assert not lb.verify_content(p.limit(3), lb.fingerprint(p)).first().unchanged


def test_difference_reasons(spark):
    cols = "factor_id string, manifest string, result string, input_hashes array<string>, code_commit string"
    a = spark.createDataFrame([("x", "m", "r", ["1"], "c"), ("y", "m", "r", ["1"], "c"), ("z", "m", "r", ["1"], "c")], cols)
    b = spark.createDataFrame([("x", "n", "r", ["2"], "d"), ("y", "m", "q", ["1"], "c"), ("z", "m", "r", ["1"], "c")], cols)
    got = {r.factor_id: r.reasons for r in lb.explain_difference(a, b).collect()}
    assert got == {"x": ["manifest", "inputs", "versions:code_commit"], "y": ["unexplained"], "z": []}


def test_files_round_trip(spark, tmp_path):
    p = panel(spark, {"a": [1, 2]})
    for n in ("close", "open"):
        p.write.parquet(f"{tmp_path}/{n}.parquet")
    cols = files.variables_to_columns(files.load_variables(spark, str(tmp_path), ["close", "open"]), ["close", "open"])
    assert wide(cols, "open") == {"a": [1, 2]}
    with pytest.raises(ValueError):
        files.load_variables(spark, str(tmp_path), [])
    files.write_factor(p, f"{tmp_path}/f")
    with pytest.raises(Exception):
        files.write_factor(p, f"{tmp_path}/f")


def test_shape_guards(spark):
    df = panel(spark, {"a": [1]})
    for cols in (["code;drop"], ["nope"], ["Code"]):
        with pytest.raises(ValueError):
            qs.check_columns(df, cols)
    with pytest.raises(ValueError):
        qs.check_roles("interval_overlap", {"interval_start": "x"})
    with pytest.raises(ValueError):
        qs.check_roles("free_sql", {})


def test_code_filter_reaches_the_scan(spark, tmp_path):
    panel(spark, {"a": [1], "b": [2]}).write.parquet(f"{tmp_path}/t")
    df = qs.scan_bars(spark.read.parquet(f"{tmp_path}/t"), ["a"], "2024-01-01", "2024-12-31", ["value"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,a)" in plan and df.count() == 1


def test_price_rules(spark):
    assert prices.adjust_type_for("s_dq_adjclose_backward") == "pre" and prices.adjust_type_for("s_dq_adjopen") == "post" and prices.adjust_type_for("s_dq_volume") == "none"
    rows = spark.createDataFrame([("600000.SH", "20240102", 10.0, 0.0, 20.0, 11.0, "-1"), ("600000.SH", "20240103", 0.0, 5.0, 20.0, 11.0, "0")],
        "s_info_windcode string, trade_dt string, s_dq_close double, s_dq_volume double, s_dq_adjclose double, s_dq_limit double, s_dq_tradestatuscode string")
    got = prices.get_price(rows, ["close", "limit_up", "volume"], "post").orderBy("date").collect()
    assert [(r.close, r.limit_up, r.volume) for r in got] == [(20.0, 22.0, 0.0), (20.0, None, 5.0)]
    assert prices.get_price(rows, ["close"], skip=True).count() == 1
    with pytest.raises(ValueError):
        prices.get_price(rows, ["vwap"])


def test_usage_edges(spark):
    none = spark.createDataFrame([], "success boolean, blocked boolean, tokens long, cost double")
    assert us.usage_summary(none).first().failure_rate == 0.0
    cases = spark.createDataFrame([], "case_id int, category string, parsed boolean, ast_match boolean, expected array<string>, raised array<string>")
    got = us.suite_metrics(cases).first()
    assert (got.parse_success_rate, got.blocking_recall, got.unnecessary_question_rate) == (1.0, 1.0, 0.0)
    e = spark.createDataFrame([("field", "missing_window", 2), ("field", "missing_window", 0), ("x", "odd", 1), ("x", "missing_window", 1)], "category string, code string, attempts_used int")
    assert [r.reason for r in us.route_errors(e).collect()] == ["attempts_exhausted", "category_refused", "code_not_registered", "repairable"]


def test_merge_catalogs(spark):
    i = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b")], "table string, field string")
    d = spark.createDataFrame([("t", "a", "A", "WDS")], "table string, field string, name string, metadata_source string")
    got = {r.field: r.metadata_source for r in files.merge_catalogs(i, d).collect()}
    assert got == {"a": "WDS", "b": None} and files.catalog_coverage(files.merge_catalogs(i, d)).first().coverage == 0.5


def test_long_code_list_is_joined(spark):
    from panelweave.operators.query_shapes import ISIN_LIMIT, only_codes

    rows = spark.createDataFrame([(i,) for i in range(3000)], "code int")
    assert only_codes(rows, "code", [*range(0, 2 * ISIN_LIMIT), 5]).count() == 2 * ISIN_LIMIT
    assert only_codes(rows, "code", [1, 1, 2]).count() == 2


def test_scan_bars_of_all_codes_and_of_a_long_list(spark, tmp_path):
    """The query reads the bars of every customer in its span; a list of more codes than one IN takes is joined."""
    import datetime as dt

    from panelweave.plans import registry

    day = dt.datetime(1996, 5, 1)
    rows = [(c, day, float(c)) for c in range(1, 4500)] + [(7, dt.datetime(1998, 1, 1), 1.0)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.code for r in registry.callables()["s2_scan_bars"](spark, str(tmp_path)).collect()} == set(range(1, 4500))
    listed = list(range(1, 4000, 3))
    assert len(listed) > qs.ISIN_LIMIT
    bars = orders.withColumnsRenamed({"o_custkey": "code", "o_orderdate": "date"})
    got = qs.scan_bars(bars, listed, day, day, ["o_totalprice"])
    assert sorted(r.code for r in got.collect()) == listed
