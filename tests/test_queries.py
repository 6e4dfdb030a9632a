"""Registered queries against their SQL on the smallest data; ``tools/compare.py`` runs them all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from panelweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "factor_momentum", "factor_illiquidity", "factor_pit_quality", "factor_members_momentum", "f_nested", "x1_winsorize", "x5_ordered_steps", "a5_rank_ic", "a6_quantile_bucket",
    "i1_combine_factors", "i5_index_factor_score", "j1_instruments", "j3_suspended", "j4_index_members", "j6_industry_zx", "j7_resolve_prices", "q7_latest_announcement",
    "c3_next_trading_date", "v10_distribution", "f1_audit_trees", "t1_segment", "t2_bm25_topk", "t7_price_rerank", "d8_route_extraction", "d10_scan_json", "e1_fold_snapshot", "e4_append_conflicts", "e7_heartbeat", "l1_publish_at_once",
    "w3_stream_sessions", "l7_table_diff", "m1_suite_metrics",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["date", "code", "value"] and df.count() > 0


def test_every_query_has_sql():
    assert set(registry.callables()) == set(registry.sql_texts()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    from tools.compare import rows_of

    df = entry_points.queries()[name](spark, FOLDER)
    cur = con.execute(entry_points.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
