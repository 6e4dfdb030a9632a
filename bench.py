"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans import registry  # noqa: E402
from panelweave.session import local_session  # noqa: E402

HEADLINE = [
    "factor_momentum", "factor_illiquidity", "factor_price_volume", "factor_triple", "factor_pit_quality", "f_rolling_std", "f_nested",
    "x1_winsorize", "x2_zscore", "x5_ordered_steps", "a4_ic", "a6_quantile_bucket", "a11_analyze_factor", "i1_combine_columns", "i1_combine_factors", "i5_index_factor_score",
    "j2_interval_mask", "j3_suspended", "j4_index_members", "j7_resolve_prices", "j8_pit_align", "q7_latest_announcement", "p1_price_post",
    "v16_result_summary", "f1_audit_trees", "t1_segment", "t2_bm25_topk", "d1_score_blocks", "d9_scan_documents", "d10_scan_json", "e1_fold_snapshot", "e2_fold_state", "e6_stream_fold", "e6_stream_states", "w1_stream_panel", "w3_stream_sessions", "m1_suite_metrics", "l7_table_diff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's threads
    queries = registry.callables()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
