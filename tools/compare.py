"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

Usage: python tools/compare.py [folder] [name-part …]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelweave.plans import registry  # noqa: E402
from panelweave.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for kv in filter(None, os.environ.get("SPARK_SET", "").split(",")):
        spark.conf.set(*kv.split("="))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, sql = registry.callables(), registry.sql_texts()
    bad = 0
    for name, build in queries.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            df = build(spark, folder)
            got = rows_of(df.columns, df.collect())
            took = time.time() - t
            if name not in sql:
                print(f"rows  {name} {sum(got.values())} rows {took:.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            cols = [c[0] for c in cur.description]
            want = rows_of(cols, cur.fetchall())
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            bad += 1
            continue
        if sorted(cols) != sorted(df.columns):
            print(f"FAIL  {name}: columns {sorted(df.columns)} != {sorted(cols)}", flush=True)
            bad += 1
        elif got != want:
            a, b = list((got - want).items()), list((want - got).items())
            print(f"FAIL  {name}: {sum(got.values())} vs {sum(want.values())} rows; {len(a)} only here {sorted(a)[:3]}; {len(b)} only in SQL {sorted(b)[:3]}", flush=True)
            bad += 1
        else:
            print(f"ok    {name} {sum(got.values())} rows {took:.1f}s", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
