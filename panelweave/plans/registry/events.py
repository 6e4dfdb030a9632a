"""Event logs in batch and streaming, library, provenance, usage and acceptance metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.operators import event_log as el
from panelweave.operators import library as lb
from panelweave.operators import usage as us
from panelweave.plans.registry import query
from panelweave.plans.registry import sql as S
from panelweave.session import scratch
from panelweave.sources.domain import EVENT_INVALIDATES, EVENT_STATES, EVENT_WRITES
from panelweave.streaming import events as st


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


WROTE = _values([(e, k) for e, ks in EVENT_WRITES.items() for k in ks])
CLEARED = _values([(e, k) for e, ks in EVENT_INVALIDATES.items() for k in ks])


def snapshot_sql(where="true"):
    return f"""WITH {S.SESSIONS}, w(event_type, key) AS (VALUES {WROTE}), c(event_type, key) AS (VALUES {CLEARED}),
  p AS (SELECT ev.*, key, CASE key WHEN 'cart' THEN CASE WHEN value >= 5 THEN CAST(event_id AS VARCHAR) END WHEN 'page' THEN event_type ELSE CAST(event_id AS VARCHAR) END AS v FROM ev JOIN w USING (event_type) WHERE {where}),
  lw AS (SELECT session_id, key, max(sequence) AS set_at, arg_max(v, sequence) AS value FROM p WHERE v IS NOT NULL GROUP BY 1, 2),
  lc AS (SELECT session_id, key, max(sequence) AS cleared FROM ev JOIN c USING (event_type) WHERE {where} GROUP BY 1, 2)
  SELECT lw.session_id, lw.key, value, set_at FROM lw LEFT JOIN lc ON lc.session_id = lw.session_id AND lc.key = lw.key WHERE cleared IS NULL OR set_at >= cleared"""


STATES = f"""{S.SESSIONS}, tr(s, e, t) AS (VALUES {_values(EVENT_STATES)}), mx AS (SELECT session_id, max(sequence) AS version FROM ev GROUP BY 1)"""
RUN = f"""WITH RECURSIVE {STATES}, run AS (SELECT session_id, CAST('created' AS VARCHAR) AS state, CAST(0 AS BIGINT) AS sequence, CAST(NULL AS BIGINT) AS illegal_at FROM mx
  UNION ALL SELECT r.session_id, tr.t, ev.sequence, coalesce(r.illegal_at, CASE WHEN tr.t IS NULL THEN ev.sequence END) FROM run r JOIN ev ON ev.session_id = r.session_id AND ev.sequence = r.sequence + 1
  LEFT JOIN tr ON tr.s = r.state AND tr.e = ev.event_type), fin AS (SELECT run.session_id, state, CAST(illegal_at AS VARCHAR) AS illegal_at, version FROM run JOIN mx ON mx.session_id = run.session_id AND run.sequence = version)"""


def states(d):
    return el.fold_state(d.session_events, EVENT_STATES)


def _text_ids(df):
    return df.withColumn("illegal_at", F.col("illegal_at").cast("long").cast("string"))


@query("e1_fold_snapshot", snapshot_sql(), dates="")
def _(d):
    return el.fold_snapshot(d.session_events, EVENT_WRITES, EVENT_INVALIDATES)


@query("e2_fold_state", f"{RUN} SELECT session_id, state, illegal_at, version FROM fin", dates="")
def _(d):
    return _text_ids(states(d))


@query("e3_snapshot_at", snapshot_sql("sequence <= 10"), dates="")
def _(d):
    return el.snapshot_at(d.session_events, 10, EVENT_WRITES, EVENT_INVALIDATES)


@query("e4_append_conflicts", f"""{RUN}, pr AS (SELECT user_id AS session_id, event_id AS proposal_id, event_type, CASE WHEN value < 5 THEN (SELECT version FROM mx WHERE mx.session_id = user_id) - 1 ELSE (SELECT version FROM mx WHERE mx.session_id = user_id) END AS expected_version
    FROM events), f AS (SELECT pr.session_id, min(proposal_id) AS first FROM pr JOIN fin ON fin.session_id = pr.session_id AND fin.version = pr.expected_version JOIN tr ON tr.s = fin.state AND tr.e = pr.event_type GROUP BY 1),
  v AS (SELECT pr.session_id, pr.proposal_id, version, CASE WHEN pr.expected_version <> version THEN 'stale_version' WHEN pr.proposal_id > first THEN 'duplicate_version' WHEN fin.state IS NULL OR tr.t IS NULL THEN 'illegal_transition' ELSE 'appended' END AS verdict
    FROM pr JOIN fin ON fin.session_id = pr.session_id LEFT JOIN f ON f.session_id = pr.session_id LEFT JOIN tr ON tr.s = fin.state AND tr.e = pr.event_type)
  SELECT session_id, proposal_id, verdict, CASE WHEN verdict = 'appended' THEN CAST(version + 1 AS VARCHAR) END AS new_sequence FROM v""", dates="")
def _(d):
    """All events proposed again, some of them against an older version, many of them illegal."""
    heads = d.session_events.groupBy("session_id").agg(F.max("sequence").alias("_v"))
    late = d.table("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("proposal_id"), "event_type", "value").join(heads, "session_id")
    pr = late.withColumn("expected_version", F.when(F.col("value") < 5, F.col("_v") - 1).otherwise(F.col("_v"))).drop("_v", "value")
    got = el.append_conflicts(d.session_events, pr, EVENT_STATES)
    return got.withColumn("new_sequence", F.col("new_sequence").cast("string"))


@query("e5_sequence_gaps", f"""WITH {S.SESSIONS}, s AS (SELECT session_id, CASE WHEN value BETWEEN 20 AND 21 THEN sequence - 1 ELSE sequence END AS sequence FROM ev WHERE value NOT BETWEEN 10 AND 12),
  p AS (SELECT session_id, sequence, count(*) AS n FROM s GROUP BY 1, 2) SELECT session_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(max(sequence) - count(*) AS BIGINT) AS missing FROM p GROUP BY 1""", dates="")
def _(d):
    """A damaged log: some events lost and some numbered like their predecessor."""
    e = d.session_events.join(d.table("events").select("event_id", "value"), "event_id").filter("NOT value BETWEEN 10 AND 12")
    return el.sequence_gaps(e.withColumn("sequence", F.when(F.col("value").between(20, 21), F.col("sequence") - 1).otherwise(F.col("sequence"))))


@query("e8_idempotency_key", "SELECT sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CASE WHEN value > 50 THEN '' ELSE 'low' END)) AS request_key, count(*) AS requests, min(event_id) AS first_request FROM events GROUP BY 1", dates="")
def _(d):
    e = d.table("events").withColumn("band", F.when(F.col("value") <= 50, "low"))
    return el.collapse_requests(e, ["user_id", "event_type", "band"], "event_id")


RETENTION = """f AS (SELECT event_id, ts, CAST(value * 100 AS BIGINT) AS bytes, CASE event_type WHEN 'view' THEN 'temporary' WHEN 'click' THEN 'extracted_text' WHEN 'purchase' THEN 'published_output' WHEN 'error' THEN 'input_parquet' ELSE 'log' END AS c FROM events),
  l(c, days) AS (VALUES ('temporary', 1), ('extracted_text', 7), ('input_parquet', 14), ('log', 30)),
  x AS (SELECT f.*, date_diff('second', ts, TIMESTAMP '2024-02-01') AS age FROM f JOIN l ON l.c = f.c WHERE epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) > days * 86400)"""


def retained(d):
    cls = F.create_map(*[F.lit(x) for kv in {"view": "temporary", "click": "extracted_text", "purchase": "published_output", "error": "input_parquet", "signup": "log"}.items() for x in kv])
    files = d.table("events").select("event_id", cls[F.col("event_type")].alias("artifact_class"), F.col("ts").cast("timestamp").alias("modified"), F.floor(F.round(F.col("value") * 100, 0)).cast("long").alias("bytes"))
    return el.retention_report(files, F.lit("2024-02-01").cast("timestamp"))


@query("e9_retention_report", f"WITH {RETENTION} SELECT event_id, c AS artifact_class FROM x", dates="")
def _(d):
    return retained(d).select("event_id", "artifact_class")


@query("e9_retention_totals", f"WITH {RETENTION} SELECT c AS artifact_class, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes_reclaimed FROM x GROUP BY 1", dates="")
def _(d):
    return el.retention_totals(retained(d))


# ---- streaming -----------------------------------------------------------------------


def landed(d, rows):
    """The rows written as files of a folder, opened as a stream, and room for results."""
    root = scratch(d.spark, "stream")
    rows.write.parquet(f"{root}/in")
    return st.follow(d.spark, f"{root}/in", rows.schema), root


@query("e6_stream_states", f"""WITH RECURSIVE {S.SESSIONS}, tr(s, e, t) AS (VALUES {_values(EVENT_STATES)}), pe AS (SELECT session_id, sequence, event_type, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS rn FROM ev WHERE sequence % 13 <> 11),
  mx AS (SELECT session_id, max(rn) AS rn, max(sequence) AS version, max(sequence) - count(*) AS missing FROM pe GROUP BY 1),
  run AS (SELECT session_id, CAST('created' AS VARCHAR) AS state, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS illegal_at FROM mx
    UNION ALL SELECT r.session_id, tr.t, pe.rn, coalesce(r.illegal_at, CASE WHEN tr.t IS NULL THEN pe.sequence END) FROM run r JOIN pe ON pe.session_id = r.session_id AND pe.rn = r.rn + 1 LEFT JOIN tr ON tr.s = r.state AND tr.e = pe.event_type)
  SELECT run.session_id, state, CAST(illegal_at AS VARCHAR) AS illegal_at, version, CAST(missing AS BIGINT) AS missing FROM run JOIN mx ON mx.session_id = run.session_id AND run.rn = mx.rn""", dates="")
def _(d):
    """Three drains over one checkpoint: numbers come out of order, some twice, some never."""
    e = d.session_events.select("session_id", "sequence", "event_type").filter("sequence % 13 <> 11")
    stream, root = landed(d, e.filter("sequence % 3 = 1"))
    for n, part in enumerate((None, "sequence % 3 = 0 or sequence % 9 = 1", "sequence % 3 = 2")):
        if part:
            e.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = st.follow(d.spark, f"{root}/in", e.schema)
        st.drain_updates(st.stream_states(stream, EVENT_STATES), lambda b, k, n=n: b.write.mode("overwrite").parquet(f"{root}/out/drain={n}/batch={k}"), f"{root}/cp")
    newest = F.max_by(F.struct("state", "illegal_at", "version", "missing"), F.struct("drain", "batch"))
    return _text_ids(d.spark.read.parquet(f"{root}/out").groupBy("session_id").agg(newest.alias("s")).select("session_id", "s.*"))


@query("e6_stream_fold", snapshot_sql(), dates="")
def _(d):
    """Three drains over one checkpoint; events of one kind of number come late, after higher ones."""
    e = d.session_events.select("session_id", "sequence", "event_type", "payload")
    stream, root = landed(d, e.filter("sequence % 3 = 1"))
    for part in (None, "sequence % 3 = 0", "sequence % 3 = 2"):
        if part:
            e.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = st.follow(d.spark, f"{root}/in", e.schema)
        st.drain_updates(st.stream_fold(stream, EVENT_WRITES, EVENT_INVALIDATES), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/cp")
    return st.latest_snapshot(d.spark.read.parquet(f"{root}/out"))


@query("e7_heartbeat", f"""WITH {S.SESSIONS}, p AS (SELECT CASE sequence % 3 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 4 END AS drain, sequence FROM ev),
  b(drain, batch) AS (VALUES (1, 0), (2, 1), (3, 1), (4, 2), (5, 2))
  SELECT drain, batch, count(p.sequence) AS events, (SELECT max(q.sequence) FROM p q WHERE q.drain <= b.drain) AS last, count(p.sequence) = 0 AS idle FROM b LEFT JOIN p USING (drain) GROUP BY drain, batch""", dates="")
def _(d):
    """Five drains over one checkpoint; the third and the fifth find nothing new."""
    e = d.session_events.select("session_id", "sequence", "event_type")
    stream, root = landed(d, e.filter("sequence % 3 = 1"))
    for n, part in enumerate((None, "sequence % 3 = 0", None, "sequence % 3 = 2", None), 1):
        if part:
            e.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = st.follow(d.spark, f"{root}/in", e.schema)
        st.drain_watched(stream, f"{root}/out", f"{root}/cp", f"{root}/beats/drain={n}", f"{root}/beats" if n > 1 else None)
    return d.spark.read.parquet(f"{root}/beats").select("drain", "batch", "events", "last", "idle")


@query("e7_replay", f"WITH {S.SESSIONS} SELECT session_id, sequence, event_type FROM ev", dates="")
def _(d):
    """Two drains over one checkpoint: the second starts where the first stopped."""
    e = d.session_events.select("session_id", "sequence", "event_type")
    stream, root = landed(d, e.filter("sequence <= 20"))
    st.drain(stream, f"{root}/out", f"{root}/cp")
    e.filter("sequence > 20").write.mode("append").parquet(f"{root}/in")
    st.drain(st.follow(d.spark, f"{root}/in", e.schema), f"{root}/out", f"{root}/cp")
    return d.spark.read.parquet(f"{root}/out")


def _events(d):
    return d.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("w1_stream_panel", """SELECT CAST(ts AS DATE) AS date, user_id AS code, sum(value) AS value, count(*) AS events, CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 2 HOUR FROM events) AS open FROM events GROUP BY ALL""", nums="value")
def _(d):
    """All days: what the stream has sent, and what it still keeps open."""
    stream, root = landed(d, _events(d))
    st.drain(st.stream_panel(stream, "2 hours"), f"{root}/out", f"{root}/cp")
    sent = d.spark.read.parquet(f"{root}/out").withColumn("open", F.lit(False))
    return sent.unionByName(st.open_days(d.spark, f"{root}/cp").withColumn("open", F.lit(True)))


@query("w2_stream_dedup", "SELECT sha256(user_id || '|' || event_type) AS request_key, user_id, event_type FROM events GROUP BY user_id, event_type", dates="")
def _(d):
    stream, root = landed(d, _events(d))
    st.drain(st.stream_dedup(stream, ["user_id", "event_type"], "60 days"), f"{root}/out", f"{root}/cp")
    return d.spark.read.parquet(f"{root}/out").select("request_key", "user_id", "event_type")


@query("w3_stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g), a AS (SELECT user_id, sid, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS fin, count(*) AS events, sum(value) AS value FROM s GROUP BY 1, 2)
  SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(fin, '%Y-%m-%d %H:%M:%S') AS "end", events, value , fin > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS open FROM a""", nums="value", dates="")
def _(d):
    stream, root = landed(d, _events(d))
    st.drain(st.stream_sessions(stream, "6 hours", "1 hour"), f"{root}/out", f"{root}/cp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    sent = d.spark.read.parquet(f"{root}/out").withColumn("open", F.lit(False))
    return sent.unionByName(st.open_sessions(d.spark, f"{root}/cp").withColumn("open", F.lit(True))).select("user_id", text("start"), text("end"), "events", "value", "open")


# ---- library and provenance ----------------------------------------------------------


@query("l1_publish", f"WITH {S.GRID} SELECT 'momentum' AS factor_id, v AS version, count(*) AS rows, count(CASE WHEN v = 1 THEN close ELSE volume END) AS filled FROM grid, (VALUES (1), (2)) t(v) GROUP BY v", dates="")
def _(d):
    """Two versions published under one name; both stay."""
    from panelweave.sources.registry import metrics

    root = scratch(d.spark, "library")
    for col in ("close", "volume"):
        lb.publish(d.one(col), root, "momentum", ["PB"], metrics(d.spark))
    return lb.read_library(d.spark, root).groupBy("factor_id", "version").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled"))


@query("l1_publish_at_once", f"""WITH {S.GRID} SELECT 'momentum' AS factor_id, v AS version, count(*) AS row_count, 'unreviewed' AS review_status, true AS unchanged FROM grid, (VALUES (1), (2), (3)) t(v) GROUP BY v""", dates="")
def _(d):
    """Three publishers at once, beside one that died before its entry: what the library then lists, checked against the stored rows."""
    from panelweave.sources.registry import metrics

    root = scratch(d.spark, "library")
    registry = metrics(d.spark)
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda col: lb.publish(d.one(col), root, "momentum", [], registry), ("close", "high", "volume")))
    d.one("close").withColumns({"review_status": F.lit("reviewed"), "review_note": F.lit("")}).write.parquet(f"{root}/factor_id=momentum/version={max(numbers) + 1}")
    rows = lb.read_library(d.spark, root).groupBy("factor_id", "version").agg(F.count(F.lit(1)).alias("row_count"), F.first("review_status").alias("review_status"))
    checked = None
    for n in numbers:
        one = lb.verify_version(d.spark, root, "momentum", n).select(F.lit(n).cast("long").alias("version"), "unchanged")
        checked = one if checked is None else checked.unionByName(one)
    return rows.join(checked, "version").select("factor_id", "version", "row_count", "review_status", "unchanged")


def entries(d):
    return d.table("part").select(F.col("p_brand").alias("factor_id"), F.col("p_size").alias("version"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"))


@query("l2_latest_versions", "SELECT p_brand AS factor_id, max((p_size, p_name, p_retailprice))[1] AS version, max((p_size, p_name, p_retailprice))[2] AS title, max((p_size, p_name, p_retailprice))[3] AS score FROM part GROUP BY 1", nums="score", dates="")
def _(d):
    return lb.latest_versions(entries(d))


@query("l2_versions", "SELECT p_brand AS factor_id, p_size AS version, count(*) AS rows FROM part GROUP BY 1, 2", dates="")
def _(d):
    return lb.versions(entries(d))


@query("l4_verify_content", "SELECT count(*) AS row_count, true AS unchanged FROM orders UNION ALL SELECT count(*), false FROM orders UNION ALL SELECT count(*), false FROM orders", dates="")
def _(d):
    o = d.table("orders")
    edited = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, 0.0).otherwise(F.col("o_totalprice")))
    # A value that moves to a column which was NULL before.
    one = F.when(F.col("o_orderkey") != 7, F.col("o_orderstatus")), F.when(F.col("o_orderkey") != 7, F.col("o_orderpriority"))
    held = o.withColumn("o_orderstatus", one[0])
    moved = o.withColumn("o_orderstatus", F.coalesce(one[0], F.col("o_orderpriority"))).withColumn("o_orderpriority", one[1])
    checks = [lb.verify_content(o.repartition(5), lb.fingerprint(o)), lb.verify_content(edited, lb.fingerprint(o)), lb.verify_content(moved, lb.fingerprint(held))]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).select("row_count", "unchanged")


def records(d, second):
    s = d.table("supplier")
    k, bal = F.col("s_nationkey"), F.col("s_acctbal")
    bump = lambda when, base: F.when(when, F.concat(base, F.lit("'"))).otherwise(base) if second else base
    name = F.col("s_name")
    inputs = F.array(F.concat(F.lit("in1"), name), bump(k < 5, F.concat(F.lit("in2"), name)))
    return s.select(
        name.alias("factor_id"), bump(k.between(3, 8), F.lit("m")).alias("manifest"), bump(bal > 5000, F.lit("r")).alias("result"), inputs.alias("input_hashes"),
        bump(k.between(7, 12), F.lit("1")).alias("factor_spec_version"), bump(k.between(10, 15), F.lit("0.1")).alias("adapter_version"),
    )


@query("l5_explain_difference", """WITH r AS (SELECT s_name AS factor_id, concat_ws('|', CASE WHEN s_nationkey BETWEEN 3 AND 8 THEN 'manifest' END, CASE WHEN s_nationkey < 5 THEN 'inputs' END,
  CASE WHEN s_nationkey BETWEEN 7 AND 15 THEN 'versions:' || concat_ws(',', CASE WHEN s_nationkey BETWEEN 10 AND 15 THEN 'adapter_version' END, CASE WHEN s_nationkey BETWEEN 7 AND 12 THEN 'factor_spec_version' END) END) AS a, s_acctbal FROM supplier)
  SELECT factor_id, CASE WHEN a = '' AND s_acctbal > 5000 THEN 'unexplained' ELSE a END AS reasons FROM r""", dates="")
def _(d):
    return lb.explain_difference(records(d, False), records(d, True)).select("factor_id", F.array_join("reasons", "|").alias("reasons"))


@query("l6_input_stats", """SELECT CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, count(*) AS row_count, (count(*) * 2 + count(nullif(o_orderstatus, 'P'))) / (count(*) * 3.0) AS non_null_ratio,
  'o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderstatus:string' AS input_schema FROM orders""", nums="non_null_ratio", dates="first_date last_date")
def _(d):
    o = d.table("orders").select("o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return lb.input_stats(o, "o_orderdate")


@query("l7_table_diff", """WITH a AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT'), b AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
  WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""", dates="")
def _(d):
    o = d.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderpriority <> '1-URGENT'").drop("o_orderpriority")
    b = o.filter("o_orderpriority <> '5-LOW'").drop("o_orderpriority").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")))
    return lb.table_diff(a, b, ["o_orderkey"])


# ---- usage and acceptance ------------------------------------------------------------


def usage(d):
    e = d.table("events")
    return e.select(
        F.col("event_type").alias("model"), (F.col("value") > 2).alias("success"), (F.col("value") < 0.5).alias("blocked"),
        F.floor("value").cast("long").alias("tokens"), (F.col("value") / 1000).alias("cost"), F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
    )


@query("o1_usage_summary", """SELECT event_type AS model, count(*) AS calls, count(CASE WHEN value <= 2 THEN 1 END) AS failures, count(CASE WHEN value < 0.5 THEN 1 END) AS blocked, count(CASE WHEN value <= 2 THEN 1 END) / count(*) AS failure_rate,
  CAST(sum(floor(value)) AS BIGINT) AS tokens, sum(value / 1000) AS cost FROM events GROUP BY 1""", nums="failure_rate cost", dates="")
def _(d):
    return us.usage_summary(usage(d), ["model"])


@query("o2_latency_stats", "SELECT event_type AS model, count(*) AS calls, avg(floor(value * 10)) AS mean_ms, quantile_cont(floor(value * 10), 0.95) AS p95_ms FROM events GROUP BY 1", nums="mean_ms p95_ms", dates="")
def _(d):
    return us.latency_stats(usage(d))


@query("o3_route_errors", """WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS a, CASE o_orderpriority WHEN '1-URGENT' THEN 'field' WHEN '2-HIGH' THEN 'resource' ELSE 'formula' END AS c,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'odd_code' ELSE 'missing_window' END AS code FROM orders), r AS (SELECT *, CASE WHEN a >= 2 THEN 'attempts_exhausted' WHEN c IN ('field', 'resource') THEN 'category_refused' WHEN code = 'odd_code' THEN 'code_not_registered' ELSE 'repairable' END AS reason FROM e)
  SELECT o_orderkey, reason, reason = 'repairable' AS repairable, greatest(0, 2 - a) AS attempts_remaining FROM r""", dates="")
def _(d):
    p = F.col("o_orderpriority")
    e = d.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(3).alias("attempts_used"),
        F.when(p == "1-URGENT", "field").when(p == "2-HIGH", "resource").otherwise("formula").alias("category"), F.when(p == "5-LOW", "odd_code").otherwise("missing_window").alias("code"),
    )
    return us.route_errors(e).select("o_orderkey", "reason", "repairable", "attempts_remaining")


def cases(d):
    doc = d.table("documents").join(d.table("labels"), "doc_id")
    q = lambda *pairs: F.array_compact(F.array(*[F.when(w, n) for w, n in pairs]))
    return doc.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("lang") == "en", "ambiguous").otherwise("concrete").alias("category"), (F.col("n_chars") > 100).alias("parsed"),
        q((F.col("quality") == 0, "growth"), (F.col("toxic") == 1, "direction")).alias("expected"), q((F.col("quality") == 0, "growth"), (F.col("n_chars") > 3000, "direction")).alias("raised"),
        q((F.col("quality") == 1, "get_price"), (F.col("lang") != "de", "calendar")).alias("expected_tools"), q((F.col("lang") != "de", "calendar"), (F.col("n_chars") < 4000, "get_price"), (F.col("n_chars") < 4000, "get_price")).alias("chosen_tools"),
    )


def trees(d):
    """Expected and parsed trees of the cases: heaps of an order's lines. Parsed ones have other node numbers; some differ in a value, an order of arguments, or a missing node."""
    w = Window.partitionBy("l_orderkey")
    li = d.table("lineitem").join(d.table("labels").select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    n = F.row_number().over(w.orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")).cast("long")
    li = li.select(F.col("l_orderkey").alias("spec_id"), n.alias("n"), F.count(F.lit(1)).over(w).alias("m"), F.col("l_returnflag").alias("op"), F.col("l_quantity").alias("value"))
    up = F.when(F.col("n") > 1, F.floor(F.col("n") / 2).cast("long"))
    expected = li.select("spec_id", F.col("n").alias("node_id"), up.alias("parent_id"), (F.col("n") % 2).alias("position"), "op", "value")
    kind, last = F.col("spec_id") % 5, F.col("n") == F.col("m")
    parsed = li.filter(~((kind == 2) & last)).select(
        "spec_id", (100 - F.col("n")).alias("node_id"), (100 - up).alias("parent_id"), F.when(kind == 3, 1 - F.col("n") % 2).otherwise(F.col("n") % 2).alias("position"), "op",
        F.when((kind == 4) & last, F.col("value") + 1).otherwise(F.col("value")).alias("value"),
    )
    return expected, parsed


def scored(d):
    return us.with_tree_match(cases(d), *trees(d), ["op", "value"])


CASES = """WITH RECURSIVE li AS (SELECT l_orderkey AS spec_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS m, l_returnflag AS op, l_quantity AS value FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM labels)
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag)),
  nodes AS (SELECT 'e' AS side, spec_id, n AS id, CASE WHEN n > 1 THEN n // 2 END AS parent, n % 2 AS position, op, value FROM li
    UNION ALL SELECT 'p', spec_id, 100 - n, CASE WHEN n > 1 THEN 100 - n // 2 END, CASE WHEN spec_id % 5 = 3 THEN 1 - n % 2 ELSE n % 2 END, op, CASE WHEN spec_id % 5 = 4 AND n = m THEN value + 1 ELSE value END FROM li WHERE NOT (spec_id % 5 = 2 AND n = m)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY side, spec_id, parent ORDER BY position) AS place FROM nodes),
  ways AS (SELECT side, spec_id, id, 'r' AS way, op, value FROM nodes WHERE parent IS NULL UNION ALL SELECT k.side, k.spec_id, k.id, w.way || '.' || k.place, k.op, k.value FROM ways w JOIN placed k ON k.side = w.side AND k.spec_id = w.spec_id AND k.parent = w.id),
  whole AS (SELECT side, spec_id, string_agg(way || op || value, ';' ORDER BY way) AS tree FROM ways GROUP BY 1, 2),
  c AS (SELECT d.doc_id AS case_id, lang <> 'en' AS concrete, n_chars > 100 AS parsed, e.tree IS NOT DISTINCT FROM p.tree AS good, quality = 1 AS fine, quality = 0 AS eg, toxic = 1 AS ed, quality = 0 AS rg, n_chars > 3000 AS rd, lang, n_chars FROM documents d JOIN labels USING (doc_id)
    LEFT JOIN whole e ON e.side = 'e' AND e.spec_id = d.doc_id LEFT JOIN whole p ON p.side = 'p' AND p.spec_id = d.doc_id),
  s AS (SELECT *, CAST(eg AS INTEGER) + CAST(ed AS INTEGER) AS ne, CAST(rg AS INTEGER) + CAST(rd AS INTEGER) AS nr, CAST(eg AND rg AS INTEGER) + CAST(ed AND rd AS INTEGER) AS nc, ed AND NOT rd AS miss, rd AND NOT ed AS spur FROM c)"""


@query("m1_suite_metrics", f"""{CASES}, f AS (SELECT *, NOT parsed OR (concrete AND NOT good) OR miss OR spur AS bad FROM s)
  SELECT count(*) AS cases, count(CASE WHEN bad THEN 1 END) AS failed, count(CASE WHEN NOT bad THEN 1 END) AS passed, count(CASE WHEN parsed THEN 1 END) / count(*) AS parse_success_rate,
  coalesce(count(CASE WHEN concrete AND parsed AND good THEN 1 END) / nullif(count(CASE WHEN concrete THEN 1 END), 0), 1) AS ast_match_rate, coalesce(sum(nc) / nullif(sum(ne), 0), 1) AS blocking_recall,
  coalesce(sum(nc) / nullif(sum(nr), 0), 1) AS blocking_precision, coalesce(count(CASE WHEN concrete AND nr > 0 THEN 1 END) / nullif(count(CASE WHEN concrete THEN 1 END), 0), 0) AS unnecessary_question_rate,
  count(CASE WHEN miss THEN 1 END) AS missed_cases, count(CASE WHEN spur THEN 1 END) AS spurious_cases FROM f""", nums="parse_success_rate ast_match_rate blocking_recall blocking_precision unnecessary_question_rate", dates="")
def _(d):
    return us.suite_metrics(scored(d))


FAILURES = f"""{CASES}, fa AS (SELECT case_id, 'model' AS kind, 'parse_failed' AS detail FROM s WHERE NOT parsed UNION ALL SELECT case_id, 'model', 'tree_differs' FROM s WHERE parsed AND concrete AND NOT good
  UNION ALL SELECT case_id, 'model', 'missed:direction' FROM s WHERE miss UNION ALL SELECT case_id, 'model', 'spurious:direction' FROM s WHERE spur)"""


@query("m1_failures", f"{FAILURES} SELECT * FROM fa", dates="")
def _(d):
    return us.failures_by_kind(scored(d))


@query("m1_failure_breakdown", f"{FAILURES} SELECT kind, string_split(detail, ':')[1] AS what, count(*) AS failures, count(DISTINCT case_id) AS cases FROM fa GROUP BY 1, 2", dates="")
def _(d):
    return us.failure_breakdown(us.failures_by_kind(scored(d)))


@query("m2_tool_accuracy", f"""{CASES}, t AS (SELECT fine OR lang <> 'de' AS scored, (fine = (n_chars < 4000)) AS same FROM s)
  SELECT coalesce(count(CASE WHEN scored AND same THEN 1 END) / nullif(count(CASE WHEN scored THEN 1 END), 0), 1) AS tool_selection_accuracy, count(CASE WHEN scored THEN 1 END) AS planned_cases FROM t""", nums="tool_selection_accuracy", dates="")
def _(d):
    return us.tool_accuracy(cases(d))
