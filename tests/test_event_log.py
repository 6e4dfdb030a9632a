import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import event_log as el
from panelweave.streaming import events as st

DONE = [
    ("parse_started", {"request": "r1"}), ("formula_proposed", {"factor_spec": "s1"}), ("formula_confirmed", {}), ("field_candidates_found", {"field_candidates": "c1"}),
    ("fields_confirmed", {"field_selections": "f1"}), ("code_generated", {"plan": "p1", "generated_code": "g1", "code_sha256": "h1"}), ("execution_started", {}),
    ("execution_succeeded", {"execution_result": "e1", "artifact_uri": "u1"}), ("validation_passed", {}),
]
ALL = {"request", "factor_spec", "field_candidates", "field_selections", "plan", "generated_code", "code_sha256", "execution_result", "artifact_uri"}


def log(spark, events, session="s"):
    rows = [(session, i + 1, e, p) for i, (e, p) in enumerate(events)]
    return spark.createDataFrame(rows, "session_id string, sequence int, event_type string, payload map<string,string>")


def keys(df):
    return {r.key: r.value for r in df.collect()}


def test_completed_session(spark):
    assert set(keys(el.fold_snapshot(log(spark, DONE)))) == ALL
    got = el.fold_state(log(spark, DONE)).first()
    assert (got.state, got.version, got.illegal_at) == ("completed", 9, None)


@pytest.mark.parametrize("event, lost", [
    ("request_revised", ALL - {"request"}), ("formula_revised", ALL - {"request", "factor_spec"}),
    ("fields_revised", {"plan", "generated_code", "code_sha256", "execution_result", "artifact_uri"}), ("universe_revised", {"plan", "execution_result", "artifact_uri"}),
    ("preprocessing_revised", {"generated_code", "code_sha256", "execution_result", "artifact_uri"}), ("rerun_requested", {"execution_result", "artifact_uri"}),
])
def test_what_a_revision_clears(spark, event, lost):
    assert set(keys(el.fold_snapshot(log(spark, [*DONE, (event, {})])))) == ALL - lost


def test_an_event_clears_before_it_writes(spark):
    got = keys(el.fold_snapshot(log(spark, [*DONE, ("request_revised", {"request": "r2", "plan": "smuggled"})])))
    assert got == {"request": "r2"}


def test_missing_values_do_not_overwrite_and_prefix_is_history(spark):
    assert keys(el.fold_snapshot(log(spark, [*DONE, ("formula_revised", {"factor_spec": None})])))["factor_spec"] == "s1"
    assert set(keys(el.snapshot_at(log(spark, DONE), 4))) == {"request", "factor_spec", "field_candidates"}


def test_illegal_event_is_marked(spark):
    got = el.fold_state(log(spark, [DONE[0], ("execution_started", {}), DONE[1]])).first()
    assert got.state is None and got.illegal_at == 2


def test_every_event_in_the_tables_has_a_transition():
    assert {e for _, e, _ in el.TRANSITIONS} >= set(el.WRITES) | set(el.INVALIDATES)


def test_long_session_equals_a_plain_loop(spark):
    """Far more events than one run of the fold holds."""
    moves = {("a", "x"): "b", ("b", "x"): "a", ("a", "y"): "a", ("b", "y"): "b"}
    rng = random.Random(1)
    names = [rng.choice("xy") for _ in range(5000)]
    state = "a"
    for n in names:
        state = moves[(state, n)]
    rows = spark.createDataFrame([("s", i + 1, n) for i, n in enumerate(names)], "session_id string, sequence int, event_type string")
    table = [(s, e, t) for (s, e), t in moves.items()]
    got = el.fold_state(rows, table, "a").first()
    assert (got.state, got.version) == (state, 5000)
    broken = rows.withColumn("event_type", F.when(F.col("sequence") == 4321, "z").otherwise(F.col("event_type")))
    assert el.fold_state(broken, table, "a").first().illegal_at == 4321


def test_append_conflicts(spark):
    p = [("s", 1, "execution_started", 5), ("s", 2, "rerun_requested", 9), ("s", 3, "rerun_requested", 9), ("t", 4, "parse_started", 0), ("s", 0, "validation_passed", 8)]
    pr = spark.createDataFrame(p, "session_id string, proposal_id int, event_type string, expected_version int")
    got = {r.proposal_id: (r.verdict, r.new_sequence) for r in el.append_conflicts(log(spark, DONE), pr).collect()}
    assert got == {1: ("stale_version", None), 2: ("appended", 10), 3: ("duplicate_version", None), 4: ("unknown_session", None), 0: ("stale_version", None)}


def test_gaps_and_keys(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 3), ("s", 3)], "session_id string, sequence int")
    assert tuple(el.sequence_gaps(rows).first()) == ("s", 3, 1, 1)
    req = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "b")], "id int, x string, y string")
    assert sorted(r.requests for r in el.collapse_requests(req, ["x", "y"], "id").collect()) == [1, 2]


def test_retention(spark):
    files = spark.createDataFrame([("a", "temporary", "2024-01-01", 5), ("b", "temporary", "2024-01-31", 7), ("c", "published_output", "2000-01-01", 9), ("d", "log", "2023-12-01", 2)], "path string, artifact_class string, modified string, bytes int")
    old = el.retention_report(files.withColumn("modified", F.col("modified").cast("timestamp")), F.lit("2024-02-01").cast("timestamp"))
    assert sorted(r.path for r in old.collect()) == ["a", "d"]
    assert {r.artifact_class: r.bytes_reclaimed for r in el.retention_totals(old).collect()} == {"temporary": 5, "log": 2}


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    """State is carried over restarts; repeated events change nothing."""
    events = log(spark, [*DONE, ("formula_revised", {"factor_spec": "s2"})]).union(log(spark, DONE[:3], "t"))
    src, done = str(tmp_path / "in"), events.select("session_id", "sequence", "event_type", "payload")
    latest, changes = {}, []

    def keep(batch, n):
        latest.update({r.session_id: (r.state, r.version) for r in batch.collect()})

    def keep_snap(batch, n):
        changes.extend(batch.collect())

    for part in ("sequence <= 4", "sequence BETWEEN 4 AND 7", "sequence > 7"):
        done.filter(part).write.mode("append").parquet(src)
        stream = st.follow(spark, src, done.schema)
        st.drain_updates(st.stream_states(stream), keep, str(tmp_path / "c1"))
        st.drain_updates(st.stream_fold(stream), keep_snap, str(tmp_path / "c2"))
    assert latest == {r.session_id: (r.state, r.version) for r in el.fold_state(events).collect()}
    sent = spark.createDataFrame(changes, "session_id string, key string, value string, set_at int, version int, deleted boolean")
    assert any(r.deleted for r in changes)
    assert sorted(st.latest_snapshot(sent).collect()) == sorted(el.fold_snapshot(events).collect())
