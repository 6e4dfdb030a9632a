"""Streams whose events come late, twice or never."""

import random

import numpy as np
import pytest

from panelweave.operators import event_log as el
from panelweave.streaming import events as st
from panelweave.streaming.runs import Moves, Runs

MOVES = [("created", "go", "on"), ("on", "stay", "on"), ("on", "stop", "off"), ("off", "go", "on"), ("off", "stay", "off"), ("created", "stay", "created")]


def walked(events):
    """State and first illegal number of (number, event) pairs in order."""
    table = {(s, e): t for s, e, t in MOVES}
    state = "created"
    for n, e in sorted(events):
        state = table.get((state, e))
        if state is None:
            return None, n
    return state, None


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_one_function_once_gaps_close(seed):
    rng = random.Random(seed)
    m = Moves(MOVES, "created")
    events = [(n, rng.choice(["go", "stay", "stay", "stop", "unknown"] if seed else ["stay"])) for n in range(1, 200)]
    late = events[:]
    rng.shuffle(late)
    runs, seen = Runs(m), []
    while late:
        part, late = late[:23], late[23:]
        again = part + rng.sample(seen, min(len(seen), 5))
        runs.add(np.array([n for n, _ in again]), [e for _, e in again])
        seen += part
        assert runs.count == len(seen) and (runs.first[1:] > runs.last[:-1] + 1).all()
        runs = Runs(m, *runs.row())
        to, bad = m.all_of(runs.to, runs.bad)
        state, illegal = walked(seen)
        assert m.names[to[0, m.start]] == state and (bad[0, m.start] if bad[0, m.start] >= 0 else None) == illegal
    assert len(runs.first) == 1


class Kept:
    """A session's state in memory, as a value and as a map; counts what is asked of it."""

    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    def __getattr__(self, name):
        self.asked += 1
        return {
            "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k],
            "updateValue": lambda k, v: self.map.update({k: v}), "removeKey": lambda k: self.map.pop(k), "iterator": lambda: iter(self.map.items()), "clear": lambda: self.map.clear(),
        }[name]


def test_a_session_of_few_chunks_is_read_and_written_once_a_batch():
    from pyspark.sql import Row

    from panelweave.streaming.runs import CHUNK, FEW_CHUNKS, RunStates

    rng = random.Random(6)
    event = Row("session", "sequence", "event_type")
    for top in (60, CHUNK * (FEW_CHUNKS + 3)):
        numbers = [*range(-5, top + 1), None]
        events = {n: rng.choice(["stay", "go"] if n == 1 else ["stay"]) for n in numbers}
        rng.shuffle(numbers)
        numbers.sort(key=lambda n: n is not None and n % 7 == 1)  # these come last
        state = RunStates("session", MOVES, "created")
        state.whole, state.open = Kept(), Kept()
        seen, cut, mapped = [], [0, len(numbers) // 5, len(numbers) // 2, len(numbers)], []
        for a, b in zip(cut, cut[1:]):
            part = numbers[a:b] + numbers[: min(a, 9)]
            seen += numbers[a:b]
            before = state.whole.asked + state.open.asked
            (got,) = state.handleInputRows(("s",), iter([event("s", n, events[n]) for n in part]), None)
            there = sorted((n, events[n]) for n in seen if n is not None)
            want, illegal = walked(there)
            assert (got.session, got.state, got.illegal_at, got.version) == ("s", want, illegal, there[-1][0])
            assert got.missing == there[-1][0] - sum(n > 0 for n, _ in there)
            mapped.append(bool(state.open.map))
            assert top > 60 or state.whole.asked + state.open.asked - before == 2
        assert mapped == [top > 60] * 2 + [False]


def test_stream_of_late_numbers_is_the_batch_fold(spark, tmp_path):
    """Over several chunks; one session never gets number 1500, one gets all of it last of all."""
    rng = random.Random(3)
    rows = []
    for session, lost in (("a", 1500), ("b", None), ("c", None)):
        state = "created"
        for n in range(1, 2600 if session != "c" else 4):
            event = rng.choice([e for s, e, _ in MOVES if s == state]) if (session, n) != ("b", 2400) else "wrong"
            state = {(s, e): t for s, e, t in MOVES}.get((state, event), state)
            if n != lost:
                rows.append((session, n, event))
    rng.shuffle(rows)
    cut = [[r for r in rows if r[1] > 1100 and r[0] != "c"], [r for r in rows if r[1] <= 40 or r[0] == "c"], [r for r in rows if 40 < r[1] <= 1100 and r[0] != "c"] + rows[:50]]
    schema = "session_id string, sequence long, event_type string"
    got = {}
    for k, part in enumerate(cut):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = st.follow(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        st.drain_updates(st.stream_states(stream, MOVES), lambda b, n: got.update({r.session_id: r for r in b.collect()}), f"{tmp_path}/cp")
        seen = [r for p in cut[: k + 1] for r in p]
        want = {r.session_id: r for r in el.fold_state(spark.createDataFrame(sorted(set(seen)), schema), MOVES).collect()}
        assert {s: (r.state, r.illegal_at, r.version) for s, r in got.items()} == {s: (r.state, r.illegal_at, r.version) for s, r in want.items()}
        assert {s: r.missing for s, r in got.items()} == {s: max(n for x, n, _ in seen if x == s) - len({n for x, n, _ in seen if x == s}) for s in got}
    assert got["a"].missing == 1 and got["b"].illegal_at == 2400 and got["c"].missing == 0


def test_heartbeat_of_batches_and_of_idle_drains(spark, tmp_path):
    """Several batches in a drain, an idle one, a late lower number, and a number that is missing."""
    schema = "session_id string, sequence long, event_type string"
    empty = spark.createDataFrame([], schema).schema
    beats = f"{tmp_path}/beats"

    def drain(n, rows=None, **kw):
        for r in rows or []:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.drain_watched(st.follow(spark, f"{tmp_path}/in", empty, **kw), f"{tmp_path}/out", f"{tmp_path}/cp", f"{beats}/drain={n}", beats if n else None)
        return [tuple(r) for r in spark.read.parquet(f"{beats}/drain={n}").orderBy("batch").select("batch", "events", "last", "idle").collect()]

    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert drain(0) in ([(None, 0, None, True)], [(0, 0, None, True)])
    got = drain(1, [("a", 5, "x"), ("a", 7, "x")], files_per_trigger=1)
    assert [g[1] for g in got] == [1, 1] and got[-1][2] == 7
    assert not any(g[3] for g in got)
    at = got[-1][0]
    assert drain(2) == [(at, 0, 7, True)]
    assert [g[1:] for g in drain(3, [("a", 6, "x"), ("b", None, "x")])] == [(2, 7, False)]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
