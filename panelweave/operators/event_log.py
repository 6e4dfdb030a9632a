"""Session event logs: snapshots, states, conflicts, gaps, request keys, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: event | snapshot keys it may set | keys it clears before it sets its own
KEYS = """
    parse_started | request |
    clarification_requested | ambiguities clarifications factor_spec |
    clarification_resolved | ambiguities clarifications factor_spec |
    formula_proposed | factor_spec |
    formula_confirmed | factor_spec |
    field_candidates_found | field_candidates |
    fields_confirmed | field_selections |
    code_generated | plan generated_code code_sha256 |
    execution_succeeded | execution_result artifact_uri |
    validation_passed | execution_result artifact_uri |
    execution_failed | execution_result artifact_uri last_error |
    validation_failed | execution_result artifact_uri last_error |
    repair_proposed | factor_spec |
    request_revised | request | ambiguities clarifications factor_spec field_candidates field_selections plan generated_code code_sha256 execution_result artifact_uri last_error
    formula_revised | factor_spec | field_candidates field_selections plan generated_code code_sha256 execution_result artifact_uri last_error
    fields_revised | field_selections | plan generated_code code_sha256 execution_result artifact_uri last_error
    universe_revised | request | plan execution_result artifact_uri last_error
    date_range_revised | request | plan execution_result artifact_uri last_error
    preprocessing_revised | factor_spec | generated_code code_sha256 execution_result artifact_uri last_error
    time_convention_revised | factor_spec | plan generated_code code_sha256 execution_result artifact_uri last_error
    session_cloned | request factor_spec | ambiguities clarifications field_candidates field_selections plan generated_code code_sha256 execution_result artifact_uri last_error
    execution_cancelled |  | execution_result artifact_uri
    rerun_requested |  | execution_result artifact_uri last_error
"""
# fixed values: state, event, next state
MOVES = """
    created                       parse_started            parsing_input
    created                       session_cloned           waiting_formula_confirmation
    parsing_input                 clarification_requested  needs_clarification
    parsing_input                 formula_proposed         waiting_formula_confirmation
    needs_clarification           clarification_resolved   parsing_input
    needs_clarification           formula_proposed         waiting_formula_confirmation
    needs_clarification           request_revised          parsing_input
    waiting_formula_confirmation  formula_confirmed        searching_fields
    waiting_formula_confirmation  request_revised          parsing_input
    waiting_formula_confirmation  formula_revised          waiting_formula_confirmation
    searching_fields              field_candidates_found   waiting_field_confirmation
    searching_fields              formula_revised          waiting_formula_confirmation
    waiting_field_confirmation    fields_confirmed         planning_functions
    waiting_field_confirmation    request_revised          parsing_input
    waiting_field_confirmation    formula_revised          waiting_formula_confirmation
    waiting_field_confirmation    fields_revised           waiting_field_confirmation
    waiting_field_confirmation    universe_revised         planning_functions
    waiting_field_confirmation    date_range_revised       planning_functions
    waiting_field_confirmation    preprocessing_revised    planning_functions
    waiting_field_confirmation    time_convention_revised  planning_functions
    planning_functions            code_generated           code_ready
    planning_functions            request_revised          parsing_input
    planning_functions            formula_revised          waiting_formula_confirmation
    planning_functions            fields_revised           waiting_field_confirmation
    planning_functions            universe_revised         planning_functions
    planning_functions            date_range_revised       planning_functions
    planning_functions            preprocessing_revised    planning_functions
    planning_functions            time_convention_revised  planning_functions
    code_ready                    execution_started        executing
    code_ready                    request_revised          parsing_input
    code_ready                    formula_revised          waiting_formula_confirmation
    code_ready                    fields_revised           waiting_field_confirmation
    code_ready                    universe_revised         planning_functions
    code_ready                    date_range_revised       planning_functions
    code_ready                    preprocessing_revised    planning_functions
    code_ready                    time_convention_revised  planning_functions
    executing                     execution_succeeded      validating
    executing                     execution_failed         failed
    executing                     execution_cancelled      code_ready
    validating                    validation_passed        completed
    validating                    validation_failed        failed
    completed                     rerun_requested          code_ready
    completed                     request_revised          parsing_input
    completed                     formula_revised          waiting_formula_confirmation
    completed                     fields_revised           waiting_field_confirmation
    completed                     universe_revised         planning_functions
    completed                     date_range_revised       planning_functions
    completed                     preprocessing_revised    planning_functions
    completed                     time_convention_revised  planning_functions
    failed                        repair_proposed          waiting_formula_confirmation
    failed                        code_generated           code_ready
    failed                        rerun_requested          code_ready
    failed                        request_revised          parsing_input
    failed                        formula_revised          waiting_formula_confirmation
    failed                        fields_revised           waiting_field_confirmation
    failed                        universe_revised         planning_functions
    failed                        date_range_revised       planning_functions
    failed                        preprocessing_revised    planning_functions
    failed                        time_convention_revised  planning_functions
"""


def _keys(column: int) -> dict[str, list[str]]:
    rows = [[part.split() for part in line.split("|")] for line in KEYS.strip().splitlines()]
    return {row[0][0]: row[column] for row in rows if row[column]}


WRITES, INVALIDATES = _keys(1), _keys(2)
TRANSITIONS = [tuple(line.split()) for line in MOVES.strip().splitlines()]

DAY = 86_400
# fixed values: days each class of file is kept; None is for ever
RETENTION_DAYS = {
    "temporary": 1, "extracted_text": 7, "input_parquet": 14, "output_parquet": 30, "log": 30, "error_artifact": 30,
    "uploaded_pdf": 90, "exported_code": 90, "published_output": None,
}
CHUNK_BITS = 10


def _pairs(table: dict[str, list[str]]) -> Column:
    """Event -> keys as a literal map."""
    return F.create_map(*[x for e, keys in table.items() for x in (F.lit(e), F.array(*[F.lit(k) for k in keys]))])


def fold_keys(events: DataFrame, writes=WRITES, invalidates=INVALIDATES, session: str = "session_id") -> DataFrame:
    """Every snapshot key per session that was ever touched: value, the event that set it, and whether it is cleared.

    ``version`` is the last event that set or cleared the key; it only grows as events arrive, in any
    order, so of several states of a key the one with the highest version is the newest.

    ``events(session, sequence, event_type, payload MAP<STRING,STRING>)``. A key survives if its last
    non-missing write is not older than its last clearing; an event clears before it writes. Both
    come from one grouping by (session, key) that is reduced on the map side, so the length of a
    session does not matter.
    """
    cleared = F.coalesce(F.try_element_at(_pairs(invalidates), F.col("event_type")), F.array().cast("array<string>"))
    written = F.coalesce(F.try_element_at(_pairs(writes), F.col("event_type")), F.array().cast("array<string>"))
    touched = events.select(
        F.col(session), "sequence", "payload",
        F.explode(F.concat(
            F.transform(cleared, lambda k: F.struct(k.alias("key"), F.lit(True).alias("clear"))),
            F.transform(written, lambda k: F.struct(k.alias("key"), F.lit(False).alias("clear"))),
        )).alias("_k"),
    )
    value = F.when(~F.col("_k.clear"), F.try_element_at("payload", F.col("_k.key")))
    rows = touched.select(session, "sequence", F.col("_k.key").alias("key"), F.col("_k.clear").alias("clear"), value.alias("value"))
    kept = rows.groupBy(session, "key").agg(
        F.max_by(F.struct("value", "sequence"), F.when(F.col("value").isNotNull(), F.col("sequence"))).alias("_w"),
        F.max(F.when(F.col("clear"), F.col("sequence"))).alias("_c"),
    )
    alive = F.coalesce(F.col("_w.value").isNotNull() & (F.col("_c").isNull() | (F.col("_w.sequence") >= F.col("_c"))), F.lit(False))
    return kept.select(
        session, "key", F.when(alive, F.col("_w.value")).alias("value"), F.when(alive, F.col("_w.sequence")).alias("set_at"),
        F.greatest("_w.sequence", "_c").alias("version"), (~alive).alias("deleted"),
    )


def fold_snapshot(events: DataFrame, writes=WRITES, invalidates=INVALIDATES, session: str = "session_id") -> DataFrame:
    """Current value of every snapshot key per session; cleared keys are left out."""
    return fold_keys(events, writes, invalidates, session).filter("not deleted").select(session, "key", "value", "set_at")


def state_names(transitions) -> list[str]:
    names = []
    for s, _, to in transitions:
        names += [n for n in (s, to) if n not in names]
    return names


def fold_state(events: DataFrame, transitions=TRANSITIONS, start: str = "created", session: str = "session_id") -> DataFrame:
    """State of every session after all its events, and the first illegal event if there is one.

    A run of events acts on states as a function: for every state it could start in, the state it
    ends in. Such functions compose, so a long session is folded in runs of 1024 sequence
    numbers, then in runs of runs, and no task ever holds a whole session. Position 0 is the
    dead state of an illegal event, which remembers nothing but its sequence number.
    """
    states = state_names(transitions)
    at = {s: i + 1 for i, s in enumerate(states)}
    moves: dict[str, list[int]] = {}
    for s, e, to in transitions:
        moves.setdefault(e, [0] * len(states))[at[s] - 1] = at[to]
    # Events travel as small numbers; the last row of the table is for unknown events.
    number = F.create_map(*[x for i, e in enumerate(moves) for x in (F.lit(e), F.lit(i + 1))])
    table = F.array(*[F.array(*[F.lit(i) for i in row]) for row in [*moves.values(), [0] * len(states)]])
    coded = F.coalesce(F.try_element_at(number, F.col("event_type")), F.lit(len(moves) + 1))
    runs = events.select(session, F.col("sequence").cast("long").alias("_seq"), coded.alias("_e"))
    ordered = F.array_sort(F.collect_list(F.struct("_seq", "_e")))

    def apply(acc, s):
        end = lambda a: F.try_element_at(F.try_element_at(table, s["_e"]), F.greatest(a["to"], F.lit(1)))
        return F.transform(acc, lambda a: F.when(a["to"] == 0, a).otherwise(
            F.struct(end(a).alias("to"), F.when(end(a) == 0, s["_seq"]).alias("bad"))))

    run = F.shiftright("_seq", CHUNK_BITS).alias("_run")
    runs = runs.groupBy(session, run).agg(F.aggregate(ordered, _same(len(states)), apply).alias("_f")).withColumnRenamed("_run", "_seq")
    for _ in range(2):
        runs = _compose(runs.withColumn("_run", F.shiftright("_seq", CHUNK_BITS)), [session, "_run"], len(states)).withColumnRenamed("_run", "_seq")
    whole = _compose(runs, [session], len(states))
    end = F.element_at("_f", at[start])
    name = F.array(*[F.lit(s) for s in states])
    sizes = events.groupBy(session).agg(F.max("sequence").alias("version"))
    return whole.select(session, F.when(end["to"] > 0, F.try_element_at(name, end["to"])).alias("state"), end["bad"].alias("illegal_at")).join(sizes, session)


def _same(n: int) -> Column:
    """The function that leaves every state as it is."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("to"), F.lit(None).cast("long").alias("bad")))


def _compose(runs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One function per key out of the functions of its runs, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("_seq", "_f")))
    folded = F.aggregate(
        F.transform(ordered, lambda s: s["_f"]), _same(n),
        lambda acc, f: F.transform(acc, lambda a: F.when(a["to"] == 0, a).otherwise(F.try_element_at(f, F.greatest(a["to"], F.lit(1))))),
    )
    return runs.groupBy(*keys).agg(folded.alias("_f"))


def snapshot_at(events: DataFrame, version: int, writes=WRITES, invalidates=INVALIDATES, session: str = "session_id") -> DataFrame:
    """The snapshot as it was after the event number ``version``."""
    return fold_snapshot(events.filter(F.col("sequence") <= version), writes, invalidates, session)


def append_conflicts(events: DataFrame, proposals: DataFrame, transitions=TRANSITIONS, start: str = "created", session: str = "session_id") -> DataFrame:
    """Verdict per proposed event ``(session, proposal_id, event_type, expected_version)``.

    Proposals are taken in id order. Unknown session, stale version, duplicate (the version has been
    taken by an earlier proposal), illegal move, in this order. An illegal proposal writes nothing,
    so the first legal one for the current version is appended.
    """
    heads = fold_state(events, transitions, start, session)
    legal = F.create_map(*[F.lit(x) for s, e, to in transitions for x in (f"{s}|{e}", to)])
    to = F.try_element_at(legal, F.concat_ws("|", "state", "event_type"))
    known = proposals.join(heads, session, "left")
    able = (F.col("expected_version") == F.col("version")) & F.col("state").isNotNull() & to.isNotNull()
    first = known.filter(able).groupBy(session).agg(F.min("proposal_id").alias("_first"))
    p = known.join(first, session, "left")
    verdict = (
        F.when(F.col("version").isNull(), "unknown_session").when(F.col("expected_version") != F.col("version"), "stale_version")
        .when(F.col("proposal_id") > F.col("_first"), "duplicate_version").when(F.col("state").isNull() | to.isNull(), "illegal_transition").otherwise("appended")
    )
    return p.select(session, "proposal_id", verdict.alias("verdict"), F.when(verdict == "appended", F.col("version") + 1).alias("new_sequence"))


def sequence_gaps(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session: events, distinct numbers, duplicates and missing numbers below the highest.

    Numbers start at 1. (session, sequence) pairs are reduced first, so nothing is collected.
    """
    pairs = events.groupBy(session, "sequence").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy(session).agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("numbers"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("sequence").alias("last")
    )
    return per.select(session, "events", "duplicates", (F.col("last") - F.col("numbers")).alias("missing"))


def idempotency_key(df: DataFrame, cols: list[str], out: str = "request_key") -> DataFrame:
    """SHA-256 of the columns joined by a bar; a missing column counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return df.withColumn(out, F.sha2(F.concat_ws("|", *parts), 256))


def collapse_requests(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """One row per request key: how often it was asked and the first asker."""
    keyed = idempotency_key(df, cols)
    return keyed.groupBy("request_key").agg(F.count(F.lit(1)).alias("requests"), F.min(order).alias("first_request"))


def retention_report(files: DataFrame, now: Column, limits=RETENTION_DAYS) -> DataFrame:
    """Expired files: older than their class allows. ``files(path, artifact_class, modified, bytes)``."""
    kept_days = F.create_map(*[x for c, d in limits.items() if d is not None for x in (F.lit(c), F.lit(d))])
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    limit = F.try_element_at(kept_days, F.col("artifact_class")) * DAY
    return files.withColumns({"age_seconds": age, "_limit": limit}).filter(F.col("_limit").isNotNull() & (F.col("age_seconds") > F.col("_limit"))).drop("_limit")


def retention_totals(expired: DataFrame) -> DataFrame:
    return expired.groupBy("artifact_class").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes_reclaimed"))
