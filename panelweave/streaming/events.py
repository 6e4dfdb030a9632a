"""Streaming forms of the event-log operators."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from panelweave.operators.event_log import INVALIDATES, TRANSITIONS, WRITES, fold_keys, idempotency_key


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New event files of a folder as a stream. The checkpoint of the query is the resume cursor."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into Parquet, then stop: the replay-only form."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


class Heartbeat(StreamingQueryListener):
    """The triggers of one running query as rows: batch, time, events read, greatest number read.

    Spark reports a trigger once; what is kept is a row per batch and never events. The greatest number is observed
    while the batch is processed, so it costs no job of its own.
    """

    OBSERVED = "heartbeat"
    SCHEMA = "batch long, at timestamp, events long, last long, idle boolean"

    def __init__(self) -> None:
        self.seen: list[tuple] = []
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    @classmethod
    def watch(cls, stream: DataFrame, number: str) -> DataFrame:
        return stream.observe(cls.OBSERVED, F.count(F.lit(1)).alias("events"), F.max(F.col(number).cast("long")).alias("last"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.changed:
            self.seen.append((str(p.runId), p.batchId, p.timestamp, p.observedMetrics.get(self.OBSERVED)))

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, run: str, timeout: float) -> list[tuple]:
        """Rows of the run's batches, once Spark has said that it ended."""
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, timeout):
                raise TimeoutError(f"no end of stream {run} was reported within {timeout} s")
            found = {}
            for r, batch, at, seen in self.seen:
                if r == run:
                    events = seen["events"] if seen else 0
                    # A batch may be followed by a trigger of the same number that reads nothing.
                    if batch not in found or events:
                        found[batch] = (batch, dt.datetime.fromisoformat(at.replace("Z", "+00:00")), events, seen["last"] if seen else None)
            return [found[b] for b in sorted(found)]


def drain_watched(stream: DataFrame, path: str, checkpoint: str, beats: str, earlier: str | None = None, number: str = "sequence", timeout: float = 60.0) -> None:
    """As ``drain``, and writes what a client that follows would be told: ``(batch, at, events, last, idle)``.

    A row for each batch with events, with the greatest ``number`` sent so far. A drain that finds nothing new
    still gives one row, ``idle``, with the batch and number it stands at; these come from the ``earlier``
    heartbeats of the same checkpoint (NULL where there are none).
    """
    spark = stream.sparkSession
    listener = Heartbeat()
    spark.streams.addListener(listener)
    try:
        q = Heartbeat.watch(stream, number).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        q.awaitTermination()
        rows = listener.of(str(q.runId), timeout)
    finally:
        spark.streams.removeListener(listener)
    stand = (None, None)
    if earlier:
        stand = tuple(spark.read.schema(Heartbeat.SCHEMA).parquet(earlier).agg(F.max("batch"), F.max("last")).first())
    out, last = [], stand[1]
    for batch, at, events, top in rows:
        if events:
            last = max(x for x in (last, top) if x is not None) if (last, top) != (None, None) else None
            out.append((batch, at, events, last, False))
    if not out:
        out = [(stand[0], dt.datetime.now(dt.timezone.utc), 0, last, True)]
    spark.createDataFrame(out, Heartbeat.SCHEMA).coalesce(1).write.parquet(beats)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain_updates(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """As ``drain`` for results that are updated: ``write`` gets each batch's changed rows.

    State is kept in RocksDB, which keyed maps of a state need; the session's own setting comes back afterwards.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        _drained(stream, write, checkpoint)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def _drained(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def stream_fold(stream: DataFrame, writes=WRITES, invalidates=INVALIDATES, session: str = "session_id") -> DataFrame:
    """Snapshot keys over a stream, in update mode: the columns of ``fold_keys``, a row for each key that a batch touched.

    A cleared key comes out as ``deleted``, so that the sink can retract it; ``latest_snapshot`` reduces
    what has come out so far. The batch fold is a pair of keyed maxima, so the stream is the same grouping with state: one
    small row per (session, key), kept by Spark and never a session's events.
    """
    return fold_keys(stream, writes, invalidates, session)


def latest_snapshot(changes: DataFrame, session: str = "session_id") -> DataFrame:
    """The snapshot that the rows sent by ``stream_fold`` lead to: the newest state of each key, unless deleted."""
    newest = changes.groupBy(session, "key").agg(F.max_by(F.struct("value", "set_at", "deleted"), "version").alias("s"))
    return newest.filter("not s.deleted").select(session, "key", "s.value", "s.set_at")


def stream_states(stream: DataFrame, transitions=TRANSITIONS, start: str = "created", session: str = "session_id") -> DataFrame:
    """State machine over a stream, for ``drain_updates``: a row ``(session, state, version, illegal_at, missing)`` for each session that a batch touched.

    Numbers may come late, twice, or never; the state is that of all numbers seen so far in their order,
    as in ``fold_state``, and ``missing`` says how many below ``version`` have not come. What Spark keeps for
    a session are transition functions of runs of neighbouring numbers (``RunStates``), never its events.
    """
    from panelweave.streaming.runs import RunStates

    key = stream.schema[session].dataType.simpleString()
    return stream.select(session, F.col("sequence").cast("long").alias("sequence"), "event_type").groupBy(session).transformWithState(
        RunStates(session, transitions, start), f"{session} {key}, state string, version long, illegal_at long, missing long", "Update", "None",
    )


def stream_dedup(stream: DataFrame, cols: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Requests with an equal key inside the delay are passed once."""
    keyed = idempotency_key(stream.withColumn(ts, F.col(ts).cast("timestamp")), cols)
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_key"])


def stream_panel(stream: DataFrame, delay: str, code: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """Daily panel from events; a day is sent once the watermark has passed its end, and until then is among ``open_days``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    daily = timed.groupBy(F.window(ts, "1 day").alias("_w"), F.col(code).alias("code")).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("events"))
    return daily.select(F.col("_w.start").cast("date").alias("date"), "code", "value", "events")


def open_days(spark: SparkSession, checkpoint: str, code: str = "user_id") -> DataFrame:
    """The days of ``stream_panel`` that the watermark still holds back, read from the state that the last drain left."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.window.start").cast("date").alias("date"), F.col(f"key.{code}").alias("code"), F.col("value.sum").alias("value"), F.col("value.count").alias("events"))


def open_sessions(spark: SparkSession, checkpoint: str, user: str = "user_id") -> DataFrame:
    """The sessions of ``stream_sessions`` that may still grow, with the end they have so far."""
    state = spark.read.format("statestore").load(checkpoint)
    w = "value.session_window"
    return state.select(F.col(f"key.{user}").alias(user), F.col(f"{w}.start").alias("start"), F.col(f"{w}.end").alias("end"), F.col("value.count").alias("events"), F.col("value.sum").alias("value"))


def stream_sessions(stream: DataFrame, gap: str, delay: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Activity sessions: events of a user with no pause longer than the gap; those not closed yet are among ``open_sessions``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    s = timed.groupBy(F.session_window(ts, gap).alias("_w"), user).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return s.select(user, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events", "value")
