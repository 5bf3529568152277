"""Streams over files: windows with watermarks, deduplication, joins, and per-key state."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from velarium.session import is_folder, scratch_dir

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: A time after all others: an event of it moves the watermark past all windows there are.
END = "2200-01-01 00:00:00"


def read_events(spark: SparkSession, path: str, late: str = "1 day", tail: str | None = None, files: int = 1000) -> DataFrame:
    """A stream of event files with a watermark, so many files a batch. Times without a zone become UTC, as watermarks ask for.

    tail: a folder of new_tail(), for a log that ends: once all files are read, run_now() puts an event of time END
    there. Windows before it end, and are put out in append mode, whose state is only that of open windows; its own never ends.
    """
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files)
    if not is_folder(spark, path):  # a stream reads folders
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    raw = reader.parquet(path)
    if tail:
        raw = raw.unionByName(spark.readStream.schema(EVENTS).parquet(tail))
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def new_tail(spark: SparkSession) -> str:
    """An empty folder for the event that ends a log."""
    path = f"{scratch_dir(spark)}/stream-end-{uuid.uuid4().hex}"
    spark.createDataFrame([], EVENTS).write.parquet(path)
    return path


def end(spark: SparkSession, tail: str) -> None:
    spark.sql(f"SELECT -1L AS event_id, TIMESTAMP_NTZ '{END}' AS ts, -1L AS user_id, 'end' AS event_type, CAST(0 AS DOUBLE) AS value, '' AS props").write.mode("append").parquet(tail)


def run_now(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), tail: str | None = None, base: str | None = None, store: str | None = None) -> DataFrame:
    """Run a stream over all there is now and return what it wrote.

    append: rows as they are put out. complete: the last result replaces the one before. update: rows replace those
    with equal keys of earlier batches. Batches of the last two are kept under their numbers, so a batch that
    runs again replaces itself. tail: the log ends here (see read_events). base: the folder of an earlier run, to go on
    from where that one stopped. store: the class of the state store, where it isn't the session's.
    """
    spark = stream.sparkSession
    usual = spark.conf.get(_STORE)
    base = base or f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def run() -> None:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", f"{base}/out").start()
        else:
            query = writer.foreachBatch(keep_batch(base)).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    spark.conf.set(_STORE, store or usual)
    try:
        run()
        if tail:
            end(spark, tail)
            run()
    finally:
        spark.conf.set(_STORE, usual)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    batches = spark.read.schema(f"{_fields(stream)}, __batch long").parquet(f"{base}/out")
    if mode == "complete":
        last = batches.agg(F.max("__batch")).first()[0]
        return batches.where(F.col("__batch") == F.lit(last)).drop("__batch")
    others = [c for c in stream.columns if c not in keys]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last")).select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in stream.columns])


def _fields(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)


def keep_batch(base: str):
    """A sink for foreachBatch that keeps each batch under its number; a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/__batch={number}")

    return write


def tumbling(events: DataFrame, size: str) -> DataFrame:
    w = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    w = events.groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def rolling_by_user(events: DataFrame, size: str, step: str) -> DataFrame:
    """Events of each user in each sliding window."""
    w = events.groupBy(F.window("ts", size, step), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


#: Which state an event leads to, from which state; others break the order.
STEPS = {"signup": (None, "NEW"), "view": ("NEW", "ACTIVE"), "purchase": ("ACTIVE", "BUYER")}
#: A user's state is forgotten so long after the last event, by the watermark.
IDLE_MS = 90 * 86_400_000


def follow(state: str | None, n: int, broken: int, kinds: Iterable[str]) -> tuple[str | None, int, int]:
    """A user's state, steps and breaks after events in their order."""
    for kind in kinds:
        if kind in STEPS:
            before, after = STEPS[kind]
            if state == before:
                state, n = after, n + 1
            else:
                broken += 1
    return state, n, broken


class InOrder(StatefulProcessor):
    """Holds a user's events back until the watermark has passed them, then takes them in the order of time and id: however they were cut into batches and in whatever order they came, each user goes through the same states.

    A timer stands at the earliest event held back, or, where none is, at the end of the idle time. Events of a batch are held
    as one row, as each row is a call to the store; times are microseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at array<long>, event_id array<long>, event_type array<string>")
        self.state = handle.getValueState("state", "state string, n long, broken long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if parts:
            at = [x for p in parts for x in p["at"].tolist()]
            self.held.appendValue((at, [x for p in parts for x in p["event_id"].tolist()], [x for p in parts for x in p["event_type"].tolist()]))
            self._wake_at(min(at) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((e for r in self.held.get() for e in zip(*r, strict=True)), key=lambda e: e[:2])
        due = [e for e in held if e[0] // 1000 <= passed]
        left = held[len(due) :]
        if not held:
            self.state.clear()  # idle
            return
        if left:
            self.held.put([tuple(map(list, zip(*left, strict=True)))])
            self._wake_at(left[0][0] // 1000)
        else:
            self.held.clear()
        if due:
            now = follow(*(self.state.get() or (None, 0, 0)), (e[2] for e in due))
            self.state.update(now)
            if not left:
                self._wake_at(max(due[-1][0] // 1000 + IDLE_MS, passed + 1))
            yield pd.DataFrame({"user_id": [key[0]], "state": [now[0]], "n": [now[1]], "broken": [now[2]]})

    def _wake_at(self, millis: int) -> None:
        self.handle.registerTimer(millis)

    def close(self) -> None:
        pass


def state_machine(events: DataFrame) -> DataFrame:
    """user_id, state, n, broken: where each user stands after the events that the watermark has passed, how many moved them, and how many came out of order. Put out in update mode, a row for each change; see InOrder. Run it with a store that has lists and timers (store=ROCKSDB)."""
    keyed = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "event_type").groupBy("user_id")
    return keyed.transformWithStateInPandas(InOrder(), "user_id long, state string, n long, broken long", "update", "EventTime")
