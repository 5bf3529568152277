"""Streams, run over all files there are; batch SQL is the oracle where one exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.registry import query
from velarium.session import scratch_dir, table
from velarium.sources import log
from velarium.streaming import streams as S


def _events(spark: SparkSession, sf_dir: str, tail: str | None = None) -> DataFrame:
    return S.read_events(spark, f"{sf_dir}/events.parquet", tail=tail)


def _to_the_end(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str = "append", keys: tuple[str, ...] = (), store: str | None = None) -> DataFrame:
    """What a stream over the events puts out once the log has ended."""
    tail = S.new_tail(spark)
    return _plain(S.run_now(make(_events(spark, sf_dir, tail)), mode, keys, tail, store=store))


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the tables."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_the_end(spark, sf_dir, lambda events: S.tumbling(events, "6 hours"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 DAY AS start, event_type, count(*) AS n FROM events, range(0, 3) t(k) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_the_end(spark, sf_dir, lambda events: S.sliding(events, "3 days", "1 day"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_the_end(spark, sf_dir, lambda events: S.sessions(events, "12 hours"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is delivered twice is appended once; ids are kept for as long as late events may come."""
    log = _events(spark, sf_dir)
    twice = log.unionByName(_events(spark, sf_dir))
    return S.run_now(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 DAY AS start, user_id, count(*) AS n FROM events, range(0, 30) t(k) WHERE event_type = 'error' GROUP BY 1, 2")
def stream_rolling_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of one sort in the thirty days from each day."""
    return _to_the_end(spark, sf_dir, lambda events: S.rolling_by_user(events.where("event_type IN ('error', 'end')"), "30 days", "1 day"))


@query("SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _events(spark, sf_dir).where("event_type = 'purchase'")
    return S.run_now(bought.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "user_id", "c_mktsegment"))


@query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within two hours of a view; both sides have watermarks, so state ends."""
    views = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("seen"))
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    return S.run_now(views.join(bought, F.expr("u = user_id AND ts >= seen AND ts <= seen + INTERVAL 2 HOURS")).select("view_id", "purchase_id"))


@query("SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; open ones aren't put out."""
    return _plain(S.run_now(S.tumbling(_events(spark, sf_dir), "1 day"), "append"))


_MOVES = "WITH a AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS one FROM events), b AS (SELECT *, min(CASE WHEN event_type = 'view' AND (ts, event_id) > one THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS two FROM a), c AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND (ts, event_id) > two THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS three FROM b)"


@query(f"{_MOVES} SELECT user_id, CASE WHEN max(three) IS NOT NULL THEN 'BUYER' WHEN max(two) IS NOT NULL THEN 'ACTIVE' WHEN max(one) IS NOT NULL THEN 'NEW' END AS state, (max(one) IS NOT NULL)::BIGINT + (max(two) IS NOT NULL)::BIGINT + (max(three) IS NOT NULL)::BIGINT AS n, count(*) FILTER (event_type IN ('signup', 'view', 'purchase')) - n AS broken FROM c GROUP BY user_id")
def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state after all events, in their order, however they came in batches."""
    return _to_the_end(spark, sf_dir, S.state_machine, "update", ("user_id",), S.ROCKSDB)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a segmented log, written by two commits; a stream takes the first, stops, and goes on with the second by its offsets."""
    log.register(spark)
    base = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("payload"))
    half = events.agg(F.max("event_id")).first()[0] // 2
    records = spark.readStream.format("velarium_log").option("path", f"{base}/log").load()
    rows = records.select(F.from_json("payload", "event_id long, user_id long, event_type string").alias("r")).select("r.*")
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        events.where(part).select("payload").write.format("velarium_log").option("path", f"{base}/log").mode("append").save()
        out = S.run_now(rows, base=f"{base}/run")
    return out
