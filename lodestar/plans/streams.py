"""Streaming queries: increments over the events, compared with their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.registry import query
from lodestar.session import shared_path, table
from lodestar.streaming import incremental, keyed


def scratch(spark: SparkSession) -> str:
    return shared_path(spark, "stream")


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return timed(incremental.file_stream(spark, f"{sf_dir}/events.parquet*", schema))


def delivered(spark: SparkSession, deliveries: DataFrame, cuts: list[str], increment: Callable[[DataFrame], None]) -> None:
    """The rows land in parts by ``delivered_at``; after each part ``increment`` gets the stream of all that landed.

    Each is a restart: the query reads its checkpoint and finds the part that is new."""
    landing = f"{scratch(spark)}/in"
    limits = [None, *cuts, None]
    for k, (low, high) in enumerate(zip(limits, limits[1:], strict=False)):
        part = deliveries
        if low:
            part = part.where(F.col("delivered_at") >= F.lit(low).cast("timestamp"))
        if high:
            part = part.where(F.col("delivered_at") < F.lit(high).cast("timestamp"))
        part.drop("delivered_at").write.parquet(f"{landing}/{k}")
        increment(incremental.file_stream(spark, f"{landing}/*", deliveries.drop("delivered_at").schema))


@query("SELECT sha256(concat_ws(chr(0), user_id::VARCHAR, event_type, value::VARCHAR)) AS event_hash, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hash; of equal events the first stays (STR-02 to STR-05). The updates of each batch are a folder."""
    stream = event_stream(spark, sf_dir)
    hashed = F.sha2(F.concat_ws("\0", F.col("user_id").cast("string"), "event_type", F.col("value").cast("string")), 256)
    firsts = stream.groupBy(hashed.alias("event_hash")).agg(F.min("event_id").alias("event_id"))
    shared = scratch(spark)
    incremental.run_available(firsts, f"{shared}/checkpoint", incremental.batch_folders(f"{shared}/out"), "update")
    return incremental.latest_rows(spark.read.parquet(f"{shared}/out"), ["event_hash"])


#: Deliveries land before each of these moments, and after the last one.
CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]


@query("""
WITH d AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 10 DAY WHEN event_id % 7 = 0 THEN ts + INTERVAL 6 HOUR ELSE ts END AS delivered_at FROM events
  UNION ALL SELECT event_id, ts, ts + INTERVAL 3 HOUR FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, ts, ts + INTERVAL 12 DAY FROM events WHERE event_id % 11 = 0),
p AS (SELECT *, (delivered_at >= '2024-01-08')::INT + (delivered_at >= '2024-01-15')::INT + (delivered_at >= '2024-01-22')::INT AS part FROM d),
seen AS (SELECT part, max(ts) AS last FROM p GROUP BY part),
w AS (SELECT p.part, max(date_trunc('millisecond', s.last)) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT part FROM p) p LEFT JOIN seen s ON s.part < p.part GROUP BY p.part)
SELECT DISTINCT p.event_id, ts AS at FROM p JOIN w USING (part) WHERE mark IS NULL OR ts > mark""")
def stream_watermark_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a feed that repeats some and delays others, each once (STR-02, STR-03), into Spark's file sink.

    Repeats and delays of hours lie within the watermark's day; what comes ten days late is behind it and is dropped, unless
    it lands with the part that it belongs to."""
    events = timed(table(spark, sf_dir, "events")).select("event_id", "at")
    late = lambda hours: F.col("at") + F.expr(f"INTERVAL '{hours}' HOUR")
    first = F.when(F.col("event_id") % 13 == 0, late(240)).when(F.col("event_id") % 7 == 0, late(6)).otherwise(F.col("at"))
    again = events.where("event_id % 5 = 0").withColumn("delivered_at", late(3)), events.where("event_id % 11 = 0").withColumn("delivered_at", late(288))
    deliveries = events.withColumn("delivered_at", first).unionByName(again[0]).unionByName(again[1])
    shared = scratch(spark)
    delivered(spark, deliveries, CUTS, lambda stream: incremental.append_available(incremental.distinct_events(stream, "event_id", "at", "1 day"), f"{shared}/checkpoint", f"{shared}/out"))
    return spark.read.parquet(f"{shared}/out").select("event_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("""
SELECT date_trunc('day', ts) AS from_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by event type, from an increment (beyond the parity)."""
    windows = incremental.tumbling(event_stream(spark, sf_dir), "at", "1 day", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    shared = scratch(spark)
    incremental.run_available(windows, f"{shared}/checkpoint", incremental.batch_folders(f"{shared}/out"), "update")
    found = incremental.latest_rows(spark.read.parquet(f"{shared}/out"), ["from_at", "event_type"])
    return found.select(F.col("from_at").cast("timestamp_ntz").alias("from_at"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS from_at, count(*) AS n, round(max(value), 4) AS top FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that six hours of silence end; the batch form of the streaming operator (beyond the parity)."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = incremental.sessions(events, "at", "6 hours", ["user_id"], F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    return found.select("user_id", F.col("from_at").cast("timestamp_ntz").alias("from_at"), "n", "top")


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS from_at, count(*) AS n, round(max(value), 4) AS top FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that are over, from a stream of four parts into Spark's file sink: one that is open when a part ends goes on in the
    next, and comes once, when the watermark has passed its pause (beyond the parity)."""
    events = timed(table(spark, sf_dir, "events")).select("user_id", "at", "value")
    shared = scratch(spark)

    def increment(stream: DataFrame) -> None:
        closed = incremental.sessions(stream, "at", "6 hours", ["user_id"], F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"), delay="0 seconds")
        incremental.append_available(closed, f"{shared}/checkpoint", f"{shared}/out")

    delivered(spark, events.withColumn("delivered_at", F.col("at")), CUTS, increment)
    return spark.read.parquet(f"{shared}/out").select("user_id", F.col("from_at").cast("timestamp_ntz").alias("from_at"), "n", "top")


@query("""
WITH e AS (SELECT user_id, ts, event_type = 'purchase' AS ok, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM events),
s AS (SELECT user_id, count(*)::INT AS attempts, bool_or(ok) FILTER (ts = last_ts) AS ok, max(ts) AS last_ts FROM e GROUP BY 1),
n AS (SELECT *, CASE WHEN NOT ok THEN last_ts + to_seconds(least(86400, 60 * power(2, attempts - 1))::BIGINT) END AS next_retry_at FROM s)
SELECT user_id, CASE WHEN ok THEN 'done' WHEN epoch_us(next_retry_at) <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) THEN 'due' ELSE 'retry' END AS status,
       attempts, next_retry_at FROM n""")
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry states carried through four batches of a stream of outcomes, each after a restart; timers make keys due
    (STR-01, STR-06). What the stream appends are changes, and the last change of a key is its state."""
    own = keyed.keyed_session(spark)
    outcomes = timed(table(own, sf_dir, "events")).select("user_id", "at", (F.col("event_type") == "purchase").alias("ok"))
    shared = scratch(spark)
    delivered(
        own, outcomes.withColumn("delivered_at", F.col("at")), CUTS,
        lambda stream: incremental.append_available(keyed.retry_states(stream, "user_id", "at", "ok"), f"{shared}/checkpoint", f"{shared}/changes"),
    )
    states = incremental.latest_rows(spark.read.parquet(f"{shared}/changes"), ["user_id"], "step")
    return states.select("user_id", "status", "attempts", F.col("next_retry_at").cast("timestamp_ntz").alias("next_retry_at"))


@query("""
WITH e AS (SELECT epoch_ms(max(ts)) * 1000 AS now FROM events),
w AS (SELECT user_id, max(epoch_us(ts)) AS last_us, min(epoch_us(ts)) AS first_us, bool_or(event_type = 'signup') AS owned FROM events GROUP BY 1),
m AS (SELECT user_id, owned, (now - first_us) / 86400e6 AS age, (now - last_us) / 86400e6 AS idle FROM w, e)
SELECT user_id, CASE WHEN age > 240 THEN 'kill' WHEN NOT owned AND age > 15 THEN 'kill' WHEN idle * 4 <= 2 THEN 'working' WHEN age <= 10 THEN 'working' WHEN least(idle, age) > 2 THEN 'kill' ELSE 'working' END AS verdict FROM m""")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user is alive, in days for minutes (STR-07), from a stream: where no event comes a timer gives the verdict.

    The last verdict equals the batch rule at the moment up to which the stream has got."""
    own = keyed.keyed_session(spark)
    signs = timed(table(own, sf_dir, "events")).select("user_id", "at", (F.col("event_type") == "signup").alias("owned"))
    shared = scratch(spark)
    spans = [int(days * keyed.DAY) for days in (240, 10, 2, 15, 0.5)]
    delivered(
        own, signs.withColumn("delivered_at", F.col("at")), CUTS,
        lambda stream: incremental.append_available(keyed.live_verdicts(stream, "user_id", "at", "owned", *spans), f"{shared}/checkpoint", f"{shared}/verdicts"),
    )
    return incremental.latest_rows(spark.read.parquet(f"{shared}/verdicts").drop("verdict_at"), ["user_id"], "step")


@query("""
WITH m AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50),
u AS (SELECT * FROM m WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM s))
SELECT user_id, event_type, 'local_' || substr(sha256(concat_ws(chr(0), user_id::VARCHAR, event_type)), 1, 22) AS id FROM u""")
def stream_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without a success, each with a local identity (STR-08 to STR-10)."""
    events = table(spark, sf_dir, "events")
    results = events.select("user_id", "event_type", F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"))
    left = incremental.unfinished(events.select("user_id", "event_type").distinct(), results, ["user_id", "event_type"])
    named = left.withColumn("user", F.col("user_id").cast("string"))
    none = spark.createDataFrame([], "id string")
    return incremental.promoted_locals(named, none, "id", "user", "event_type").select("user_id", "event_type", "id")
