"""Incremental processing (STR-01 to STR-10), and event-time windows beyond the parity.

All are Structured Streaming queries; ``availableNow`` runs them as increments that ``supervised`` starts again and again.
What a stream appends goes to Spark's file sink; what it updates goes to a folder for each batch, and the reader takes
the last row of each key. Both cost what the batch costs, and a batch that runs again leaves the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Folders of a batch sink: one a batch, by the number that the checkpoint gives it.
BATCH = "batch"


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_each: int | None = None) -> DataFrame:
    """New files of a folder, each once (STR-03, STR-04): the checkpoint remembers them."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.load(path)


def distinct_events(events: DataFrame, hash_col: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each event once (STR-02): repeats within ``delay`` of event time are dropped; state older than that goes.

    So do events that come behind the watermark, whether repeats or not: nothing is known of their time any more."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([hash_col])


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """One increment: all there is now goes to ``sink`` in batches (STR-04, STR-05), then the query ends."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_available(df: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """One increment into Spark's file sink, whose log lists each batch's files once (STR-03 to STR-05)."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own (STR-05, SNK-15): a batch that runs again replaces it."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={number}")

    return sink


def latest_rows(rows: DataFrame, keys: list[str], order: str = BATCH) -> DataFrame:
    """The last row of each key by ``order``, without it: the state that updates lead to. One row a key and task is sent."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, "__last.*")


def supervised(jobs: dict[str, tuple[Callable[[], StreamingQuery], float]], until: Callable[[dict[str, int]], bool], failure_wait: float = 30, poll: float = 0.2) -> dict[str, int]:
    """Keeps streaming jobs running side by side until ``until`` holds (STR-01); returns the failures of each job.

    ``jobs``: name to what starts the query and the seconds after which it starts anew once it ended well; after a failure
    it starts anew ``failure_wait`` seconds later, from its checkpoint. ``until`` sees how often each job has ended well. All
    queries are stopped at the end."""
    running: dict[str, StreamingQuery] = {}
    due = dict.fromkeys(jobs, 0.0)
    ended, failures = dict.fromkeys(jobs, 0), dict.fromkeys(jobs, 0)
    try:
        while not until(ended):
            for name, (start, wait) in jobs.items():
                query = running.get(name)
                if query is None and time.monotonic() >= due[name]:
                    running[name] = start()
                elif query is not None and not query.isActive:
                    failed = query.exception() is not None
                    failures[name] += failed
                    ended[name] += not failed
                    due[name] = time.monotonic() + (failure_wait if failed else wait)
                    del running[name]
            time.sleep(poll)
    finally:
        for query in running.values():
            query.stop()
    return failures


def unfinished(manifest: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do (STR-08): manifest rows without a successful result."""
    return manifest.join(results.where(F.col("status") == "success").select(*keys), keys, "left_anti")


def promoted_locals(unmatched: DataFrame, known: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """Local identities for rows that match nothing, the same in each run (STR-09): those not known yet."""
    name = F.concat(F.lit("local_"), F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(f), F.lit("")) for f in fields)), 256), 1, 22))
    fresh = unmatched.withColumn(id_col, name).dropDuplicates([id_col])
    return fresh.join(known.select(id_col), id_col, "left_anti")


def retracted(matches: DataFrame, derived: DataFrame, id_col: str, disproved: Column) -> tuple[DataFrame, DataFrame]:
    """Matches that later data disproves go, and what was derived from them (STR-10)."""
    gone = matches.where(disproved).select(id_col)
    return matches.where(~F.coalesce(disproved, F.lit(False))), derived.join(gone, id_col, "left_anti")


def tumbling(events: DataFrame, at: str, size: str, keys: list[str], *aggregates: Column, delay: str | None = None) -> DataFrame:
    """Aggregates of event-time windows; a batch frame works as well (beyond the parity)."""
    late = events.withWatermark(at, delay) if delay else events
    out = late.groupBy(F.window(at, size), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("from_at"), F.col("window.end").alias("to_at"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], *aggregates: Column, delay: str | None = None) -> DataFrame:
    """Aggregates of sessions that a pause of ``gap`` ends (beyond the parity)."""
    late = events.withWatermark(at, delay) if delay else events
    out = late.groupBy(F.session_window(at, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("from_at"), F.col("session_window.end").alias("to_at"), *[c for c in out.columns if c != "session_window"])
