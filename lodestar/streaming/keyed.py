"""State kept by key in a stream, with timers (STR-06, STR-07): ``transformWithState`` and event time.

A key's state is one small value. A batch touches the keys that it holds and those whose timers its watermark passes, no
others; after a restart the checkpoint has the states and the timers. Each call to the state store is a message to the JVM, so a
key's state has its timer in it, and a key costs four calls at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state store has timers; the caller's own settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(PROVIDER, ROCKS)
    return own


class KeyedState(StatefulProcessor):
    """One value a key and at most one timer."""

    STATE = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.STATE)

    def timer(self, before_ms: int | None, at_ms: int | None) -> None:
        """Sets the key's timer where it had another one, or none."""
        if before_ms != at_ms:
            if before_ms is not None:
                self.handle.deleteTimer(before_ms)
            if at_ms is not None:
                self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class Retries(KeyedState):
    """Tries, latest outcome and time of the next try; emits a row at each change, and one when the time has come."""

    STATE = "step int, attempts int, ok boolean, at_us long, next_us long, timer_ms long"
    CHANGE = Row("key", "status", "attempts", "next_us", "step")

    def __init__(self, first_wait: int, most_wait: int):
        self.first_wait, self.most_wait = first_wait, most_wait

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, attempts, ok, at_us, _, timer = self.value.get() or (0, 0, None, None, None, None)
        for row in rows:
            attempts += 1
            if at_us is None or (row.at_us, row.ok) > (at_us, ok):
                at_us, ok = row.at_us, row.ok
        wait = min(self.most_wait, self.first_wait << min(attempts - 1, 40))
        next_us = None if ok else at_us + wait * 1_000_000
        due = None if ok else -(-next_us // 1000)
        self.value.update((step + 1, attempts, ok, at_us, next_us, due))
        self.timer(timer, due)
        yield self.CHANGE(key[0], "done" if ok else "retry", attempts, next_us, step + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, attempts, ok, at_us, next_us, _ = self.value.get()
        self.value.update((step + 1, attempts, ok, at_us, next_us, None))
        yield self.CHANGE(key[0], "due", attempts, next_us, step + 1)


def retry_states(outcomes: DataFrame, key: str, at: str, ok: str, first_wait: int = 60, most_wait: int = 86_400, delay: str = "0 seconds") -> DataFrame:
    """A stream of the changes of each key's retry state (STR-06): key, ``status``, ``attempts``, ``next_retry_at``, ``step``.

    Each outcome is a try. The latest one decides, whether ``done`` or ``retry`` (of two at one time the success), and after a
    failure the key waits ``first_wait`` seconds, doubled with each try up to ``most_wait``. When the watermark passes that
    time a timer makes it ``due``. The row with the largest ``step`` is a key's state. Outcomes without key or time are
    left out; a null outcome is a failure."""
    kind = outcomes.schema[key].dataType.simpleString()
    rows = outcomes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"), F.coalesce(ok, F.lit(False)).alias("ok")
    )
    states = rows.withWatermark("at", delay).groupBy("key").transformWithState(
        Retries(first_wait, most_wait), f"key {kind}, status string, attempts int, next_us long, step int", "Append", "EventTime"
    )
    return states.select(F.col("key").alias(key), "status", "attempts", F.timestamp_micros("next_us").alias("next_retry_at"), "step")


class Liveness(KeyedState):
    """First and last sign of each worker; a timer speaks where nothing arrives."""

    STATE = "step int, first_us long, last_us long, owned boolean, verdict string, timer_ms long"
    CHANGE = Row("key", "verdict", "verdict_us", "step")

    def __init__(self, hard: int, grace: int, quiet: int, unmanaged: int, status_quiet: int):
        self.hard, self.grace, self.quiet, self.unmanaged, self.status_quiet = hard, grace, quiet, unmanaged, status_quiet

    def deadline(self, first: int, last: int, owned: bool) -> int:
        """The last moment at which a worker with these signs counts as working."""
        silent = max(last + self.quiet, last + self.status_quiet, first + self.grace)
        return min(first + self.hard, silent, *([] if owned else [first + self.unmanaged]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, first, last, owned, before, timer = self.value.get() or (0, None, None, False, None, None)
        for row in rows:
            first, last = (row.at_us, row.at_us) if first is None else (min(first, row.at_us), max(last, row.at_us))
            owned = owned or row.owned
        until = self.deadline(first, last, owned)
        verdict = "kill" if last > until else "working"
        step += verdict != before
        ends = until // 1000 + 1 if verdict == "working" else None
        self.value.update((step, first, last, owned, verdict, ends))
        self.timer(timer, ends)
        if verdict != before:
            yield self.CHANGE(key[0], verdict, min(last, until), step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, first, last, owned, _, _ = self.value.get()
        self.value.update((step + 1, first, last, owned, "kill", None))
        yield self.CHANGE(key[0], "kill", self.deadline(first, last, owned), step + 1)


def live_verdicts(signs: DataFrame, key: str, at: str, owned: str, hard: int, grace: int, quiet: int, unmanaged: int, status_quiet: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of the changes of each worker's verdict (STR-07): key, ``verdict``, ``verdict_at``, ``step``.

    ``signs``: key, time, and whether a runner owns the worker (once true, it stays). Spans are in microseconds. A worker is
    ``working`` until its deadline: ``hard`` after its first sign, ``unmanaged`` if nobody owns it, or after its grace when
    it has been silent for ``quiet`` and its status for ``status_quiet``. The verdict at the deadline comes by timer, as
    ``queue.liveness`` has it for that moment; a later sign can make a silent worker work again. Signs without key
    or time are left out."""
    kind = signs.schema[key].dataType.simpleString()
    rows = signs.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"), F.coalesce(owned, F.lit(False)).alias("owned")
    )
    states = rows.withWatermark("at", delay).groupBy("key").transformWithState(
        Liveness(hard, grace, quiet, unmanaged, status_quiet), f"key {kind}, verdict string, verdict_us long, step int", "Append", "EventTime"
    )
    return states.select(F.col("key").alias(key), "verdict", F.timestamp_micros("verdict_us").alias("verdict_at"), "step")
