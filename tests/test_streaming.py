"""Streams: increments, sinks, keyed states and timers, supervision."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.operators import queue
from lodestar.streaming import incremental, keyed

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Lands rows as files of their own and returns the stream of all that landed."""
    own, landed = keyed.keyed_session(spark), []

    def land(rows, schema):
        df = own.createDataFrame(rows, schema)
        df.write.parquet(f"{tmp_path}/in/{len(landed)}")
        landed.append(1)
        return incremental.file_stream(own, f"{tmp_path}/in/*", df.schema)

    return land


def test_a_key_repeated_within_the_watermark_comes_once(spark, feed, tmp_path):
    schema = "k int, at timestamp"

    def increment(rows):
        stream = incremental.distinct_events(feed(rows, schema), "k", "at", "1 hour")
        incremental.append_available(stream, f"{tmp_path}/check", f"{tmp_path}/out")
        return sorted((r.k, (r["at"] - START).total_seconds()) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert increment([(1, at(0)), (1, at(0)), (2, at(7200))]) == [(1, 0), (2, 7200)]
    # The watermark is an hour behind: 3 is late but in time, 2 is a repeat, 4 too late, 1 a repeat that is too late.
    assert increment([(3, at(4000)), (2, at(7200)), (4, at(3000)), (1, at(0))]) == [(1, 0), (2, 7200), (3, 4000)]
    assert increment([(5, at(20_000))])[-1] == (5, 20_000)


def test_retry_states_survive_restarts_and_fall_due(spark, feed, tmp_path):
    def increment(rows):
        stream = keyed.retry_states(feed(rows, "k string, at timestamp, ok boolean"), "k", "at", "ok", 60, 200)
        incremental.append_available(stream, f"{tmp_path}/check", f"{tmp_path}/out")
        changes = spark.read.parquet(f"{tmp_path}/out")
        last = incremental.latest_rows(changes, ["k"], "step").collect()
        return {r.k: (r.status, r.attempts, r.next_retry_at and (r.next_retry_at - START).total_seconds()) for r in last}

    first = increment([("a", at(0), False), ("a", at(10), False), ("b", at(5), True), ("b", at(5), False), ("c", at(20), None), (None, at(1), True)])
    assert first == {"a": ("retry", 2, 130), "b": ("done", 2, None), "c": ("retry", 1, 80)}
    # The watermark passes c's time, not a's; b fails after its success, so it is to be tried again.
    second = increment([("b", at(100), False), ("d", at(30), True)])
    assert second == {"a": ("retry", 2, 130), "b": ("retry", 3, 300), "c": ("due", 1, 80), "d": ("done", 1, None)}
    third = increment([("a", at(140), False), ("c", at(130), True), ("e", at(600), True)])
    assert third == {"a": ("due", 3, 340), "b": ("due", 3, 300), "c": ("done", 2, None), "d": ("done", 1, None), "e": ("done", 1, None)}


def plain_retry(outcomes, first, most):
    tries, latest = len(outcomes), max((t, bool(ok)) for t, ok in outcomes)
    return ("done", tries, None) if latest[1] else ("retry", tries, latest[0] + min(most, first * 2 ** (tries - 1)))


def test_retry_states_equal_a_loop(spark, feed, tmp_path):
    draw, seen = random.Random(3), {}
    for part in range(3):
        rows = [(f"k{draw.randint(0, 12)}", part * 1000 + draw.randint(1, 999), draw.choice([True, False, None])) for _ in range(60)]
        for k, t, ok in rows:
            seen.setdefault(k, []).append((t, ok))
        stream = keyed.retry_states(feed([(k, at(t), ok) for k, t, ok in rows], "k string, at timestamp, ok boolean"), "k", "at", "ok", 60, 500)
        incremental.append_available(stream, f"{tmp_path}/check", f"{tmp_path}/out")
    mark = max(t for rows in seen.values() for t, _ in rows)
    want = {k: plain_retry(rows, 60, 500) for k, rows in seen.items()}
    want = {k: ("due" if s == "retry" and n <= mark else s, a, n) for k, (s, a, n) in want.items()}
    last = incremental.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["k"], "step").collect()
    assert {r.k: (r.status, r.attempts, r.next_retry_at and (r.next_retry_at - START).total_seconds()) for r in last} == want


def test_a_key_costs_four_calls(spark):
    """A state that has a timer, and gets rows: read, written, one timer gone and one set; no list of timers, no frame a key."""
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *given: calls.append((name, *given)) or (self if name == "getValueState" else held[0] if name == "get" else None)

    held = [(3, 2, False, 5_000_000, 125_000_000, 125_000)]
    states = keyed.Retries(60, 600)
    states.init(Handle())
    calls.clear()
    rows = iter([Row(at_us=9_000_000, ok=False), Row(at_us=7_000_000, ok=True)])
    assert list(states.handleInputRows(("k",), rows, None)) == [("k", "retry", 4, 489_000_000, 4)]
    assert calls == [("get",), ("update", (4, 4, False, 9_000_000, 489_000_000, 489_000)), ("deleteTimer", 125_000), ("registerTimer", 489_000)]


def test_a_silent_worker_gets_its_verdict_by_timer(spark, feed, tmp_path):
    minutes = 60_000_000
    spans = dict(hard=240 * minutes, grace=45 * minutes, quiet=25 * minutes, unmanaged=15 * minutes, status_quiet=25 * minutes)
    signs = []

    def increment(rows):
        signs.extend(rows)
        stream = keyed.live_verdicts(feed([(k, at(60 * t), owned) for k, t, owned in rows], "k string, at timestamp, owned boolean"), "k", "at", "owned", **spans)
        incremental.append_available(stream, f"{tmp_path}/check", f"{tmp_path}/out")
        changes = spark.read.parquet(f"{tmp_path}/out")
        got = {r.k: r.verdict for r in incremental.latest_rows(changes, ["k"], "step").collect()}
        # The batch rule at the moment up to which the stream has got.
        now = max(t for _, t, _ in signs)
        seen = spark.createDataFrame(signs, "k string, t double, owned boolean").groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.bool_or("owned").alias("owned"))
        rule = queue.liveness(F.lit(True), F.col("owned"), now - F.col("a"), now - F.col("b"), now - F.col("b"))
        assert got == {r.k: r.v for r in seen.select("k", rule.alias("v")).collect()}
        return got, {(r.k, r.verdict, (r.verdict_at - START).total_seconds() / 60) for r in changes.collect()}

    got, _ = increment([("steady", 0.0, True), ("silent", 0.0, True), ("alone", 2.0, False), ("clock", 10.0, True)])
    assert set(got.values()) == {"working"}
    got, changes = increment([("steady", 40.0, True), ("clock", 44.0, True)])
    assert got["silent"] == "working" and got["alone"] == "kill" and ("alone", "kill", 17.0) in changes
    got, changes = increment([("clock", 60.0, True), ("steady", 60.0, True)])
    assert got["silent"] == "kill" and ("silent", "kill", 45.0) in changes  # nothing came: the timer spoke
    got, _ = increment([("silent", 70.0, True), ("clock", 70.0, True)])
    assert got["silent"] == "working"  # it came back
    got, changes = increment([("clock", 300.0, True)])
    assert set(got.values()) == {"kill"} and ("steady", "kill", 85.0) in changes and ("clock", "kill", 250.0) in changes


def test_a_batch_that_runs_again_leaves_the_same_rows(spark, tmp_path):
    sink = incremental.batch_folders(f"{tmp_path}/out")
    state = lambda: sorted(map(tuple, incremental.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["k"]).collect()))
    sink(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    batch = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    sink(batch.limit(1), 1)  # one that failed half way
    sink(batch, 1)
    assert state() == [(1, "a"), (2, "c"), (3, None)]
    sink(batch, 1)
    assert state() == [(1, "a"), (2, "c"), (3, None)]


def test_updates_go_to_folders_of_their_batches(spark, feed, tmp_path):
    def increment(rows):
        counts = feed(rows, "k int, v int").groupBy("k").agg(F.sum("v").alias("total"))
        incremental.run_available(counts, f"{tmp_path}/check", incremental.batch_folders(f"{tmp_path}/out"), "update")
        return spark.read.parquet(f"{tmp_path}/out")

    increment([(1, 5), (2, 5), (3, 5)])
    out = increment([(2, 1)])
    assert out.where("batch = 1").count() == 1  # what changed, not the whole table
    assert sorted(map(tuple, incremental.latest_rows(out, ["k"]).collect())) == [(1, 5), (2, 6), (3, 5)]


def test_failed_jobs_start_again_and_others_go_on(spark, feed, tmp_path):
    stream = feed([(1,), (2,)], "k int")
    fails = [True, True]

    def start(name, broken):
        def sink(batch, number):
            if broken and fails:
                fails.pop()
                raise RuntimeError("not now")
            incremental.batch_folders(f"{tmp_path}/{name}")(batch, number)

        return lambda: stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start()

    jobs = {"good": (start("good", False), 0.1), "broken": (start("broken", True), 0.1)}
    failures = incremental.supervised(jobs, lambda ended: ended["good"] >= 2 and ended["broken"] >= 1, failure_wait=0.1)
    assert failures == {"good": 0, "broken": 2}
    assert spark.read.parquet(f"{tmp_path}/broken").count() == spark.read.parquet(f"{tmp_path}/good").count() == 2


def test_the_callers_session_keeps_its_state_store(spark):
    before = spark.conf.get(keyed.PROVIDER)
    assert keyed.keyed_session(spark).conf.get(keyed.PROVIDER) == keyed.ROCKS and spark.conf.get(keyed.PROVIDER) == before
