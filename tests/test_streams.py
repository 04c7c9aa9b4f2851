"""Streams that keep state: late, old and repeated packets told apart, idle streams forgotten, and the approximate form."""

import datetime as dt
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from streamworks.streaming import streams as R

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "ssrc long, arrival long, seq int, ts timestamp"


@pytest.fixture(scope="module")
def own(spark):
    return R.stateful_session(spark)


def batches(own, parts):
    """A file stream of one file for each batch of (ssrc, arrival, seq, seconds)."""
    place = tempfile.mkdtemp(prefix="spark-feed-")
    for rows in parts:
        own.createDataFrame([(*r[:3], BEGIN + dt.timedelta(seconds=r[3])) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), place


def test_late_old_and_repeated_are_told_apart(own):
    parts = [
        [(1, i, i, i) for i in range(200)],
        [(1, 200 + i, 200 + i, 1000 + i) for i in range(100)],
        [(1, 300, 300, 2000), (1, 301, 300, 2001), (1, 302, 20, 1990), (1, 303, 290, 1995), (2, 304, 7, 30), (2, 305, 8, 31)],  # two are late, one old, two repeated
        [(1, 306, 301, 3000), (1, 307, 302, 5)],
    ]
    stream, place = batches(own, parts)
    found, listener = R.run_observed(R.observed(R.stream_admit(stream, delay="10 seconds")), place, "told_apart")
    n = {r.reason: r.n for r in listener.report(own).groupBy("reason").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert n == {"ok": 302, "replay_old": 1, "replay_fail": 2, "late": 3}
    assert found.count() == 305
    by_batch = {b: c for b, c in listener.batches.items() if any(c.values())}
    assert len(by_batch) == 4 and sum(c["late"] for c in by_batch.values()) == 3


def test_listener_looks_at_its_own_query(own):
    stream, place = batches(own, [[(1, 1, 1, 1)]])
    listener = R.LateDataListener("another")
    own.streams.addListener(listener)
    try:
        R.run_available(R.observed(R.stream_admit(stream, delay="10 seconds")), place, name="mine")
    finally:
        own.streams.removeListener(listener)
    assert listener.batches == {} and listener.report(own).collect() == []


def test_idle_streams_are_forgotten_in_event_time(own):
    """The second packet with number 5 comes after the stream was idle for a minute: its window is gone."""
    parts = [[(1, 0, 5, 0), (2, 1, 5, 0)], [(2, 2, 6, 50)], [(2, 3, 7, 100)], [(2, 4, 8, 150)], [(1, 5, 5, 200), (2, 6, 8, 200)]]
    stream, place = batches(own, parts)
    got = R.run_available(R.stream_admit(stream, idle_ms=60_000, delay="1 second"), place).orderBy("arrival").collect()
    assert [(r.ssrc, r.arrival, r.status) for r in got] == [
        (1, 0, "ok"), (2, 1, "ok"), (2, 2, "ok"), (2, 3, "ok"), (2, 4, "ok"), (1, 5, "ok"), (2, 6, "replay_fail"),
    ]


def test_state_with_time_to_live_runs(own):
    """A time to live is checked by the clock, so that such a query doesn't end by itself."""
    stream, place = batches(own, [[(1, 0, 5, 0)], [(1, 1, 5, 1), (1, 2, 6, 2)]])
    query = R.stream_admit(stream, idle_ms=3_600_000).writeStream.format("memory").queryName("living").option("checkpointLocation", f"{place}/state").start()
    try:
        end = time.time() + 60
        while time.time() < end and own.table("living").count() < 3:
            time.sleep(1)
    finally:
        query.stop()
    assert [r.status for r in own.table("living").orderBy("arrival").collect()] == ["ok", "replay_fail", "ok"]


def test_approximate_form_passes_old_packets_and_repeats_after_the_delay(own):
    parts = [[(1, 0, 1000, 0), (1, 1, 1000, 1), (1, 2, 5, 2)], [(1, 3, 1001, 100)], [(1, 4, 1002, 200)], [(1, 5, 1000, 200)]]
    stream, place = batches(own, parts)
    got = R.run_available(R.stream_admit_approx(stream, "10 seconds"), place).collect()
    assert sorted(r.seq for r in got) == [5, 1000, 1000, 1001, 1002]  # exact: 5 is too old, the last 1000 a repeat


def test_durations_of_many_devices_over_batches(spark):
    """Devices of a group don't mix, states go on from batch to batch, and a batch costs no call for each device."""
    rows = [(i % 300 if i % 7 else None if i % 11 == 0 else 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 3 // 2, microseconds=i), i, "abc"[i % 3]) for i in range(2000)]
    place = tempfile.mkdtemp(prefix="spark-durations-")
    df = spark.createDataFrame(rows, "device_id long, ts timestamp, seq long, event string")
    for part in range(4):
        df.filter(f"seq div 500 = {part}").coalesce(1).write.mode("append").parquet(f"{place}/in")
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    told = R.run_available(R.stream_state_durations(feed, 16), f"{place}/run").groupBy("device_id", "event").agg(F.sum("seconds").alias("seconds"), F.sum("entered").alias("entered"))
    show = lambda found: sorted((str(r.device_id), r.event, round(r.seconds, 6), r.entered) for r in found.collect())
    assert show(told) == show(R.state_durations(df))
    query = R.stream_state_durations(feed, 16).writeStream.format("noop").option("checkpointLocation", f"{place}/count").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 17
