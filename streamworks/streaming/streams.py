"""Streaming jobs, each with a batch twin elsewhere in the library."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.signal import level_agg
from ..operators.packets import AdmissionState


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as state variables with a time to live need it."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(PROVIDER, ROCKSDB)
    return own


class Admission(StatefulProcessor):
    """R1 for one ssrc: a value state of the highest index and the window's bits. An idle stream is forgotten after ``idle_ms``, if given: by
    the state's own time to live, or with event time by a timer."""

    def __init__(self, window: int, idle_ms: int | None, event_time: bool):
        self.window, self.idle_ms, self.event_time = window, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("admission", "high long, bits binary, seen long", None if self.event_time else self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        high, bits, seen = self.state.get() if self.state.exists() else (None, b"", 0)
        own = AdmissionState(high, int.from_bytes(bits, "big"), self.window)
        part = pd.concat(list(rows)).sort_values("arrival")
        found = own.rows(part["seq"].tolist())
        if self.event_time and self.idle_ms:
            newest = max(seen, int(part["ts"].max().timestamp() * 1000))
            if seen:
                self.handle.deleteTimer(seen + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
            seen = newest
        self.state.update((own.high, own.bits.to_bytes((own.window + 7) // 8, "big"), seen))
        yield pd.DataFrame({"ssrc": key[0], "arrival": part["arrival"], "seq": part["seq"], "index": [i for i, _ in found], "status": [s for _, s in found]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_admit(packets: DataFrame, window: int = 128, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """Live sequence extension and replay rejection by ssrc; (ssrc, arrival, seq, index, status).

    State variables need RocksDB, so the stream's session keeps state there from now on (``stateful_session`` keeps other streams apart from that).

    State is the highest index and a window of bits; a stream without packets for ``idle_ms`` is forgotten, if that is given (by the clock, so that
    such a query doesn't end by itself, unless there is a ``delay``). Packets of one batch are taken in order of arrival. With ``delay``, packets (with an event time ``ts``) behind the watermark are dropped before they
    reach the window, and idling is measured in event time; the query's progress counts them (``LateDataListener``).
    """
    packets.sparkSession.conf.set(PROVIDER, ROCKSDB)
    timed = packets.withWatermark("ts", delay) if delay else packets
    mode = "EventTime" if delay else "ProcessingTime" if idle_ms else "None"
    return timed.groupBy("ssrc").transformWithStateInPandas(
        Admission(window, idle_ms, bool(delay)), "ssrc long, arrival long, seq int, index long, status string", "append", mode
    )


def stream_admit_approx(packets: DataFrame, delay: str) -> DataFrame:
    """R1 without Python state: the first packet of each (ssrc, seq) within the watermark's delay passes, later ones and late ones go.

    Approximate: nothing is rejected for lying a window below the highest index, a number that returns after a wrap within ``delay`` is taken for a
    repeat, and a repeat after ``delay`` passes. ``delay`` should be shorter than 65536 packets take. State is a key and a time for each packet of the delay.
    """
    return packets.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ssrc", "seq"])


def stream_levels(df: DataFrame, size: str = "1 second", hop: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """R2 (tumbling) and R3 (sliding with ``hop``): levels of (ts, stream_id, x) in event-time windows."""
    own = F.window("ts", size, hop) if hop else F.window("ts", size)
    found = df.withWatermark("ts", delay).groupBy(own.alias("w"), "stream_id").agg(level_agg(F.col("x")).alias("l"), F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stream_id", "l.rms", "l.peak", "l.dc", "n")


def stream_leak_monitor(events: DataFrame, max_age_s: int, delay: str = "1 minute") -> DataFrame:
    """Allocations (device_id, addr, seq, act, size, ts) that aren't freed within their greatest age, told once event time has passed it."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(live)
            state.remove()
        else:
            for r in pd.concat(list(parts)).sort_values("seq").itertuples():
                if live is not None and r.ts.timestamp() * 1000 > live[2] + max_age_s * 1000:
                    out.append(live)
                live = (r.seq, r.size, int(r.ts.timestamp() * 1000)) if r.act == "+" else None
            if live is None:
                if state.exists:
                    state.remove()
            else:
                state.update(live)
                state.setTimeoutTimestamp(max(live[2] + max_age_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], key[1], *x[:2]) for x in out], columns=["device_id", "addr", "seq", "size"])

    return events.withWatermark("ts", delay).groupBy("device_id", "addr").applyInPandasWithState(
        run, "device_id long, addr long, seq long, size long", "seq long, size long, at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def call_sessions(df: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Sessions of (device_id, ts, event) separated by a gap; outcome "answered", "missed" or "open" by the events seen. Batch or stream."""
    rows = df.withWatermark("ts", delay) if delay else df
    own = F.session_window("ts", gap)
    found = rows.groupBy(own.alias("w"), "device_id").agg(
        F.count("*").alias("events"), F.max_by("event", "ts").alias("last_event"), F.count_if(F.col("event") == "answer").alias("answers"), F.count_if(F.col("event") == "hangup").alias("hangups")
    )
    outcome = F.when(F.col("answers") > 0, "answered").when(F.col("hangups") > 0, "missed").otherwise("open")
    return found.select("device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last_event", outcome.alias("outcome"))


def state_durations(df: DataFrame) -> DataFrame:
    """Seconds between an event and its device's next one, summed by event (the last event of a device counts nothing)."""
    from pyspark.sql.window import Window

    nxt = F.lead("ts").over(Window.partitionBy("device_id").orderBy("ts", "seq"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(nxt) - micros(F.col("ts"))) / 1e6
    return df.withColumn("s", seconds).groupBy("device_id", "event").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"), F.count("*").alias("entered"))


#: Groups that devices are dealt to, each with one state.
DEVICE_GROUPS = 256


def stream_state_durations(df: DataFrame, groups: int = DEVICE_GROUPS) -> DataFrame:
    """R6 on a stream: (device_id, event, entered, seconds) as they become known; the sums by device and event are those of ``state_durations``.

    State is a device's last event and its time. Devices are dealt to ``groups`` by a hash and a group's state holds those of its devices, so that a batch
    costs a call for each group and not for each device. Events of one batch are taken in order of (ts, seq). ``groups`` stays the same for as long as a checkpoint is used.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {device: (event, micros) for device, event, micros in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        devices, events, entered, seconds = [], [], [], []
        for device, event, micros in zip(rows["device_id"].tolist(), rows["event"].tolist(), rows["ts"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
            before = last.get(device)
            if before:
                devices.append(device), events.append(before[0]), entered.append(0), seconds.append((micros - before[1]) / 1e6)
            devices.append(device), events.append(event), entered.append(1), seconds.append(0.0)
            last[device] = (event, micros)
        state.update((list(last), [event for event, _ in last.values()], [micros for _, micros in last.values()]))
        told = pd.array([None] * len(devices) if key[0] < 0 else devices, dtype="Int64")
        yield pd.DataFrame({"device_id": told, "event": events, "entered": entered, "seconds": seconds})

    # null is a device of its own group
    group = F.when(F.col("device_id").isNull(), -1).otherwise(F.pmod(F.hash("device_id"), F.lit(groups)))
    dealt = df.select(F.coalesce("device_id", F.lit(0)).alias("device_id"), "event", "ts", "seq", group.alias("group"))
    return dealt.groupBy("group").applyInPandasWithState(
        run, "device_id long, event string, entered long, seconds double", "device_id array<bigint>, event array<string>, micros array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def service_liveness(df: DataFrame, interval_s: int = 30, delay: str | None = None) -> DataFrame:
    """Spans in which a service (uuid, ts, kind alive or bye) was alive; one without a notify for two intervals has expired **[choice]**."""
    rows = df.withWatermark("ts", delay) if delay else df
    own = F.session_window("ts", f"{2 * interval_s} seconds")
    found = rows.groupBy(own.alias("w"), "uuid").agg(F.max_by("kind", "ts").alias("last_kind"), F.count("*").alias("notifies"), F.max("ts").alias("last_seen"))
    return found.select("uuid", F.col("w.start").alias("start"), "last_seen", "notifies", F.when(F.col("last_kind") == "bye", "bye").otherwise("expired").alias("ended_by"))


def segment_feed(df: DataFrame, most: int = 512) -> DataFrame:
    """(stream_id, seq, bos, format, valid_size): a segment begins where bos is set; sizes of 0 are skipped, sizes above ``most`` count as errors."""
    from pyspark.sql.window import Window

    kept = df.filter("valid_size <> 0")
    segment = F.sum(F.col("bos").cast("int")).over(Window.partitionBy("stream_id").orderBy("seq"))
    bad = F.col("valid_size") > most
    return kept.withColumn("segment", segment).groupBy("stream_id", "segment").agg(
        F.min_by("format", "seq").alias("format"), F.sum(F.when(~bad, F.col("valid_size")).otherwise(0)).alias("bytes"), F.count_if(bad).alias("errors"), F.count("*").alias("metas")
    )


def stream_segment_feed(df: DataFrame, most: int = 512) -> DataFrame:
    """R8 on a stream: each segment once the next one begins, as ``segment_feed`` tells it. State is the open segment's sums."""
    names = ["segment", "format", "bytes", "errors", "metas"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get, strict=True)) if state.exists else None
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if r.valid_size == 0:
                continue
            if now is None or r.bos:
                if now is not None:
                    out.append((key[0], *now.values()))
                now = dict(zip(names, ((now["segment"] if now else 0) + int(r.bos), r.format, 0, 0, 0), strict=True))
            bad = r.valid_size > most
            now |= {"bytes": now["bytes"] + (0 if bad else r.valid_size), "errors": now["errors"] + int(bad), "metas": now["metas"] + 1}
        if now is not None:
            state.update(tuple(now.values()))
        yield pd.DataFrame(out, columns=["stream_id", *names])

    return df.groupBy("stream_id").applyInPandasWithState(
        run, "stream_id long, segment long, format int, bytes long, errors long, metas long", "segment long, format int, bytes long, errors long, metas long", "append", GroupStateTimeout.NoTimeout
    )


def late_data_report(admitted: DataFrame) -> DataFrame:
    """Of R1's result (or W3's): packets rejected as too old or repeated, by ssrc."""
    return admitted.filter("status <> 'ok'").groupBy("ssrc", F.col("status").alias("reason")).agg(F.count("*").alias("n"))


OBSERVED = "admission"


def observed(admitted: DataFrame) -> DataFrame:
    """R9 on a live stream: R1's result, with counts by reason that travel in each batch's progress instead of a second query."""
    status = F.col("status")
    counts = {"ok": status == "ok", "replay_old": status == "replay_old", "replay_fail": status == "replay_fail"}
    return admitted.observe(OBSERVED, *[F.count_if(c).alias(name) for name, c in counts.items()])


class LateDataListener(StreamingQueryListener):
    """Collects from the progress of an ``observed`` stream what was admitted, rejected and dropped behind the watermark, by batch.

    Only a few numbers of each batch reach the driver. ``name`` is the query's; others are not looked at. A batch told twice counts once.
    """

    def __init__(self, name: str):
        self.name, self.ended = name, threading.Event()
        self.batches: dict[int, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name:
            return
        told = progress.observedMetrics.get(OBSERVED)
        own = self.batches.setdefault(progress.batchId, {})
        own |= told.asDict() if told is not None else {}
        own["late"] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def report(self, spark: SparkSession) -> DataFrame:
        """(batch, reason, n): "late" is behind the watermark, "replay_old" below the window, "replay_fail" a repeat, "ok" admitted."""
        rows = [(batch, reason, n) for batch, counts in sorted(self.batches.items()) for reason, n in counts.items() if n]
        return spark.createDataFrame(rows, "batch long, reason string, n long")


def run_observed(df: DataFrame, folder: str, name: str) -> tuple[DataFrame, LateDataListener]:
    """``run_available`` of an ``observed`` stream under a listener: what it wrote, and the listener with all batches."""
    spark: SparkSession = df.sparkSession
    listener = LateDataListener(name)
    spark.streams.addListener(listener)
    try:
        found = run_available(df, folder, name=name)
        listener.ended.wait(60)  # events come in order, the end last
    finally:
        spark.streams.removeListener(listener)
    return found, listener


def run_available(df: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over what its source holds now, into Parquet below a shared folder, and reads that."""
    spark: SparkSession = df.sparkSession
    writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
