"""Packets: header decoding, routing, sequence extension, replay windows, budgets and reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import FULL, HALF, EpochScan, SequenceScan, carried_scan, next_index
from .windows import carry

#: Packets left below which a key's use is soft-limited, and the least limit.
SOFT_LIMIT = 65536


def _uint(payload: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(payload, start, size)), 16, 10).cast("long")


def decode_rtp_header(df: DataFrame, payload: str = "payload") -> DataFrame:
    """header fields of a binary column; status "bad_param" if it is too short for what it announces."""
    p, n = F.col(payload), F.length(F.col(payload))
    first, second = _uint(p, 1, 1), _uint(p, 2, 1)
    cc, has_ext = first.bitwiseAND(15), first.bitwiseAND(16) != 0
    fixed = 12 + 4 * cc
    words = F.conv(F.hex(F.substr(p, (fixed + 3).cast("int"), F.lit(2))), 16, 10).cast("long")
    enough = (n >= 12) & (n >= fixed) & (~has_ext | (n >= fixed + 4))
    ext = F.when(has_ext & enough, 4 + 4 * F.coalesce(words, F.lit(0))).otherwise(F.lit(0))
    ok = enough & (n >= fixed + ext)
    fields = {
        "version": F.shiftright(first, 6), "padding": first.bitwiseAND(32) != 0, "has_ext": has_ext, "cc": cc, "marker": second.bitwiseAND(128) != 0,
        "pt": second.bitwiseAND(127), "seq": _uint(p, 3, 2), "rtp_ts": _uint(p, 5, 4), "ssrc": _uint(p, 9, 4), "ext_length": ext, "header_length": fixed + ext,
    }
    return df.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("bad_param")).withColumns({k: F.when(F.col("status") == "ok", v) for k, v in fields.items()})


def route_to_policy(packets: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy of the packet's ssrc, else the template of its direction (provisional), else status "no_ctx"."""
    exact = policies.filter("ssrc_type = 'specific'").select("ssrc", F.lit(True).alias("exact"), F.col("window").alias("w1"), F.col("allow_repeat").alias("r1"), F.col("key_limit").alias("l1"))
    wild = policies.filter("ssrc_type <> 'specific'").select(
        F.when(F.col("ssrc_type") == "any_inbound", "in").otherwise("out").alias("direction"), F.lit(True).alias("wild"), F.col("window").alias("w2"), F.col("allow_repeat").alias("r2"), F.col("key_limit").alias("l2")
    )
    both = packets.join(exact, "ssrc", "left").join(wild, "direction", "left")
    hit, any_hit = F.coalesce("exact", F.lit(False)), F.coalesce("wild", F.lit(False))
    return both.select(
        *packets.columns, F.coalesce("w1", "w2").alias("window"), F.coalesce("r1", "r2").alias("allow_repeat"), F.coalesce("l1", "l2").alias("key_limit"),
        (~hit & any_hit).alias("provisional"), F.when(hit | any_hit, "ok").otherwise("no_ctx").alias("route"),
    )


def select_key(packets: DataFrame, keys: DataFrame) -> DataFrame:
    """The packet's key among its stream's keys (ssrc, key_id, key_no); streams without key ids use key 0; no match: "bad_mki"."""
    named = keys.filter("key_id IS NOT NULL")
    streams = named.select("ssrc").distinct().withColumn("has_ids", F.lit(True))
    found = packets.join(named.select("ssrc", "key_id", F.col("key_no").alias("_no")), ["ssrc", "key_id"], "left").join(streams, "ssrc", "left")
    uses = F.coalesce("has_ids", F.lit(False))
    number = F.when(~uses, F.lit(0)).otherwise(F.col("_no"))
    return found.withColumn("key_no", number).withColumn("key_status", F.when(number.isNull(), "bad_mki").otherwise("ok")).drop("_no", "has_ids")


def extend_sequence(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Adds ``index``, exactly, in order of arrival. It follows the highest index of all packets; one ssrc spreads over all tasks (``carried_scan``)."""
    return carried_scan(df, ["ssrc"], order, SequenceScan())


def extend_sequence_by_wraps(df: DataFrame, order: str = "arrival") -> DataFrame:
    """W2 without Python: adds ``index`` as seq plus 65536 for each wrap so far. Exact while arrivals in a row differ by less than 32768
    and no packet precedes the first epoch; a long stream is still one window, but in bounded memory."""
    own = Window.partitionBy("ssrc").orderBy(order)
    step = F.col("seq") - F.lag("seq").over(own)
    wrap = F.when(step < -HALF, 1).when(step > HALF, -1).otherwise(0)
    return df.withColumn("_wrap", F.coalesce(wrap, F.lit(0))).withColumn("index", F.col("seq") + F.lit(FULL) * F.sum("_wrap").over(own)).drop("_wrap").withColumn("index", F.col("index").cast("long"))


def replay_status(df: DataFrame, window: int = 128, allow_repeat: bool = False, order: str = "arrival") -> DataFrame:
    """W3: "replay_old" if the index lies a window or more below the highest admitted so far, "replay_fail" if it was admitted before, else "ok".

    The window is rounded up to a multiple of 32. An old packet can't raise the highest index, nor can a repeated one, so the highest
    of all packets before is the highest admitted; and an index is admitted at its first arrival or never.
    """
    size = -(-window // 32) * 32
    again = F.row_number().over(Window.partitionBy("ssrc", "index").orderBy(order)) > 1
    old = F.col("_high") - F.col("index") > size - 1
    repeat = F.lit(allow_repeat)
    return carry(df, ["ssrc"], order, {"_high": ("max_before", F.col("index"))}).withColumn("status", F.when(F.coalesce(old, F.lit(False)), "replay_old").when(again & ~repeat, "replay_fail").otherwise("ok")).drop("_high")


def control_replay_status(df: DataFrame, order: str = "arrival", window: int = 128) -> DataFrame:
    """The same for an explicit index; the window starts at 0 and then ends at the highest index."""
    again = F.row_number().over(Window.partitionBy("ssrc", "index").orderBy(order)) > 1
    start = F.greatest(F.lit(0), F.coalesce("_high", F.lit(0)) - (window - 1))
    return carry(df, ["ssrc"], order, {"_high": ("max_before", F.col("index"))}).withColumn("_start", start).drop("_high").withColumn("status", F.when(F.col("index") < F.col("_start"), "replay_old").when(again, "replay_fail").otherwise("ok")).drop("_start")


def loss_report(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Packets, distinct indexes, lost ones, gaps, and arrivals below an index seen before, by ssrc."""
    late = F.coalesce(F.col("_high") > F.col("index"), F.lit(False)).cast("long")
    seen = carry(df, ["ssrc"], order, {"_high": ("max_before", F.col("index"))})
    heard = seen.groupBy("ssrc", "index").agg(F.count("*").alias("n"), F.sum(late).alias("late"))
    near = carry(heard, ["ssrc"], "index", {"_before": ("max_before", F.col("index"))})
    return near.withColumn("step", F.col("index") - F.col("_before")).groupBy("ssrc").agg(
        F.sum("n").alias("packets"), F.count("*").alias("distinct_packets"), (F.max("index") - F.min("index") + 1 - F.count("*")).alias("lost"),
        F.count_if(F.col("step") > 1).alias("gaps"), F.sum("late").alias("late"),
    )


def key_budget(df: DataFrame, limit: int, key: str = "ssrc", order: str = "arrival") -> DataFrame:
    """Admitted packets of each key count down from the limit: "ok", "soft" below 65536 left, "hard" at 0, then "key_expired"."""
    if limit < SOFT_LIMIT:
        raise ValueError(f"a key's limit is at least {SOFT_LIMIT}")
    left = limit - F.col("_used")
    state = F.when(left < 0, "key_expired").when(left < 1, "hard").when(left < SOFT_LIMIT, "soft").otherwise("ok")
    used = carry(df, [key], order, {"_used": ("count", F.lit(1))})
    return used.withColumn("packets_left", F.greatest(F.lit(0), left)).withColumn("key_state", state).drop("_used")


def ssrc_collision(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Packets whose direction isn't that of their stream's first packet."""
    return carry(df, ["ssrc"], order, {"first_direction": ("first", F.col("direction"))}).filter("direction <> first_direction")


STATUSES = ["ok", "replay_fail", "replay_old", "no_ctx", "bad_param", "key_expired"]


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Packets of each status by ssrc, a column each."""
    wide = df.groupBy("ssrc").pivot(status, STATUSES).count()
    return wide.select("ssrc", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in STATUSES])


def common_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """Streams that both captures hold."""
    return a.select("ssrc").intersect(b.select("ssrc"))


def resync_epoch(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Like W2 where a row may carry a signalled rollover count ``roc``, which serves from that packet on: indexes are roc << 16 | seq.

    An index more than 32768 ahead of the highest one (0 before any packet) is "pkt_idx_adv": admitted, the window restarts there, and the count is used
    up. One more than 32768 behind is "pkt_idx_old" (rejected: the highest index stays). A count of 0 takes back what is pending. One ssrc
    spreads over all tasks; what remains in order is a step for each signal.
    """
    return carried_scan(df, ["ssrc"], order, EpochScan())


def admit(df: DataFrame, window: int = 128) -> DataFrame:
    """Packets that failed authentication are left out first, as they may never move the window; then W2 and W3."""
    return replay_status(extend_sequence(df.filter("auth_ok")), window)


class AdmissionState:
    """R1's rule for one stream: highest index and the bits of the window below it."""

    def __init__(self, high: int | None = None, bits: int = 0, window: int = 128):
        self.high, self.bits, self.window = high, bits, -(-window // 32) * 32

    def admit(self, seq: int) -> tuple[int, str]:
        i = next_index(self.high, seq)
        if self.high is None or i > self.high:
            shift = 0 if self.high is None else i - self.high
            self.bits = ((self.bits << shift) | 1) & ((1 << self.window) - 1)
            self.high = i
            return i, "ok"
        behind = self.high - i
        if behind > self.window - 1:
            return i, "replay_old"
        if self.bits >> behind & 1:
            return i, "replay_fail"
        self.bits |= 1 << behind
        return i, "ok"

    def rows(self, seqs: Iterator[int]) -> list[tuple[int, str]]:
        return [self.admit(s) for s in seqs]
