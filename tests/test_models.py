"""Order-dependent operators against plain models on random inputs; golden rows; properties of plans."""

import random

import pytest
from pyspark.sql import functions as F

from streamworks import adapters
from streamworks.functions import signal as M
from streamworks.functions.text import is_playlist_url, normalize_path, parse_sample_name, trim_nul
from streamworks.operators import midi as N
from streamworks.operators import packets as P
from streamworks.operators import signals as G
from streamworks.operators import trace as T
from streamworks.operators.windows import as_of, running_balance
from streamworks.schemas import TRACE_EVENT
from streamworks.sources import tags
from streamworks.sources.trace_log import decode_log, decode_trace_logs, encode_trace_logs


def random_trace(seed, n=300):
    rng = random.Random(seed)
    return [(1, i, rng.choice("+-"), rng.randrange(4), rng.randrange(12), rng.choice([0, 5, 9, 100]), [1, 2], rng.choice(["a", "b"])) for i in range(n)]


def ledger(rows):
    live, used, peak = {}, {}, {}
    for _, _, act, _, addr, size, _, module in rows:
        if act == "+":
            live[addr] = (module, size)
            used[module] = used.get(module, 0) + size
        elif addr in live:
            module, size = live.pop(addr)
            used[module] = used.get(module, 0) - size
        else:
            continue
        peak[module] = max(peak.get(module, 0), used[module])
    return used, peak, {a: s for a, (_, s) in live.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_usage_and_leaks_equal_a_ledger(spark, seed):
    rows = random_trace(seed)
    used, peak, live = ledger(rows)
    df = spark.createDataFrame(rows, TRACE_EVENT)
    got = {r.module: (r.used, r.peak) for r in T.usage_by_module(df).filter("module IS NOT NULL").collect()}
    assert got == {m: (used[m], peak[m]) for m in peak}
    assert {r.addr: r["size"] for r in T.find_leaks(df).collect()} == live


def test_two_level_balance_equals_one_window(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(-9, 10)) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, delta long")
    got = {(r.k, r.seq): (r.balance, r.peak) for r in running_balance(df, ["k"], "seq", "delta", bucket=16).collect()}
    for k in ("a", "b", None):
        total = top = 0
        for _, i, d in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total += d
            top = max(top, total)
            assert got[k, i] == (total, top)


def test_use_after_free_probe(spark):
    df = spark.createDataFrame([(1, 0, "+", 0, 0x3C0B636C, 1024, [1], "m"), (1, 1, "-", 0, 0x3C0B636C, None, None, None)], TRACE_EVENT)
    r = T.last_owner(df, spark.createDataFrame([(1, 0x3C0B6768)], "device_id long, probe long")).collect()[0]
    assert (r.position, r["size"], r.freed) == (1020, 1024, True)


def window_model(seqs, window=128):
    """Bits of a window below the highest index."""
    high, seen, out = None, set(), []
    for s in seqs:
        i = P.next_index(high, s)
        if high is not None and i <= high - window:
            out.append((i, "replay_old"))
        elif i in seen:
            out.append((i, "replay_fail"))
        else:
            seen.add(i)
            high = i if high is None else max(high, i)
            out.append((i, "ok"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_window_model(spark, seed):
    rng, rows, seq = random.Random(seed), [], 65_000
    for n in range(600):
        seq += rng.choice([1, 1, 1, 2, 40])
        rows.append((7, n, (seq - rng.choice([0, 0, 0, 3, 100, 127, 128, 200])) % 65536))
    want = window_model([r[2] for r in rows])
    df = P.extend_sequence(spark.createDataFrame(rows, "ssrc long, arrival long, seq int"))
    got = {r.arrival: (r["index"], r.status) for r in P.replay_status(df, 128).collect()}
    assert [got[n] for n in range(600)] == want
    assert P.AdmissionState(window=128).rows(r[2] for r in rows) == want


def test_wraps_and_budget(spark):
    df = spark.createDataFrame([(1, 0, 65534), (1, 1, 65535), (1, 2, 0), (1, 3, 1)], "ssrc long, arrival long, seq int")
    assert [r["index"] for r in P.extend_sequence(df).orderBy("arrival").collect()] == [65534, 65535, 65536, 65537]
    assert [r["index"] for r in P.extend_sequence_by_wraps(df).orderBy("arrival").collect()] == [65534, 65535, 65536, 65537]
    with pytest.raises(ValueError):
        P.key_budget(df, 65535)


GOLDEN = [
    (8, 16, [0, 64, 128, 255], [-32768, -16384, 0, 32512]), (8, 24, [0, 64, 128, 255], [-8388608, -4194304, 0, 8323072]), (8, 32, [0, 64, 128, 255], [-2147483648, -1073741824, 0, 2130706432]),
    (16, 8, [-32768, -16384, 0, 32767], [0, 64, 128, 255]), (16, 24, [-32768, -16384, 0, 32767], [-8388608, -4194304, 0, 8388352]), (16, 32, [-32768, -16384, 0, 32767], [-2147483648, -1073741824, 0, 2147418112]),
]


@pytest.mark.parametrize("src,dst,values,want", GOLDEN)
def test_bit_conversion(spark, src, dst, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    assert [r[0] for r in df.orderBy("i").select(M.convert_bits(F.col("v"), src, dst)).collect()] == want


def test_channels_and_curves(spark):
    one = spark.range(1)
    frame = F.array(*[F.lit(1000.0)] * 4)
    got = one.select(M.convert_channels(frame, [[1, 0, 0.707, 0], [0, 1, 0.1, 0.707]], 4, 2).alias("a"), M.convert_channels(F.array(F.lit(1000.0), F.lit(1000.0)), [[0.6, 0.5]], 2, 1).alias("b")).first()
    assert got.a == pytest.approx([1707, 1807]) and got.b == pytest.approx([1100])
    gate = [(0, 0), (-60, -60), (-61, -100), (-100, -100)]
    levels = spark.createDataFrame([(float(x),) for x in (0, -30, -60, -60.5, -61, -80, -100, 5)], "x double")
    assert [r[0] for r in levels.select(M.curve_db(F.col("x"), gate)).collect()] == pytest.approx([0, -30, -60, -80, -100, -100, -100, 0])


def test_echo_and_fade(spark):
    df = spark.createDataFrame([("s", 0, n, 16000.0 if n == 0 else 0.0) for n in range(1700)], "stream_id string, ch int, n long, x double")
    got = {r.n: r.x for r in G.echo(df, 1600, 0.5, 0.5).filter("x <> 0").collect()}
    assert set(got) == {0, 1600} and got[1600] > 0
    ones = df.withColumn("x", F.lit(1.0))
    faded = {r.n: r.x for r in G.fade(ones, "in", "line", 100, 16000).collect()}
    assert faded[0] == 0 and faded[800] == pytest.approx(0.5) and faded[1600] == 1 and faded[1699] == 1


def test_filters_by_their_response(spark):
    import math

    rows = [(f"{f}", 0, n, math.sin(2 * math.pi * f * n / 8000)) for f in (100, 3000) for n in range(800)]
    df = spark.createDataFrame(rows, "stream_id string, ch int, n long, x double")
    got = {r.stream_id: r.rms for r in G.level_stats(G.eq_filter(df, [{"kind": "low_pass", "fc": 500.0}], 8000).filter("n > 200")).collect()}
    assert got["100"] > 0.65 and got["3000"] < 0.05
    loud = G.compress(df, [(0, -20), (-40, -40), (-100, -100)], 1, 50)
    assert all(r.rms < 0.35 for r in G.level_stats(loud.filter("n > 200")).collect())


def test_text_columns(spark):
    urls = {"http://a/b.m3u8": True, "http://a/b.m3u8?x": True, "http://a/b.m3u8x": False, "http://a.m3u8/b": False, "b.M3U8": True, "": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.p for r in df.select("u", is_playlist_url(F.col("u")).alias("p")).collect()} == urls
    one = spark.range(1)
    got = one.select(
        normalize_path(F.lit("/x/./proj/a/../b/c.c"), "proj").alias("a"), trim_nul(F.lit("\0 ab\0c \0")).alias("b"), parse_sample_name(F.lit("1_22_Pedal_Hihat_0_40.wav")).alias("c"), parse_sample_name(F.lit("x_1.wav")).alias("d")
    ).first()
    assert got.a == "root/b/c.c" and got.b == "abc" and tuple(got.c) == (1, 22, 0, 40) and got.d is None


def test_log_round_trip_and_truncation(spark):
    rows = random_trace(9, 50)
    df = spark.createDataFrame(rows, TRACE_EVENT)
    got = decode_trace_logs(encode_trace_logs(df)).orderBy("seq").collect()
    assert [(r.act, r.addr) for r in got] == [(r[2], r[4]) for r in rows]
    cut = list(decode_log(b"-\0\1\0\0\0?rest"))
    assert cut[-1][-1] == 6 and len(cut) == 2
    assert list(decode_log(b"")) == []


def _tag(version, frames, flags=0, head=b""):
    body = head
    for name, data in frames:
        size = len(data)
        seven = bytes(size >> s & 127 for s in (21, 14, 7, 0))
        body += name + (size.to_bytes(3, "big") if version == 2 else (seven if version == 4 else size.to_bytes(4, "big")) + b"\0\0") + data
    return b"ID3" + bytes([version, 0, flags]) + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def test_tags():
    v23 = tags.parse_tag(_tag(3, [(b"TIT2", b"\3Song"), (b"TPE1", b"\0Me \0"), (b"TXYZ", b"\3more"), (b"APIC", b"\0image/png\0\3\0DATA"), (b"PRIV", b"zz")]))
    assert (v23["title"], v23["author"], v23["cover_mime"], v23["cover_size"]) == ("Song", "Me", "image/png", 4) and v23["extra"][0]["key"] == "TXYZ"
    assert tags.parse_tag(_tag(2, [(b"TT2", b"\0Old"), (b"TAL", b"\0Al")]))["album"] == "Al"
    assert tags.parse_tag(_tag(4, [(b"TDRC", b"\3" + b"2024" * 40)]))["date"] == "2024" * 40
    assert tags.parse_tag(_tag(3, [(b"TIT2", b"\3X")], 0x40, (6).to_bytes(4, "big") + b"\0" * 6))["title"] == "X"
    assert tags.parse_tag(_tag(9, [])) is None and tags.parse_tag(b"") is None
    v1 = tags.parse_tag(b"TAG" + b"T".ljust(30, b"\0") + b"A".ljust(30) + b"L".ljust(30, b"\0") + b"1999" + b"\0" * 30 + bytes([17]))
    assert (v1["title"], v1["author"], v1["album"], v1["date"], v1["genre"]) == ("T", "A", "L", "1999", "17")


def test_as_of_and_plans(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50)], "k string, t long, v int")
    assert sorted((r.k, r.t, r.found_v) for r in as_of(left, right, ["k"], "t", ["v"]).collect() if r.found_v) == [("a", 5, 50)]
    plan = as_of(left, right, ["k"], "t", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan


def slow_epochs(rows):
    """The rule packet by packet: a pending count serves all packets of a stream until one of them is an advance."""
    state, out = {}, []
    for ssrc, arrival, seq, roc in sorted(rows, key=lambda r: r[1]):
        own = state.setdefault(ssrc, {"high": 0, "pending": 0})
        own["pending"] = own["pending"] if roc is None else roc
        kind, high = "ok", own["high"]
        if own["pending"]:
            i = own["pending"] * 65536 + seq
            kind = "pkt_idx_adv" if i - high > 32768 else "pkt_idx_old" if high - i > 32768 else "ok"
        elif high <= 32768:
            i = seq
        else:  # the index nearest to the highest one
            i = min((e * 65536 + seq for e in (high // 65536 - 1, high // 65536, high // 65536 + 1)), key=lambda x: abs(x - high))
        if kind == "pkt_idx_adv":
            own["pending"] = 0
        if kind != "pkt_idx_old":
            own["high"] = max(high, i)
        out.append((ssrc, arrival, i, kind))
    return sorted(out)


def test_signalled_epochs(spark):
    """A first packet far ahead is an advance; a count stays pending until then; 0 takes it back; hot streams are scanned in small batches."""
    rows = [(1, 0, 100, 3), (1, 1, 200, None), (1, 2, 50, 4), (1, 3, 51, None), (1, 4, 60, 1), (1, 5, 52, None), (1, 6, 53, 0), (1, 7, 54, None)]
    df = spark.createDataFrame(rows, "ssrc long, arrival long, seq int, roc long")
    got = [(r.ssrc, r.arrival, r["index"], r.epoch_status) for r in P.resync_epoch(df).collect()]
    assert sorted(got) == slow_epochs(rows)
    assert [k for *_, k in sorted(got)] == ["pkt_idx_adv", "ok", "pkt_idx_adv", "ok", "pkt_idx_old", "pkt_idx_old", "ok", "ok"]
    import random

    rng = random.Random(4)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 1, 1, 700, -300])
        rows.append((rng.choice([1, 1, 1, 2]), i, at % 65536, rng.choice([None] * 60 + [0, 1, max(0, at // 65536), at // 65536 + 2])))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = [(r.ssrc, r.arrival, r["index"], r.epoch_status) for r in P.resync_epoch(spark.createDataFrame(rows, "ssrc long, arrival long, seq int, roc long")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == slow_epochs(rows)


def test_zones_keep_equal_notes(spark):
    notes = spark.createDataFrame([("a", 60, 10), ("a", 60, 10), ("a", 61, 127), ("a", 62, 1)], "file_id string, note int, velocity int")
    zones = spark.createDataFrame([(60, 2, "late", 0, 127), (60, 1, "first", 0, 64), (61, 1, "top", 100, 127)], "note int, zone_ord int, name string, vel_min int, vel_max int")
    got = sorted((r.note, r.zone) for r in N.match_zone(notes, zones).collect())
    assert got == [(60, "first"), (60, "first"), (61, "top"), (62, "NOT_FOUND")]


def test_gain_ramp_is_interrupted(spark):
    """A new target starts from where the gain is: 2 dB up by sample 8, then down."""
    df = spark.range(24).select(F.lit("s").alias("stream_id"), F.lit(0).alias("ch"), F.col("id").alias("n"), F.lit(1.0).alias("x"))
    targets = spark.createDataFrame([("s", 0, 10.0), ("s", 8, -10.0)], "stream_id string, n long, gain_db double")
    got = [r.gain_db for r in G.gain_ramp(df, targets, 4).orderBy("n").collect()]
    assert got == [0.0] * 4 + [1.0] * 4 + [2.0] * 4 + [1.0] * 4 + [0.0] * 4 + [-1.0] * 4


def test_same_output_counts_rows(spark):
    """Rows as often as one side has more of them, nulls as values, many copies of one row."""
    a = spark.createDataFrame([("x", 1.0)] * 3 + [("y", None)] + [("z", 2.0)] * 9000, "k string, v double")
    b = spark.createDataFrame([(1.0, "x"), (None, "y"), (5.0, None), (2.0, "z")], "v double, k string")
    got = [tuple(r) for r in G.same_output(a, b).collect()]
    assert sorted(got, key=repr) == sorted([("x", 1.0, "a")] * 2 + [("z", 2.0, "a")] * 8999 + [(None, 5.0, "b")], key=repr)


def test_samples_are_numbered_over_buckets(spark, tmp_path):
    """One stream's rows are not one window: no task gets more than a share of them."""
    spark.range(200_000).selectExpr("id AS event_id", "0L AS user_id", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = adapters.samples(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("part").count().collect()]
        assert max(sizes) < 200_000 and sum(sizes) == 200_000
        assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 199_999, 200_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_whole_frames_are_mixed_as_their_samples(spark):
    """Null samples and those without a weight don't count, whatever they are; no shuffle is needed."""
    x, nan = {"stereo": [1.0, None], "quad": [1.0, 2.0, None, 4.0], "5.1": [float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0], "7.1": [0.5 * i for i in range(8)]}, float("nan")
    frames = spark.createDataFrame([(k, v) for k, v in x.items()], "layout_in string, frame array<double>")
    samples = frames.select(F.lit("s").alias("stream_id"), "layout_in", F.posexplode("frame").alias("ch", "x"), F.lit(0).alias("n"))
    weights = spark.createDataFrame(M.downmix_weights(), "layout_in string, layout_out string, ch int, out_ch int, weight double")
    mixed = G.convert_frames(frames, spark.createDataFrame(M.downmix_rows(), "layout_in string, layout_out string, out_ch int, weights array<double>"))
    told = lambda df: sorted((r.layout_in, r.layout_out, r.ch, str(None if r.x is None else round(r.x, 9))) for r in df.collect())
    by_samples = G.convert_layout(samples, weights)
    assert told(mixed) == told(by_samples) and any(r[3] == str(nan) for r in told(mixed))
    assert "Exchange hash" not in mixed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in by_samples._jdf.queryExecution().executedPlan().toString()


def test_downmix_tables():
    from streamworks.functions import signal as M

    for b in M.MIXES:
        assert set(M.MIXES[b]) == set(M.LAYOUTS)
        for a in M.MIXES[b]:
            rows = M.downmix_matrix(a, b)
            assert len(rows) == len(M.LAYOUTS[b]) and {len(r) for r in rows} == {len(M.LAYOUTS[a])}
        assert M.downmix_matrix(b, b) == [[float(i == j) for j in range(len(M.LAYOUTS[b]))] for i in range(len(M.LAYOUTS[b]))]
    assert M.downmix_matrix("mono", "stereo") == [[0.707], [0.707]] and M.downmix_matrix("stereo", "mono") == [[0.707, 0.707]]


def test_compressor_by_hand_and_its_knee(spark):
    """Sample by sample; a knee rounds the corner and changes nothing far from it."""
    import math

    points = [(0.0, -20.0), (-40.0, -40.0), (-100.0, -100.0)]
    xs = [0.5, 0.9, 0.9, 0.001, 0.001, 0.001, 0.8, 0.0, 0.3]
    df = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(xs)], "stream_id string, ch int, n long, x double")
    gain, held, want = 0.0, 0, []
    for x in xs:
        level = 20 * math.log10(max(x, 1e-10))
        goal = (-40 + (level + 40) / 2 if level > -40 else max(level, -100)) - max(level, -100)
        if goal < gain:
            a = math.exp(-1 / 2)
            gain, held = a * gain + (1 - a) * goal, 1
        elif held:
            held -= 1
        else:
            r = math.exp(-1 / 5)
            gain = r * gain + (1 - r) * goal
        want.append(x * 10 ** (gain / 20))
    got = [r.x for r in G.compress(df, points, 2, 5, 1).orderBy("n").collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12
    at = lambda x, knee: G.compress(spark.createDataFrame([("s", 0, 0, x)], "stream_id string, ch int, n long, x double"), points, 1e-9, 1, knee=knee).first().x
    assert abs(at(0.5, 6.0) - at(0.5, 0.0)) < 1e-9 and at(0.01, 6.0) < at(0.01, 0.0)


def test_bilinear():
    import numpy as np

    from streamworks.operators.images import bilinear

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (8, 6, 3)).astype(np.uint8)
    assert np.array_equal(bilinear(a, 6, 8), a)
    half = a.reshape(4, 2, 3, 2, 3).astype(float).mean(axis=(1, 3))
    assert np.abs(bilinear(a, 3, 4) - half).max() <= 0.5
