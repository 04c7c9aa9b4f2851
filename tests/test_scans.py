"""Scans over ranges of a key against plain ones: hostile arrivals, signalled counts, long filters, one key in all tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamworks.operators import packets as P
from streamworks.operators import scans
from streamworks.operators import signals as S


def highest(high: int, seqs: list[int]) -> int:
    for s in seqs:
        high = max(high, scans.next_index(high, s))
    return high


NUMBERS = st.one_of(st.integers(0, 65535), st.sampled_from([0, 1, 32767, 32768, 32769, 65534, 65535]))


@settings(max_examples=400, deadline=None)
@given(st.lists(NUMBERS, max_size=12), st.lists(st.one_of(st.integers(0, 1 << 20), st.sampled_from([0, 32768, 32769, 65535, 65536, 98304, 98305, 131072])), min_size=1, max_size=20))
def test_transition_is_that_of_the_packets(seqs, highs):
    move = scans.Transition()
    for s in seqs:
        move.packet(s)
    assert [move(h) for h in highs] == [(highest(h, seqs), 0) for h in highs]


def plain_epochs(state: dict, rows: list[tuple[int, int | None]]) -> list[tuple[int, str]]:
    out = []
    for seq, roc in rows:
        if roc is not None:
            state["pending"] = roc
        kind, high = "ok", state["high"]
        i = state["pending"] << 16 | seq if state["pending"] else scans.next_index(high, seq)
        if state["pending"] and i - high > 32768:
            kind, state["pending"] = "pkt_idx_adv", 0
        elif state["pending"] and high - i > 32768:
            kind = "pkt_idx_old"
        out.append((i, kind))
        if kind != "pkt_idx_old":
            state["high"] = max(high, i)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(NUMBERS, st.one_of(st.none(), st.none(), st.none(), st.integers(0, 4))), max_size=10), st.integers(0, 400_000), st.integers(0, 6))
def test_epoch_summary_is_that_of_the_packets(rows, high, pending):
    scan, summary = scans.EpochScan(), scans.EpochScan().summary()
    for seq, roc in rows:
        if roc is not None:
            summary.append((roc, scans.Transition(free=not roc, held=bool(roc))))
        summary[-1][1].packet(seq)
    state = {"high": high, "pending": pending}
    got = scan.after(dict(state), summary)
    plain_epochs(state, rows)
    assert got == state


def hostile(seed: int, n: int) -> list[int]:
    rng, seq, out = random.Random(seed), 60_000, []
    for _ in range(n):
        seq += rng.choice([1, 1, 1, 3, 500, 32767, 32768, 32769, -32768, -40, 20_000])
        out.append(seq % 65536)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sequence_over_many_ranges(spark, seed):
    """One ssrc holds most rows and lies in several ranges, beside keys of a row each, a null key and a tail."""
    hot = [(5, i, s) for i, s in enumerate(hostile(seed, 4000))]
    rows = [*hot, *((k, k, 65535) for k in range(10, 60)), (None, 1, 7), (None, 2, 65535), (4, 0, 40_000), (4, 1, 1)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "ssrc long, arrival long, seq int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = P.extend_sequence(df).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.ssrc, r.arrival): r["index"] for r in found}
    by: dict = {}
    for k, a, s in sorted(rows, key=lambda r: r[1]):
        high = by.get(k, 0)
        i = scans.next_index(high, s)
        assert got[k, a] == i
        by[k] = max(high, i)
    sizes = [sum(r.part == p for r in found if r.ssrc == 5) for p in {r.part for r in found if r.ssrc == 5}]
    assert len(sizes) >= 3 and max(sizes) < 2 * 4000 / len(sizes)


def test_epochs_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(1, i, s, rng.randint(0, 3) if rng.random() < 0.02 else None) for i, s in enumerate(hostile(4, 3000))]
    df = spark.createDataFrame(rows, "ssrc long, arrival long, seq int, roc long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r["index"], r.epoch_status) for r in P.resync_epoch(df).orderBy("arrival").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_epochs({"high": 0, "pending": 0}, [r[2:] for r in rows])


def test_filter_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=5000)
    bank = [{"kind": "high_pass", "fc": 80}, {"kind": "peak", "fc": 1000, "q": 4.0, "gain": 9.0}, {"kind": "low_shelf", "fc": 200, "gain": -6.0}]
    rows = [("s", 0, i, float(v)) for i, v in enumerate(x)] + [("t", 1, i, float(v)) for i, v in enumerate(x[:7])]
    df = spark.createDataFrame(rows, "stream_id string, ch int, n long, x double").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = S.eq_filter(df, bank, 16000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = x
    for b in bank:
        b0, b1, b2, a1, a2 = S.biquad(b["kind"], b["fc"], b.get("q", 0.707), b.get("gain", 0.0), 16000)
        out, s1, s2 = [], 0.0, 0.0
        for v in want:
            y = b0 * v + s1
            s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
            out.append(y)
        want = np.array(out)
    got = {(r.stream_id, r.n): r.x for r in found}
    assert max(abs(got["s", i] - v) for i, v in enumerate(want)) < 1e-9
    assert max(abs(got["t", i] - v) for i, v in enumerate(want[:7])) < 1e-9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "ssrc long, arrival long, seq int, roc long")
    assert P.extend_sequence(empty).collect() == [] and P.resync_epoch(empty).collect() == []
