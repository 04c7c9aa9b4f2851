"""Echoes against their recurrence; resampling by its noise, its aliases and its edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamworks.operators import signals as G

SCHEMA = "stream_id string, ch int, n long, x double"


def table(spark, x, stream="s"):
    return spark.createDataFrame([(stream, 0, i, float(v)) for i, v in enumerate(x)], SCHEMA)


def line(df):
    return np.array([r.x for r in df.orderBy("n").collect()])


@pytest.mark.parametrize(("delay", "feedback"), [(3, 0.95), (1, 0.5), (7, 0.0), (50, 0.8), (2000, 0.9)])
def test_echo_is_the_recurrence(spark, delay, feedback):
    x = np.random.default_rng(1).normal(size=1500)
    wet = np.zeros(len(x))
    for n in range(delay, len(x)):
        wet[n] = x[n - delay] + feedback * wet[n - delay]
    got = line(G.echo(table(spark, x), delay, feedback, 0.5))
    assert np.abs(got - (x + wet) * math.sqrt(0.5)).max() < 1e-9


def test_echo_refuses_and_bypasses(spark):
    df = table(spark, [1.0, 0.0])
    for feedback in (0.96, 1.0, -0.1):
        with pytest.raises(ValueError, match="feedback"):
            G.echo(df, 10, feedback, 0.5)
    assert G.echo(df, 0, 0.5, 0.5) is df


def test_echo_plan_does_not_grow_with_feedback(spark):
    df = table(spark, [1.0])
    plan = lambda feedback: G.echo(df, 10, feedback, 0.5)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(0.95) == plan(0.2)


def test_gaps_are_silence(spark):
    df = spark.createDataFrame([("s", 0, n, 1.0) for n in (0, 1, 9)], SCHEMA)
    got = {r.n: r.x for r in G.echo(df, 4, 0.5, 1.0).collect()}
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(0) and got[9] == pytest.approx(0.5)


def tone(hz, rate, n):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


@pytest.mark.parametrize(("src", "dst"), [(8000, 12000), (44100, 48000), (48000, 16000), (11025, 8000)])
def test_a_tone_stays_a_tone(spark, src, dst):
    n = 1200
    for resample, least in ((G.resample_sinc, 60), (G.resample, 15)):
        got = line(resample(table(spark, tone(1000, src, n)), src, dst))
        want = tone(1000, dst, len(got))
        middle = slice(len(got) // 4, -len(got) // 4)
        error = ((got - want)[middle] ** 2).mean() / (want[middle] ** 2).mean()
        assert -10 * math.log10(error) > least
    assert len(got) == math.ceil(n * dst / src)


def test_aliases_are_gone_and_complexity_tells(spark):
    """A tone above half of the lower rate comes back as another one by interpolation; the filter takes it out."""
    x = table(spark, tone(14_000, 48_000, 2400))
    level = lambda y: 10 * math.log10((y[len(y) // 4 : -len(y) // 4] ** 2).mean() / 0.5)
    assert level(line(G.resample(x, 48_000, 16_000))) > -6
    levels = [level(line(G.resample_sinc(x, 48_000, 16_000, c))) for c in (1, 2, 3)]
    assert levels[1] < -60 and levels[2] < -60
    near = table(spark, tone(8_600, 48_000, 2400))
    assert level(line(G.resample_sinc(near, 48_000, 16_000, 3))) < level(line(G.resample_sinc(near, 48_000, 16_000, 1))) - 20


def test_resampling_edges(spark):
    with pytest.raises(ValueError, match="multiples"):
        G.resample_sinc(table(spark, [1.0]), 8000, 9000)
    assert G.resample_sinc(table(spark, []), 8000, 16_000).collect() == []
    assert len(line(G.resample_sinc(table(spark, [1.0]), 8000, 16_000))) == 2
    flat = line(G.resample_sinc(table(spark, [1.0] * 200), 8000, 12_000))
    assert np.abs(flat[60:-60] - 1).max() < 1e-12


def test_the_taps_are_sent_to_the_samples(spark):
    """Samples of a known, small size: Spark would send them, each as often as it has targets, to the table of taps."""
    x = spark.range(1000).select(F.lit("s").alias("stream_id"), F.lit(0).alias("ch"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    plan = G.resample_sinc(x, 12_000, 8000, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
