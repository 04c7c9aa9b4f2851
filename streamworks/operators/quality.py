"""Framing, spectra, and verification of processed signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .signals import local_peaks


def frame_signal(df: DataFrame, size: int, hop: int | None = None) -> DataFrame:
    """Q1: overlapping frames (stream_id, ch, frame_idx, samples); incomplete ones at the end are dropped."""
    hop = hop or size // 2
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - (size - 1)) / F.lit(hop)))
    rows = df.withColumn("frame_idx", F.explode(F.sequence(first, F.floor(F.col("n") / hop))))
    listed = rows.groupBy("stream_id", "ch", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    return listed.filter(F.size("s") == size).select("stream_id", "ch", "frame_idx", F.transform("s", lambda s: s["x"]).alias("samples"))


def _by_array(df: DataFrame, col: str, out: str, fn) -> DataFrame:
    """Applies a numpy function to an array column, all arrays of one length at once."""
    names = [*df.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(batch.schema.get_field_index(col)).to_pylist()
            found: list = [None] * len(arrays)
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(arrays):
                if x:
                    by_size.setdefault(len(x), []).append(i)
            for rows in by_size.values():
                for i, y in zip(rows, fn(np.array([arrays[i] for i in rows], float)), strict=True):
                    found[i] = y.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names)

    return df.mapInArrow(run, schema)


def spectrum_db(df: DataFrame, col: str = "samples") -> DataFrame:
    """Q2: 20 log10(|X| / (N/2) + 1e-12) + 3 of each frame."""
    return _by_array(df, col, "spectrum", lambda x: 20 * np.log10(np.abs(np.fft.rfft(x, axis=1)) / (x.shape[1] / 2) + 1e-12) + 3)


def power_spectrum(df: DataFrame, col: str = "samples") -> DataFrame:
    """|X|^2 of each frame."""
    return _by_array(df, col, "power", lambda x: np.abs(np.fft.rfft(x, axis=1)) ** 2)


def periodogram(df: DataFrame, rate: int, col: str = "samples") -> DataFrame:
    """Q4: one-sided power density with a Hann window and the mean taken away."""

    def psd(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (rate * (w**2).sum())
        p[:, 1 : (n + 1) // 2 if n % 2 else n // 2] *= 2
        return p

    return _by_array(df, col, "psd", psd)


def long_bins(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, bin, p)"""
    return df.select(*keys, F.posexplode(col).alias("bin", "p"))


def max_hold(df: DataFrame, col: str = "spectrum", floor: float = -200.0) -> DataFrame:
    """Q3: the greatest value of each bin over a stream's frames."""
    return long_bins(df, col, ["stream_id"]).groupBy("stream_id", "bin").agg(F.greatest(F.max("p"), F.lit(floor)).alias("level"))


def fundamental(psd: DataFrame, key: str = "stream_id") -> DataFrame:
    """The bin of greatest power (ties: the lowest)."""
    return psd.groupBy(key).agg(F.max_by("bin", F.struct("p", -F.col("bin"))).alias("bin"), F.max("p").alias("p"))


def thd(psd: DataFrame, harmonics: int = 6, key: str = "stream_id", clamp: bool = True) -> DataFrame:
    """Q5: root of the power at harmonics 2 to 6 over that at the fundamental, in dB and percent. Harmonics beyond the last bin hit it, or
    with clamp=False nothing."""
    base = fundamental(psd, key)
    last = psd.groupBy(key).agg(F.max("bin").alias("last"))
    want = base.join(last, key).withColumn("h", F.explode(F.sequence(F.lit(2), F.lit(harmonics)))).withColumn("at", F.col("bin") * F.col("h"))
    want = want.withColumn("at", F.least("at", "last")) if clamp else want.filter("at <= last")
    found = want.select(key, F.col("p").alias("p0"), F.col("bin").alias("bin0"), F.col("at").alias("bin")).join(psd, [key, "bin"])
    ratio = F.sqrt(F.sum("p") / F.first("p0"))
    out = found.groupBy(key).agg(F.first("bin0").alias("bin"), ratio.alias("ratio"))
    return out.select(key, "bin", (20 * F.log10("ratio")).alias("thd_db"), (100 * F.col("ratio")).alias("thd_percent"))


def snr_band(psd: DataFrame, hz_per_bin: float, f0: float = 1000, width: float = 50, key: str = "stream_id") -> DataFrame:
    """Q6: power within ``width`` of f0 over the rest in dB; infinite without noise."""
    inside = F.abs(F.col("bin") * hz_per_bin - f0) <= width
    sums = psd.groupBy(key).agg(F.sum(F.when(inside, F.col("p")).otherwise(0.0)).alias("s"), F.sum(F.when(~inside, F.col("p")).otherwise(0.0)).alias("n"))
    return sums.select(key, F.when(F.col("n") == 0, float("inf")).when(F.col("s") == 0, float("-inf")).otherwise(10 * F.log10(F.col("s") / F.col("n"))).alias("snr_db"))


def response_diff(a: DataFrame, b: DataFrame, hz_a: float, hz_b: float, f0: float, key: str = "stream_id") -> DataFrame:
    """Q7: 10 log10 of the output's density over the input's at the bins nearest to f0; -inf if f0 lies beyond the output's last bin."""
    near = lambda df, hz: df.groupBy(key).agg(F.min_by("p", F.struct(F.abs(F.col("bin") * hz - f0), "bin")).alias("p"), (F.max("bin") * hz).alias("top"))
    both = near(a, hz_a).join(near(b, hz_b).select(key, F.col("p").alias("p_out"), F.col("top").alias("top_out")), key)
    return both.select(key, F.when(F.col("top_out") < f0, float("-inf")).otherwise(10 * F.log10(F.col("p_out")) - 10 * F.log10(F.col("p"))).alias("diff_db"))


def spectral_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q8: Pearson correlation of two log spectra (stream_id, frame_idx, bin, p) over what both have, as (r + 1) / 2, 0 at least."""
    both = a.join(b.withColumnRenamed("p", "q"), ["stream_id", "frame_idx", "bin"])
    return both.groupBy("stream_id").agg(F.greatest(F.lit(0.0), (F.corr("p", "q") + 1) / 2).alias("similarity"))


def transient_preservation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q10: peaks of the output over those of the input (stream_id, frame_idx, energy), 1 at most, 0 without input peaks."""
    count = lambda df, name: local_peaks(df).groupBy("stream_id").agg(F.count("*").alias(name))
    all_ = a.select("stream_id").union(b.select("stream_id")).distinct()
    both = all_.join(count(a, "i"), "stream_id", "left").join(count(b, "o"), "stream_id", "left").fillna(0, ["i", "o"])
    return both.select("stream_id", F.when(F.col("i") == 0, 0.0).otherwise(F.least(F.col("o") / F.col("i"), F.lit(1.0))).alias("preserved"))


#: Fixed values: (metric, comparison, threshold) of the single-file check and of the batch check.
THRESHOLDS = {
    "single": [("thd_db", "<=", -50.0), ("thd_percent", "<=", 1.0), ("snr_db", ">=", 20.0), ("mag_diff", "<=", 3.0)],
    "batch": [("thd_db", "<=", -40.0), ("snr_db", ">=", 20.0), ("mag_diff", "<=", 3.0)],
    "tempo": [("tempo_error", "<=", 15.0), ("f0_error", "<=", 25.0), ("similarity", ">=", 0.5), ("transient", ">=", 0.3)],
}


def quality_verdict(df: DataFrame, preset: str = "single") -> DataFrame:
    """Q11: a pass column for each metric that the table has, and ``passed`` for all of them; a null metric fails."""
    checks: dict[str, Column] = {}
    for metric, op, limit in THRESHOLDS[preset]:
        if metric in df.columns:
            value = F.abs(metric) if metric == "mag_diff" else F.col(metric)
            checks[f"{metric}_passed"] = F.coalesce(value <= limit if op == "<=" else value >= limit, F.lit(False))
    out = df.withColumns(checks)
    return out.withColumn("passed", F.forall(F.array(*[F.col(c) for c in checks]), lambda x: x) if checks else F.lit(True))


def verify_summary(df: DataFrame, keys: list[str], name: str, passed: str = "passed") -> DataFrame:
    """Total, passed and failed, and the sorted names of the failed."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(passed).alias("n_passed"), F.count_if(~F.col(passed)).alias("n_failed"),
        F.array_sort(F.collect_list(F.when(~F.col(passed), F.col(name)))).alias("failed"),
    )


def all_rates(df: DataFrame) -> DataFrame:
    """All rates of either axis."""
    return df.select(F.col("src_rate").alias("rate")).union(df.select("dst_rate")).distinct().orderBy("rate")


def metric_matrix(df: DataFrame, rates: list[int]) -> DataFrame:
    """Q9: (bits, metric, src_rate, a column for each rate); all rates on both axes, null where nothing was measured."""
    wide = df.groupBy("bits", "metric", "src_rate").pivot("dst_rate", rates).agg(F.first("value"))
    grid = df.select("bits", "metric").distinct().withColumn("src_rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    return grid.join(wide, ["bits", "metric", "src_rate"], "left")


def verify_grid(sources: DataFrame, outputs: DataFrame, rates: list[int], bits: list[int]) -> DataFrame:
    """Every (src_rate, bits, dst_rate) of the grid with "ready" or "skipped" (no source or no output row)."""
    spark = sources.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in rates])).alias("src_rate"), F.lit(0).alias("_")
    ).select("src_rate", F.explode(F.array(*[F.lit(b) for b in bits])).alias("bits")).select("src_rate", "bits", F.explode(F.array(*[F.lit(r) for r in rates])).alias("dst_rate"))
    s = sources.select("src_rate", "bits").distinct().withColumn("has_in", F.lit(True))
    o = outputs.select("src_rate", "bits", "dst_rate").distinct().withColumn("has_out", F.lit(True))
    both = grid.join(s, ["src_rate", "bits"], "left").join(o, ["src_rate", "bits", "dst_rate"], "left")
    return both.select("src_rate", "bits", "dst_rate", F.when(F.col("has_in") & F.col("has_out"), "ready").otherwise("skipped").alias("state"))


def codec_report(df: DataFrame, cube: bool = False) -> DataFrame:
    """(codec, rate, channel, bytes_in, bytes_out, cpu): ratio in percent, mean and greatest load."""
    told = [(100 * F.sum("bytes_out") / F.sum("bytes_in")).alias("ratio"), F.avg("cpu").alias("mean_cpu"), F.max("cpu").alias("max_cpu"), F.count("*").alias("n")]
    return df.cube("codec", "rate").agg(*told) if cube else df.groupBy("codec", "rate", "channel").agg(*told)


def spectral_stability(df: DataFrame, frames: int) -> DataFrame:
    """Deviation of each bin's level (stream_id, frame_idx, bin, p) over the last frames **[choice: population standard deviation]**."""
    own = Window.partitionBy("stream_id", "bin").orderBy("frame_idx").rowsBetween(-(frames - 1), 0)
    return df.withColumn("deviation", F.stddev_pop("p").over(own))


def top_bins(df: DataFrame, k: int) -> DataFrame:
    """The k strongest bins of each frame (ties: the lower)."""
    own = Window.partitionBy("stream_id", "frame_idx").orderBy(F.desc("p"), "bin")
    return df.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def howl_candidates(df: DataFrame, power: str = "power", papr: float = 10.0, phpr: float = 20.0, pnpr: float = 10.0, imsd: float | None = None, frames: int = 8) -> DataFrame:
    """Q12: bins whose power stands out (dB) from the frame's mean, from both neighbours, and from two and three times their frequency.

    With ``imsd`` also bins whose level stays within so many dB (W16) over the last ``frames`` frames of the stream.
    The frame's array is indexed, so nothing is joined. Harmonics beyond the last bin don't speak against a bin.
    """
    p = F.col(power)
    db = lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-20)))
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    rows = df.select("stream_id", "frame_idx", p.alias("_p"), mean.alias("_mean"), F.posexplode(power).alias("bin", "p"))
    at = lambda k: F.get("_p", k)
    ratio = lambda other: F.coalesce(db(F.col("p")) - db(other), F.lit(1e9))
    ok = (
        (db(F.col("p")) - db(F.col("_mean")) > papr) & (F.least(ratio(at(F.col("bin") - 1)), ratio(at(F.col("bin") + 1))) > pnpr)
        & (F.least(ratio(at(2 * F.col("bin"))), ratio(at(3 * F.col("bin")))) > phpr) & (F.col("bin") > 0)
    )
    if imsd is None:
        return rows.filter(ok).select("stream_id", "frame_idx", "bin", "p")
    # levels of bins that don't stand out count for stability too
    levels = rows.select("stream_id", "frame_idx", "bin", F.col("p").alias("power"), db(F.col("p")).alias("p"), ok.alias("ok"))
    stable = spectral_stability(levels, frames).filter(F.col("ok") & (F.col("deviation") <= imsd))
    return stable.select("stream_id", "frame_idx", "bin", F.col("power").alias("p"))

