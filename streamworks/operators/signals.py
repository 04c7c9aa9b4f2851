"""Sample tables (stream_id, ch, n, x) and frame tables: levels, mixing, fades, echoes, filters, resampling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import curve_db, level_agg
from .scans import FilterScan, carried_scan
from .windows import as_of, ordered_scan

BY_CHANNEL = ["stream_id", "ch"]


def level_stats(df: DataFrame, keys: list[str] = ("stream_id",)) -> DataFrame:
    """A4: rms, peak and dc of each stream."""
    return df.groupBy(*keys).agg(level_agg(F.col("x")).alias("l")).select(*keys, "l.rms", "l.peak", "l.dc")


def rms_dbfs(df: DataFrame, full_scale: float = 1.0) -> DataFrame:
    """A5: the level over all frames and channels in dB of full scale."""
    return df.groupBy("stream_id").agg((20 * F.log10(F.sqrt(F.avg(F.col("x") * F.col("x"))) / full_scale + 1e-20)).alias("dbfs"))


def compare_levels(before: DataFrame, after: DataFrame, rms_limit: float = 0.1, peak_limit: float = 0.1, dc_limit: float = 0.01) -> DataFrame:
    """Relative change of rms and peak, absolute change of dc, and whether all stay below their limits."""
    a, b = level_stats(before), level_stats(after).select("stream_id", *[F.col(c).alias(f"{c}_after") for c in ("rms", "peak", "dc")])
    change = lambda c: F.when(F.col(c) != 0, F.abs(F.col(f"{c}_after") - F.col(c)) / F.col(c)).otherwise(F.abs(F.col(f"{c}_after")))
    both = a.join(b, "stream_id").withColumns({"rms_change": change("rms"), "peak_change": change("peak"), "dc_change": F.abs(F.col("dc_after") - F.col("dc"))})
    ok = (F.col("rms_change") < rms_limit) & (F.col("peak_change") < peak_limit) & (F.col("dc_change") < dc_limit)
    return both.select("stream_id", "rms_change", "peak_change", "dc_change", ok.alias("passed"))


def signal_noise(ref: DataFrame, out: DataFrame, lag: int = 0, least_db: float = 20.0) -> DataFrame:
    """A10: 10 log10 of the output's energy over that of its difference to the reference ``lag`` samples before; no noise: lossless."""
    b = out.select(*BY_CHANNEL, (F.col("n") - lag).alias("n"), F.col("x").alias("y"))
    sums = ref.join(b, [*BY_CHANNEL, "n"]).groupBy("stream_id").agg(F.sum(F.col("y") * F.col("y")).alias("signal"), F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("noise"))
    snr = F.when((F.col("noise") > 0) & (F.col("signal") > 0), 10 * F.log10(F.col("signal") / F.col("noise")))
    return sums.select("stream_id", "signal", "noise", snr.alias("snr_db"), (F.col("noise") == 0).alias("lossless"), ((F.col("noise") == 0) | F.coalesce(snr >= least_db, F.lit(False))).alias("passed"))


def first_peak(df: DataFrame, share: float = 0.5) -> DataFrame:
    """The first local maximum above a share of each stream's greatest amplitude."""
    own = Window.partitionBy(*BY_CHANNEL).orderBy("n")
    peak = (F.col("x") > F.lag("x").over(own)) & (F.col("x") > F.lead("x").over(own)) & (F.col("x") > share * F.col("_top"))
    top = df.groupBy(*BY_CHANNEL).agg(F.max(F.abs("x")).alias("_top"))
    return df.join(top, BY_CHANNEL).withColumn("_peak", peak).filter("_peak").groupBy(*BY_CHANNEL).agg(F.min("n").alias("n"))


def align_lag(ref: DataFrame, out: DataFrame) -> DataFrame:
    """How many samples the output's first strong peak comes after the reference's."""
    return first_peak(ref).join(first_peak(out).withColumnRenamed("n", "m"), BY_CHANNEL).select(*BY_CHANNEL, (F.col("m") - F.col("n")).alias("lag"))


def mix_streams(df: DataFrame, weights: DataFrame) -> DataFrame:
    """(mix_id, ch, n, x) as the sum of w^2 x over the streams of a mix (stream_id, mix_id, weight)."""
    w = F.col("weight") * F.col("weight")
    return df.join(weights, "stream_id").groupBy("mix_id", "ch", "n").agg(F.sum(w * F.col("x")).alias("x"))


def convert_layout(df: DataFrame, layouts: DataFrame) -> DataFrame:
    """M3 and M4 on samples: (stream_id, layout_in, ch, n, x) through a table of weights (layout_in, layout_out, ch, out_ch, weight), which is broadcast."""
    mixed = df.join(F.broadcast(layouts), ["layout_in", "ch"]).groupBy("stream_id", "layout_in", "layout_out", F.col("out_ch").alias("ch"), "n")
    return mixed.agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def convert_frames(df: DataFrame, layouts: DataFrame, channels: int = 8) -> DataFrame:
    """``convert_layout`` on whole frames, which needs no shuffle: ``frame`` is an array of up to ``channels`` samples. A row for each output channel, with ``layout_out``,
    ``ch`` and ``x`` instead of the frame and all other columns as they were; ``layouts`` (layout_in, layout_out, out_ch, weights) is broadcast. Null weights and samples count as silence."""
    terms = [F.get("frame", F.lit(i)) * F.get("weights", F.lit(i)) for i in range(channels)]
    x = F.when(F.coalesce(*terms).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms]))
    return df.join(F.broadcast(layouts), "layout_in").select(*[c for c in df.columns if c != "frame"], "layout_out", F.col("out_ch").alias("ch"), x.alias("x"))


def _ramp(t: Column, curve: str) -> Column:
    return {"line": t, "quad": t * t, "sqrt": F.sqrt(t)}[curve]


def fade(df: DataFrame, mode: str, curve: str, ms: int, rate: int) -> DataFrame:
    """Weight 0 to 1 (in) or 1 to 0 (out: the curve run backwards) over the transit, constant after it."""
    steps = max(1, rate * ms // 1000)
    t = F.least(F.col("n") / F.lit(steps), F.lit(1.0))
    weight = _ramp(t if mode == "in" else 1 - t, curve)
    return df.withColumn("x", F.col("x") * weight)


def gain_ramp(df: DataFrame, targets: DataFrame, step_samples: int, start_db: float = 0.0) -> DataFrame:
    """Gain moves one dB for every ``step_samples`` towards the target in force (stream_id, n, gain_db). A new target starts from where the gain is by then."""

    def step(state: dict, part: pa.RecordBatch) -> list:
        out = []
        for n, goal in zip(part.column("n").to_pylist(), part.column("gain_db").to_pylist(), strict=True):
            moved = (n - state["since"]) // step_samples
            at = min(state["from"] + moved, state["goal"]) if state["goal"] >= state["from"] else max(state["from"] - moved, state["goal"])
            state |= {"from": at, "goal": goal, "since": n}
            out.append(float(at))
        return [out]

    told = ordered_scan(targets.withColumn("gain_db", F.col("gain_db").cast("double")), ["stream_id"], "n", "from_db double", lambda: {"from": start_db, "goal": start_db, "since": 0}, step)
    found = as_of(df, told.withColumn("since", F.col("n")), ["stream_id"], "n", ["gain_db", "from_db", "since"])
    moved = F.floor((F.col("n") - F.col("found_since")) / step_samples).cast("double")
    up, down = F.least(F.col("found_from_db") + moved, F.col("found_gain_db")), F.greatest(F.col("found_from_db") - moved, F.col("found_gain_db"))
    db = F.coalesce(F.when(F.col("found_gain_db") >= F.col("found_from_db"), up).otherwise(down), F.lit(start_db))
    return found.select(*df.columns, db.alias("gain_db"))


def mixer_transition(df: DataFrame, modes: DataFrame, transit: int) -> DataFrame:
    """A weight moves in a line between the weights of a mode (stream_id, n, w_from, w_to) over ``transit`` samples."""
    found = as_of(df, modes.withColumn("since", F.col("n")), ["stream_id"], "n", ["w_from", "w_to", "since"])
    t = F.least((F.col("n") - F.col("found_since")) / F.lit(transit), F.lit(1.0))
    return found.select(*df.columns, F.coalesce(F.col("found_w_from") + (F.col("found_w_to") - F.col("found_w_from")) * t, F.lit(1.0)).alias("weight"))


#: The greatest feedback; above it an echo would outlast any stream.
MOST_FEEDBACK = 0.95


def echo_taps(feedback: float, left: float = 1e-12) -> int:
    """After so many echoes less than ``left`` of a sample remains."""
    return 1 if feedback <= 0 else max(1, math.ceil(math.log(left) / math.log(feedback)))


def echo(df: DataFrame, delay: int, feedback: float, mix: float) -> DataFrame:
    """Dry cos + wet sin of an equal-power mix **[choice]**; the k-th echo is feedback^(k-1) times the sample k delays before. 0 is a bypass.

    Samples a whole number of delays apart are a recurrence wet(k) = x(k - 1) + feedback wet(k - 1), so a weighted sum of all that come before. It is taken in
    buckets of as many steps as a millionth remains after: within a bucket as one running sum, and from the totals of the three buckets before, beyond which nothing counts.
    The plan is the same for any feedback, and one long stream is cut by delay and bucket. Numbers ``n`` are a channel's own; one that is missing counts as silence.
    """
    if delay <= 0:
        return df
    if not 0 <= feedback <= MOST_FEEDBACK:
        raise ValueError(f"feedback is between 0 and {MOST_FEEDBACK}")
    size, fb = echo_taps(feedback, 1e-6), F.lit(float(feedback))
    step, own = F.floor(F.col("n") / delay), [*BY_CHANNEL, "_lane", "_bucket"]
    placed = df.withColumns({"_lane": F.pmod("n", F.lit(delay)), "_bucket": F.floor(step / size), "_at": F.pmod(step, F.lit(size))})
    before = F.sum(F.col("x") * F.pow(fb, -F.col("_at"))).over(Window.partitionBy(*own).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_near", F.when(F.col("_at") == 0, 0.0).otherwise(F.coalesce(before, F.lit(0.0)) * F.pow(fb, F.col("_at") - 1)))
    totals = placed.groupBy(*own).agg(F.sum(F.col("x") * F.pow(fb, size - 1 - F.col("_at"))).alias("_total"))
    later = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(feedback ** (size * (k - 1)))).alias("w")) for k in (1, 2, 3)]))
    far = totals.select("*", later.alias("_l")).groupBy(*BY_CHANNEL, "_lane", (F.col("_bucket") + F.col("_l.k")).alias("_bucket")).agg(F.sum(F.col("_total") * F.col("_l.w")).alias("_far"))
    wet = F.col("_near") + F.coalesce("_far", F.lit(0.0)) * F.pow(fb, F.col("_at"))
    angle = mix * math.pi / 2
    found = placed.join(far, own, "left").withColumn("x", F.col("x") * math.cos(angle) + wet * math.sin(angle))
    return found.select(*df.columns)


def local_peaks(df: DataFrame, value: str = "energy", order: str = "frame_idx", share: float = 0.1) -> DataFrame:
    """Strict local maxima of at least a share of the stream's greatest value."""
    own = Window.partitionBy("stream_id").orderBy(order)
    top = F.max(value).over(Window.partitionBy("stream_id"))
    flagged = df.withColumn("_before", F.lag(value).over(own)).withColumn("_after", F.lead(value).over(own)).withColumn("_top", top)
    return flagged.filter((F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after")) & (F.col(value) >= share * F.col("_top"))).select(*df.columns)


def resample(df: DataFrame, src: int, dst: int) -> DataFrame:
    """Q15: linear interpolation on the new time grid, by joins on the two neighbouring samples. Rates are multiples of 4000 or 11025."""
    if any(r % 4000 and r % 11025 for r in (src, dst)):
        raise ValueError("rates are multiples of 4000 or 11025")
    # sample n feeds the target points m with floor(m src / dst) = n, and those with n - 1 there
    m0, m1 = F.ceil(F.col("n") * dst / F.lit(src)), F.ceil((F.col("n") + 1) * dst / F.lit(src)) - 1
    nxt = F.lead("x").over(Window.partitionBy(*BY_CHANNEL).orderBy("n"))
    rows = df.withColumn("_next", nxt).withColumn("m", F.explode(F.filter(F.sequence(m0, F.greatest(m0, m1)), lambda m: m * src < (F.col("n") + 1) * dst)))
    t = (F.col("m") * src) / F.lit(dst) - F.col("n")
    return rows.select(*BY_CHANNEL, F.col("m").alias("n"), (F.col("x") + F.coalesce(F.col("_next") - F.col("x"), F.lit(0.0)) * t).alias("x"))


#: Taps on each side of a target, in samples of the lower rate, by complexity **[choice]**.
HALF_TAPS = {1: 8, 2: 16, 3: 32}


def sinc_taps(src: int, dst: int, complexity: int = 2) -> list[tuple[int, int, float]]:
    """(phase, k, weight): a target between two samples takes the k-th sample after the one at or before it with the weight of its phase, of dst / gcd.

    A sinc up to nine tenths of the lower rate's half, below a Blackman window; each phase's weights add up to 1 **[choice]**.
    """
    phases = dst // math.gcd(src, dst)
    low = min(1.0, dst / src)
    reach = math.ceil(HALF_TAPS[complexity] / low)
    out = []
    for phase in range(phases):
        k = np.arange(1 - reach, reach + 1)
        t = k - phase / phases
        window = np.where(np.abs(t) < reach, 0.42 + 0.5 * np.cos(np.pi * t / reach) + 0.08 * np.cos(2 * np.pi * t / reach), 0.0)
        weight = np.sinc(0.9 * low * t) * window
        out += [(phase, int(i), float(w)) for i, w in zip(k, weight / weight.sum(), strict=True)]
    return out


def resample_sinc(df: DataFrame, src: int, dst: int, complexity: int = 2) -> DataFrame:
    """Q15 at high quality: a windowed sinc by phases. Rates are multiples of 4000 or 11025, complexity is 1 to 3.

    Every sample goes to the targets that it is a tap of and meets its weight by (phase, tap) in a table of a row for each, which is broadcast by hint: its size is unknown
    to Spark, which would rather send all samples to each task. Targets add up their taps, before the shuffle as well. Samples beyond a stream's ends are silence; targets lie between its samples.
    """
    if any(r % 4000 and r % 11025 for r in (src, dst)):
        raise ValueError("rates are multiples of 4000 or 11025")
    taps, g = sinc_taps(src, dst, complexity), math.gcd(src, dst)
    up, down, reach = dst // g, src // g, max(k for _, k, _ in taps)
    table = df.sparkSession.createDataFrame(taps, "_phase long, _k long, _w double")
    first = lambda base: F.ceil(base * up / F.lit(down)).cast("long")  # noqa: E731  the first target at or after a sample
    targets = F.sequence(F.greatest(first(F.col("n") - reach), F.lit(0).cast("long")), first(F.col("n") + reach) - 1)
    met = df.select(*BY_CHANNEL, "n", "x", F.explode(targets).alias("m"))
    met = met.withColumns({"_phase": F.col("m") * down % up, "_k": F.col("n") - F.floor(F.col("m") * down / F.lit(up)).cast("long")})
    summed = met.join(F.broadcast(table), ["_phase", "_k"]).groupBy(*BY_CHANNEL, "m").agg(F.sum(F.col("x") * F.col("_w")).alias("x"), F.max(F.col("_k") == 0).alias("_inside"))
    return summed.filter("_inside").select(*BY_CHANNEL, F.col("m").alias("n"), "x")


def biquad(kind: str, fc: float, q: float, gain: float, rate: int) -> np.ndarray:
    """Second-order section (b0, b1, b2, a1, a2) by the public audio equalizer cookbook **[choice]**."""
    w, amp = 2 * math.pi * fc / rate, 10 ** (gain / 40)
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    if kind == "low_pass":
        b, a = [(1 - c) / 2, 1 - c, (1 - c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "high_pass":
        b, a = [(1 + c) / 2, -(1 + c), (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "peak":
        b, a = [1 + alpha * amp, -2 * c, 1 - alpha * amp], [1 + alpha / amp, -2 * c, 1 - alpha / amp]
    else:
        s, k = (1 if kind == "low_shelf" else -1), 2 * math.sqrt(amp) * alpha
        b = [amp * (amp + 1 - s * (amp - 1) * c + k), s * 2 * amp * (amp - 1 - s * (amp + 1) * c), amp * (amp + 1 - s * (amp - 1) * c - k)]
        a = [amp + 1 + s * (amp - 1) * c + k, -s * 2 * (amp - 1 + s * (amp + 1) * c), amp + 1 + s * (amp - 1) * c - k]
    return np.array([*b, *a[1:]]) / a[0]


def eq_filter(df: DataFrame, bank: list[dict], rate: int, block: int = 64) -> DataFrame:
    """Q13: a cascade of enabled biquads over each stream and channel, in order of n. One long stream spreads over all tasks (``FilterScan``)."""
    sections = [biquad(b["kind"], b["fc"], b.get("q", 0.707), b.get("gain", 0.0), rate) for b in bank if b.get("enabled", True)]
    return carried_scan(df, list(BY_CHANNEL), "n", FilterScan(sections, block)).select(*df.columns)


def static_curve(df: DataFrame, points: list[tuple[float, float]], makeup: float = 0.0) -> DataFrame:
    """M7 on samples: each sample's level goes through the curve; silence stays silent."""
    level = 20 * F.log10(F.abs("x"))
    db = curve_db(level, points, makeup)
    return df.withColumn("x", F.when(F.col("x") == 0, 0.0).otherwise(F.signum("x") * F.pow(F.lit(10.0), db / 20)))


def compress(df: DataFrame, points: list[tuple[float, float]], attack: int, release: int, hold: int = 0, makeup: float = 0.0, knee: float = 0.0) -> DataFrame:
    """Q14: the curve's gain, smoothed in order of n: falling gain with the attack, rising with the release after the hold (all in samples).

    With a ``knee`` (dB) the curve is its own mean over so many dB around the level, which rounds its corners **[choice]**. Gain and hold go on from batch to batch.
    """
    xs, ys = np.array([p[0] for p in points][::-1], float), np.array([p[1] for p in points][::-1], float)
    area = np.concatenate(([0.0], np.cumsum(np.diff(xs) * (ys[1:] + ys[:-1]) / 2)))  # under the curve, from its first point

    def under(x: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(xs, x) - 1, 0, len(xs) - 2)
        inside = np.clip(x, xs[0], xs[-1])
        part = area[at] + (inside - xs[at]) * (ys[at] + np.interp(inside, xs, ys)) / 2
        return part + np.minimum(x - xs[0], 0) * ys[0] + np.maximum(x - xs[-1], 0) * ys[-1]

    def curve(level: np.ndarray) -> np.ndarray:
        return np.interp(level, xs, ys) if knee <= 0 else (under(level + knee / 2) - under(level - knee / 2)) / knee

    a, r = math.exp(-1 / max(attack, 1e-9)), math.exp(-1 / max(release, 1e-9))

    def step(state: dict, part: pa.RecordBatch) -> list:
        x = part.column("x").to_numpy(zero_copy_only=False).astype(float)
        level = 20 * np.log10(np.maximum(np.abs(x), 1e-10))
        want = curve(level) - np.maximum(level, xs[0])
        out, gain, held = np.empty(len(x)), state["gain"], state["held"]
        for i, g in enumerate(want.tolist()):
            if g < gain:
                gain, held = a * gain + (1 - a) * g, hold
            elif held > 0:
                held -= 1
            else:
                gain = r * gain + (1 - r) * g
            out[i] = gain
        state |= {"gain": gain, "held": held}
        return [x * 10 ** ((out + makeup) / 20)]

    return ordered_scan(df, list(BY_CHANNEL), "n", "x double", lambda: {"gain": 0.0, "held": 0}, step).select(*df.columns)


#: Copies of a row that are made from one array.
REPEATS = 1 << 12


def same_output(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two results has more often than the other, as often as that, with their side. Both are counted in one pass."""
    both = a.withColumn("_more", F.lit(1)).unionByName(b.withColumn("_more", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_more").alias("_more")).filter("_more <> 0")
    # repeated in two steps, so that no array holds more than so many places
    left = left.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.abs("_more") - 1) / REPEATS))))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.abs("_more") - F.col("_part") * REPEATS)))
    return left.withColumn("_each", each).select(*a.columns, F.when(F.col("_more") > 0, "a").otherwise("b").alias("side"))


def bands(frames: DataFrame, power: str, edges: tuple[float, float, float], rate: int, size: int, bypass: tuple[bool, ...] = (False,) * 4) -> DataFrame:
    """Q16: energy of four bands of each frame from the power of its spectrum's bins; bypassed bands are left out."""
    rows = frames.select("stream_id", "frame_idx", F.posexplode(power).alias("bin", "p"))
    hz = F.col("bin") * rate / size
    band = F.when(hz < edges[0], 0).when(hz < edges[1], 1).when(hz < edges[2], 2).otherwise(3)
    kept = [i for i, b in enumerate(bypass) if not b]
    return rows.withColumn("band", band).filter(F.col("band").isin(kept)).groupBy("stream_id", "frame_idx", "band").agg(F.sum("p").alias("energy"))
