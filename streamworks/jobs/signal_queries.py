"""Registered queries over samples and frames, with their SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import FRAME_SQL, SAMPLE_SQL, frames, samples, table, with_sql
from ..functions import signal as M
from ..operators import quality as V
from ..operators import signals as G

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


R = lambda x: f"round({x}, 6) + 0.0"
HALF = "half AS (SELECT stream_id, ch, n, x * 0.9 + CASE WHEN n % 7 = 0 THEN 0.001 ELSE 0 END AS x FROM sample)"


def halved(df):
    return df.withColumn("x", F.col("x") * 0.9 + F.when(F.col("n") % 7 == 0, 0.001).otherwise(0.0))


@query("m1_normalize_sample", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {R('CASE l_linenumber % 4 WHEN 0 THEN (l_partkey % 256 - 128) / 128.0::DOUBLE WHEN 1 THEN l_partkey / 32767.0::DOUBLE WHEN 2 THEN l_partkey / 8388607.0::DOUBLE ELSE l_partkey / 2147483647.0::DOUBLE END')} AS x FROM lineitem")
def m1(spark, d):
    b = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(24), F.lit(32)), F.col("l_linenumber") % 4 + 1)
    v = F.when(b == 8, F.col("l_partkey") % 256).otherwise(F.col("l_partkey"))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", M.normalize_sample(v, b).alias("x")))


@query("m2_convert_bits", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS u, CAST(l_partkey * 31 % 65536 - 32768 AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST((u - 128) * 256 AS BIGINT) AS u8_s16, CAST((u - 128) * 16777216 AS BIGINT) AS u8_s32, CAST(floor(s / 256.0) + 128 AS BIGINT) AS s16_u8, CAST(s * 256 AS BIGINT) AS s16_s24, CAST(s * 65536 AS BIGINT) AS s16_s32 FROM v""")
def m2(spark, d):
    u, s = F.col("l_partkey") % 256, F.col("l_partkey") * 31 % 65536 - 32768
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", M.convert_bits(u, 8, 16).alias("u8_s16"), M.convert_bits(u, 8, 32).alias("u8_s32"), M.convert_bits(s, 16, 8).alias("s16_u8"),
        M.convert_bits(s, 16, 24).alias("s16_s24"), M.convert_bits(s, 16, 32).alias("s16_s32"),
    )


QUAD = "embedding[4 * k + {}]::DOUBLE"


@query("m3_convert_channels", f"SELECT vec_id, CAST(k AS INTEGER) AS k, {R(f'least(greatest({QUAD.format(1)} + {QUAD.format(3)} * 0.707, -0.3), 0.3)')} AS l, {R(f'least(greatest({QUAD.format(2)} + {QUAD.format(4)} * 0.707, -0.3), 0.3)')} AS r FROM (SELECT *, unnest(range(len(embedding) // 4)) AS k FROM embeddings)")
def m3(spark, d):
    """Every vector as samples of four channels."""
    f = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda k: F.slice(F.col("embedding").cast("array<double>"), 4 * k + 1, F.lit(4)))
    each = table(spark, d, "embeddings").select("vec_id", F.posexplode(f).alias("k", "f"))
    both = M.convert_channels(F.col("f"), M.downmix_matrix("quad", "stereo"), 4, 2, clip=0.3)
    return rounded(each.select("vec_id", "k", F.get(both, F.lit(0)).alias("l"), F.get(both, F.lit(1)).alias("r")))


def mix_values() -> str:
    return ", ".join(f"('{a}', '{b}', {c}, {d}, {w}::DOUBLE)" for a, b, c, d, w in M.downmix_weights())


@query("m4_downmix", f"""WITH layout(layout_in, n_in) AS (VALUES {', '.join(f"('{k}', {len(v)})" for k, v in M.LAYOUTS.items())}), mix(layout_in, layout_out, ch, out_ch, weight) AS (VALUES {mix_values()}),
sample AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)),
cut AS (SELECT label, layout_in, i % n_in AS ch, x FROM sample, layout WHERE i // n_in < 64 // n_in)
SELECT label, layout_in, layout_out, CAST(out_ch AS INTEGER) AS out_ch, {R('sum(weight * x)')} AS total FROM cut JOIN mix USING (layout_in, ch) GROUP BY 1, 2, 3, 4""")
def m4(spark, d):
    weights = spark.createDataFrame(M.downmix_rows(), "layout_in string, layout_out string, out_ch int, weights array<double>")
    # a small file becomes some thousand rows for each vector, so vectors are dealt to all tasks first
    e, vectors = F.col("embedding").cast("array<double>"), table(spark, d, "embeddings").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda i: F.slice(e, i * n + 1, F.lit(n)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("layout_in"), cut(len(v)).alias("frames")) for k, v in M.LAYOUTS.items()]))
    frames = vectors.select("label", each.alias("l")).select("label", "l.layout_in", F.explode("l.frames").alias("frame"))
    mixed = G.convert_frames(frames, weights)
    return rounded(mixed.groupBy("label", "layout_in", "layout_out", F.col("ch").cast("int").alias("out_ch")).agg(F.sum("x").alias("total")))


@query("m5_interleave", f"SELECT vec_id, array_to_string(list_transform(range(1, 33), lambda i: printf('%.4f', embedding[i]::DOUBLE) || ',' || printf('%.4f', embedding[i + 32]::DOUBLE)), ',') AS mixed, {R('list_sum(list_transform(range(1, 65, 2), lambda i: embedding[i]::DOUBLE))')} AS first_channel FROM embeddings")
def m5(spark, d):
    e = F.col("embedding").cast("array<double>")
    mixed = M.interleave(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)))
    first = F.get(M.deinterleave(e, 2), F.lit(0))
    told = F.array_join(F.transform(mixed, lambda x: F.format_string("%.4f", x)), ",")
    return rounded(table(spark, d, "embeddings").select("vec_id", told.alias("mixed"), F.aggregate(first, F.lit(0.0), lambda a, x: a + x).alias("first_channel")))


@query("m6_apply_gain", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('least(greatest(l_partkey * CASE WHEN g < -64 THEN 0 ELSE pow(10.0, least(g, 63.0) / 20) END, -32768.0), 32767.0)')} AS x FROM (SELECT *, l_quantity * 3 - 75 AS g FROM lineitem)")
def m6(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.apply_gain(F.col("l_partkey").cast("double"), F.col("l_quantity") * 3 - 75, 16).alias("x")))


CURVES = {"limiter": [(0, -40), (-40, -40), (-100, -100)], "down": [(0, -20), (-40, -40), (-100, -100)], "gate": [(0, 0), (-60, -60), (-61, -100), (-100, -100)]}


@query("m7_curve_db", f"""WITH v AS (SELECT event_id, 3 - value AS x FROM events)
SELECT event_id, {R("CASE WHEN x >= 0 THEN -40.0 WHEN x >= -40 THEN -40.0 WHEN x >= -100 THEN x ELSE -100.0 END")} AS limiter, {R("CASE WHEN x >= 0 THEN -20.0 WHEN x >= -40 THEN -40 + (x + 40) * 0.5 WHEN x >= -100 THEN x ELSE -100.0 END")} AS down,
  {R("CASE WHEN x >= 0 THEN 0.0 WHEN x >= -60 THEN x WHEN x >= -61 THEN -100 + (x + 61) * 40 ELSE -100.0 END")} AS gate FROM v""")
def m7(spark, d):
    x = 3 - F.col("value")
    return rounded(table(spark, d, "events").select("event_id", *[M.curve_db(x, p).alias(k) for k, p in CURVES.items()]))


@query("m8_db_linear", f"SELECT event_id, {R('pow(10.0, (value - 60) / 20)')} AS linear, {R('20 * log10(value + 1e-20)')} AS db FROM events WHERE value > 0")
def m8(spark, d):
    return rounded(table(spark, d, "events").filter("value > 0").select("event_id", M.db_to_linear(F.col("value") - 60).alias("linear"), M.linear_to_db(F.col("value")).alias("db")))


@query("m9_fourcc", "SELECT event_id, CAST(ascii(substr(event_type, 1, 1)) + ascii(substr(event_type, 2, 1)) * 256 + ascii(substr(event_type, 3, 1)) * 65536 + ascii(substr(event_type, 4, 1)) * 16777216 AS BIGINT) AS code, substr(event_type, 1, 4) AS text FROM events")
def m9(spark, d):
    code = M.fourcc_pack(F.substring("event_type", 1, 4))
    return table(spark, d, "events").select("event_id", code.alias("code"), M.fourcc_unpack(code).alias("text"))


@query("m10_image_size", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(CAST(l_partkey AS BIGINT) * l_suppkey * CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 4 ELSE 0 END / 2.0) AS BIGINT) AS bytes FROM lineitem")
def m10(spark, d):
    n = F.col("l_linenumber")
    fmt = F.when(n == 1, "i420").when(n == 2, "rgb565_le").when(n == 3, "rgb888").when(n == 4, "yuyv").otherwise("jpeg")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.image_size(fmt, F.col("l_partkey"), F.col("l_suppkey")).alias("bytes"))


@query("m13_integers", """WITH v AS (SELECT event_id, event_id * 2654435 % 4294967296 AS v FROM events)
SELECT event_id, v AS big_endian, CAST((v // 16777216 % 128) * 2097152 + (v // 65536 % 128) * 16384 + (v // 256 % 128) * 128 + v % 128 AS BIGINT) AS syncsafe FROM v""")
def m13(spark, d):
    raw = F.unhex(F.lpad(F.hex(F.col("event_id") * 2654435 % 4294967296), 8, "0"))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", M.big_endian_int(F.col("raw"), 1, 4).alias("big_endian"), M.syncsafe_int(F.col("raw"), 1).alias("syncsafe"))


@query("m15_tempo_error", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('abs(l_suppkey * 20.0 - l_partkey / (0.5 + l_tax)) / (l_partkey / (0.5 + l_tax)) * 100')} AS error FROM lineitem WHERE l_partkey > 0")
def m15(spark, d):
    return rounded(table(spark, d, "lineitem").filter("l_partkey > 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.tempo_error(F.col("l_partkey"), F.col("l_suppkey") * 20.0, 0.5 + F.col("l_tax")).alias("error")))


LEVELS = "level AS (SELECT stream_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg(x) AS dc FROM {t} GROUP BY 1)"


@query("a4_level_stats", with_sql(SAMPLE_SQL, LEVELS.format(t="sample")) + f"SELECT stream_id, {R('rms')} AS rms, {R('peak')} AS peak, {R('dc')} AS dc FROM level")
def a4(spark, d):
    return rounded(G.level_stats(samples(spark, d)))


@query("a5_rms_dbfs", with_sql(SAMPLE_SQL) + f"SELECT stream_id, {R('20 * log10(sqrt(avg(x * x)) + 1e-20)')} AS dbfs FROM sample GROUP BY 1")
def a5(spark, d):
    return rounded(G.rms_dbfs(samples(spark, d)))


@query("a9_compare_levels", with_sql(SAMPLE_SQL, HALF, LEVELS.format(t="sample"), LEVELS.format(t="half").replace("level AS", "after AS")) + f"""SELECT stream_id, {R('abs(b.rms - a.rms) / a.rms')} AS rms_change, {R('abs(b.peak - a.peak) / a.peak')} AS peak_change,
  {R('abs(b.dc - a.dc)')} AS dc_change, abs(b.rms - a.rms) / a.rms < 0.12 AND abs(b.peak - a.peak) / a.peak < 0.12 AND abs(b.dc - a.dc) < 0.01 AS passed FROM level a JOIN after b USING (stream_id)""")
def a9(spark, d):
    s = samples(spark, d)
    return rounded(G.compare_levels(s, halved(s), 0.12, 0.12))


@query("a10_signal_noise", with_sql(SAMPLE_SQL, HALF) + f"""SELECT stream_id, {R('sum(h.x * h.x)')} AS signal, {R('sum((s.x - h.x) ** 2)')} AS noise, {R('10 * log10(sum(h.x * h.x) / sum((s.x - h.x) ** 2))')} AS snr_db, false AS lossless,
  10 * log10(sum(h.x * h.x) / sum((s.x - h.x) ** 2)) >= 20 AS passed FROM sample s JOIN half h USING (stream_id, ch, n) GROUP BY 1""")
def a10(spark, d):
    s = samples(spark, d)
    return rounded(G.signal_noise(s, halved(s)))


FIRST = """first_{t} AS (SELECT stream_id, ch, min(n) AS n FROM (SELECT *, x > lag(x) OVER w AND x > lead(x) OVER w AND x > 0.5 * max(abs(x)) OVER (PARTITION BY stream_id, ch) AS p FROM {t} WINDOW w AS (PARTITION BY stream_id, ch ORDER BY n)) WHERE p GROUP BY 1, 2)"""
LATE = "late AS (SELECT stream_id, ch, n + 5 + ch AS n, x FROM sample)"


@query("a11_align_lag", with_sql(SAMPLE_SQL, LATE, FIRST.format(t="sample"), FIRST.format(t="late")) + "SELECT stream_id, ch, CAST(b.n - a.n AS BIGINT) AS lag FROM first_sample a JOIN first_late b USING (stream_id, ch)")
def a11(spark, d):
    s = samples(spark, d)
    return G.align_lag(s, s.withColumn("n", F.col("n") + 5 + F.col("ch")))


MIX = "weight AS (SELECT 's' || n_nationkey AS stream_id, CAST(n_nationkey % 3 AS BIGINT) AS mix_id, 0.2 + n_nationkey / 50.0::DOUBLE AS weight FROM nation WHERE n_nationkey < 12)"


@query("j11_mix_streams", with_sql(SAMPLE_SQL, MIX) + f"SELECT mix_id, ch, n, {R('sum(weight * weight * x)')} AS x FROM sample JOIN weight USING (stream_id) GROUP BY 1, 2, 3")
def j11(spark, d):
    k = F.col("n_nationkey")
    weights = table(spark, d, "nation").filter(k < 12).select(F.concat(F.lit("s"), k).alias("stream_id"), (k % 3).cast("long").alias("mix_id"), (0.2 + k / 50).alias("weight"))
    return rounded(G.mix_streams(samples(spark, d), weights))


@query("w12_fade", with_sql(SAMPLE_SQL) + f"SELECT stream_id, ch, n, {R('x * sqrt(1 - least(n / 160.0::DOUBLE, 1.0))')} AS x FROM sample")
def w12(spark, d):
    return rounded(G.fade(samples(spark, d), "out", "sqrt", 10, 16000))


TARGETS = "target AS (SELECT 's' || (n_nationkey % 16) AS stream_id, CAST(n_nationkey * 9 AS BIGINT) AS n, CAST(n_nationkey % 5 * 4 - 8 AS DOUBLE) AS gain_db FROM nation)"


def targets(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("s"), k % 16).alias("stream_id"), (k * 9).cast("long").alias("n"), (k % 5 * 4 - 8).cast("double").alias("gain_db"))


@query("w11_gain_ramp", with_sql(SAMPLE_SQL, TARGETS) + f""", told AS (SELECT *, coalesce(lag(gain_db) OVER (PARTITION BY stream_id ORDER BY n), 0.0) AS from_db FROM target)
SELECT s.stream_id, s.ch, s.n, {R('s.x')} AS x, {R("coalesce(CASE WHEN t.gain_db >= t.from_db THEN least(t.from_db + (s.n - t.n) // 4, t.gain_db) ELSE greatest(t.from_db - (s.n - t.n) // 4, t.gain_db) END, 0.0)")} AS gain_db
FROM sample s ASOF LEFT JOIN told t ON s.stream_id = t.stream_id AND s.n >= t.n""")
def w11(spark, d):
    return rounded(G.gain_ramp(samples(spark, d), targets(spark, d), 4))


@query("w13_mixer_transition", with_sql(SAMPLE_SQL, TARGETS) + f"""SELECT s.stream_id, s.ch, s.n, {R('s.x')} AS x, {R("coalesce(0.3 + (abs(t.gain_db) / 10 - 0.3) * least((s.n - t.n) / 50.0::DOUBLE, 1.0), 1.0)")} AS weight
FROM sample s ASOF LEFT JOIN target t ON s.stream_id = t.stream_id AND s.n >= t.n""")
def w13(spark, d):
    modes = targets(spark, d).select("stream_id", "n", F.lit(0.3).alias("w_from"), (F.abs("gain_db") / 10).alias("w_to"))
    return rounded(G.mixer_transition(samples(spark, d), modes, 50))


@query("w14_echo", with_sql(SAMPLE_SQL) + "SELECT stream_id, ch, n, round(x * cos(0.25 * pi()) + sin(0.25 * pi()) * (" + " + ".join(f"coalesce(lag(x, {20 * k}) OVER w, 0.0) * {0.2 ** (k - 1)!r}::DOUBLE" for k in range(1, G.echo_taps(0.2) + 1)) + "), 6) + 0.0 AS x FROM sample WINDOW w AS (PARTITION BY stream_id, ch ORDER BY n)")
def w14(spark, d):
    return rounded(G.echo(samples(spark, d), 20, 0.2, 0.5))


@query("q15_resample", with_sql(SAMPLE_SQL) + f""", g AS (SELECT *, lead(x) OVER (PARTITION BY stream_id, ch ORDER BY n) AS nx FROM sample),
m AS (SELECT *, unnest([CAST(ceil(n * 1.5) AS BIGINT), CAST(ceil(n * 1.5) AS BIGINT) + 1]) AS m FROM g)
SELECT stream_id, ch, m AS n, {R("x + coalesce(nx - x, 0.0) * (m * 8000 / 12000.0::DOUBLE - n)")} AS x FROM m WHERE m * 8000 < (n + 1) * 12000""")
def q15(spark, d):
    return rounded(G.resample(samples(spark, d), 8000, 12000))


@query("q15_resample_sinc", with_sql(SAMPLE_SQL) + ", taps(p, k, w) AS (VALUES " + ", ".join(f"({p}, {k}, {w!r}::DOUBLE)" for p, k, w in G.sinc_taps(12000, 8000, 1)) + f"""),
g AS (SELECT stream_id, ch, unnest(range(CAST(ceil((max(n) + 1) * 2 / 3.0) AS BIGINT))) AS m FROM sample GROUP BY 1, 2)
SELECT g.stream_id, g.ch, m AS n, {R("sum(x * w)")} AS x FROM g JOIN taps ON p = m * 3 % 2 JOIN sample s ON s.stream_id = g.stream_id AND s.ch = g.ch AND s.n = m * 3 // 2 + k GROUP BY 1, 2, 3""")
def q15b(spark, d):
    return rounded(G.resample_sinc(samples(spark, d), 12000, 8000, 1))


@query("u2_same_output", with_sql(SAMPLE_SQL) + f"SELECT stream_id, ch, n, {R('x')} AS x, 'a' AS side FROM sample WHERE n % 100 = 0 UNION ALL SELECT stream_id, ch, n, {R('x + 1')}, 'b' FROM sample WHERE n % 100 = 0")
def u2(spark, d):
    s = samples(spark, d)
    return rounded(G.same_output(s, s.withColumn("x", F.when(F.col("n") % 100 == 0, F.col("x") + 1).otherwise(F.col("x")))))


def q13_sql() -> str:
    """The cascade sample by sample; coefficients by the cookbook's formulas, written out again."""
    import math

    def section(kind, fc, q, gain):
        w, amp = 2 * math.pi * fc / 16000, 10 ** (gain / 40)
        cos, alpha = math.cos(w), math.sin(w) / (2 * q)
        if kind == "high_pass":
            rows = ((1 + cos) / 2, -1 - cos, (1 + cos) / 2), (1 + alpha, -2 * cos, 1 - alpha)
        elif kind == "low_pass":
            rows = ((1 - cos) / 2, 1 - cos, (1 - cos) / 2), (1 + alpha, -2 * cos, 1 - alpha)
        elif kind == "peak":
            rows = (1 + alpha * amp, -2 * cos, 1 - alpha * amp), (1 + alpha / amp, -2 * cos, 1 - alpha / amp)
        else:
            k = 2 * math.sqrt(amp) * alpha
            rows = (amp * ((amp + 1) + (amp - 1) * cos + k), -2 * amp * ((amp - 1) + (amp + 1) * cos), amp * ((amp + 1) + (amp - 1) * cos - k)), ((amp + 1) - (amp - 1) * cos + k, 2 * ((amp - 1) - (amp + 1) * cos), (amp + 1) - (amp - 1) * cos - k)
        (b0, b1, b2), (a0, a1, a2) = rows
        return [f"({x!r})::DOUBLE" for x in (b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0)]

    bank = [section("high_pass", 100.0, 0.707, 0.0), section("peak", 1000.0, 1.0, 6.0), section("high_shelf", 4000.0, 0.707, -3.0), section("low_pass", 7000.0, 0.707, 0.0)]
    inner, state, begin = "SELECT s.*, " + ", ".join(f"r.p{i}, r.q{i}" for i in range(4)) + ", s.x AS y0 FROM r JOIN sample s ON s.stream_id = r.stream_id AND s.ch = r.ch AND s.n = r.n + 1", [], []
    for i, (b0, *_) in enumerate(bank):
        inner = f"SELECT *, {b0} * y{i} + p{i} AS y{i + 1} FROM ({inner})"
    for i, (_, b1, b2, a1, a2) in enumerate(bank):
        state.append(f"{b1} * y{i} - {a1} * y{i + 1} + q{i} AS p{i}, {b2} * y{i} - {a2} * y{i + 1} AS q{i}")
        begin.append(f"0.0::DOUBLE AS p{i}, 0.0::DOUBLE AS q{i}")
    return with_sql(SAMPLE_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f""", r AS (
  SELECT DISTINCT stream_id, ch, CAST(-1 AS BIGINT) AS n, {", ".join(begin)}, 0.0::DOUBLE AS x FROM sample
  UNION ALL SELECT stream_id, ch, n, {", ".join(state)}, y4 AS x FROM ({inner})
) SELECT stream_id, ch, n, {R('x')} AS x FROM r WHERE n >= 0"""


@query("q13_eq_filter", q13_sql())
def q13(spark, d):
    bank = [{"kind": "high_pass", "fc": 100.0}, {"kind": "peak", "fc": 1000.0, "q": 1.0, "gain": 6.0}, {"kind": "high_shelf", "fc": 4000.0, "gain": -3.0}, {"kind": "low_pass", "fc": 7000.0}]
    return rounded(G.eq_filter(samples(spark, d), bank, 16000))


def q14_sql(attack: int, release: int, hold: int) -> str:
    """The envelope sample by sample: the curve's gain below the level, smoothed with the attack where it falls, after the hold with the release where it rises."""
    import math

    a, r = math.exp(-1 / attack), math.exp(-1 / release)
    return with_sql(SAMPLE_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f""", l AS (SELECT *, 20 * log10(greatest(abs(x), 1e-10::DOUBLE)) AS db FROM sample),
w AS (SELECT *, CASE WHEN db >= 0 THEN -20 WHEN db >= -40 THEN -40 + (db + 40) * 0.5::DOUBLE WHEN db >= -100 THEN db ELSE -100 END - greatest(db, -100) AS want FROM l),
r AS (
  SELECT DISTINCT stream_id, ch, CAST(-1 AS BIGINT) AS n, 0.0::DOUBLE AS gain, CAST(0 AS BIGINT) AS held, 0.0::DOUBLE AS x FROM sample
  UNION ALL SELECT w.stream_id, w.ch, w.n, CASE WHEN want < gain THEN {a!r}::DOUBLE * gain + (1 - {a!r}::DOUBLE) * want WHEN held > 0 THEN gain ELSE {r!r}::DOUBLE * gain + (1 - {r!r}::DOUBLE) * want END,
    CASE WHEN want < gain THEN {hold} WHEN held > 0 THEN held - 1 ELSE 0 END, w.x FROM r JOIN w ON w.stream_id = r.stream_id AND w.ch = r.ch AND w.n = r.n + 1
) SELECT stream_id, ch, n, {R("x * pow(10.0::DOUBLE, gain / 20)")} AS x FROM r WHERE n >= 0"""


@query("q14_compress", q14_sql(8, 80, 4))
def q14(spark, d):
    return rounded(G.compress(samples(spark, d), CURVES["down"], 8, 80, 4))


@query("q1_frame_signal", with_sql(SAMPLE_SQL) + f""", f AS (SELECT stream_id, ch, n, x, unnest([n // 16, n // 16 - 1]) AS frame_idx FROM sample)
SELECT stream_id, ch, frame_idx, {R('sum(x)')} AS total, {R('sum(x * (n - frame_idx * 16))')} AS moment FROM f WHERE frame_idx >= 0 GROUP BY 1, 2, 3 HAVING count(*) = 32""")
def q1(spark, d):
    f = V.frame_signal(samples(spark, d), 32)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform("samples", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return rounded(f.select("stream_id", "ch", "frame_idx", total.alias("total"), moment.alias("moment")))


DFT = """term AS (SELECT stream_id, frame_idx, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 AS n FROM frame),
spec AS (SELECT stream_id, frame_idx, b.bin, sum(x * cos(2 * pi() * b.bin * n / 64)) ** 2 + sum(x * sin(2 * pi() * b.bin * n / 64)) ** 2 AS p FROM term, (SELECT unnest(range(33)) AS bin) b GROUP BY 1, 2, 3),
db AS (SELECT stream_id, frame_idx, bin, 20 * log10(sqrt(p) / 32 + 1e-12) + 3 AS p FROM spec)"""
SUMMED = "total AS (SELECT stream_id, bin, sum(p) AS p FROM spec GROUP BY 1, 2)"


def power(spark, d):
    return V.long_bins(V.power_spectrum(frames(spark, d)), "power", ["stream_id", "frame_idx"])


def summed(spark, d):
    return power(spark, d).groupBy("stream_id", "bin").agg(F.sum("p").alias("p"))


@query("q2_spectrum_db", with_sql(FRAME_SQL, DFT) + "SELECT stream_id, frame_idx, CAST(bin AS INTEGER) AS bin, round(p, 4) + 0.0 AS p FROM db")
def q2(spark, d):
    return rounded(V.long_bins(V.spectrum_db(frames(spark, d)), "spectrum", ["stream_id", "frame_idx"]), 4)


@query("q3_max_hold", with_sql(FRAME_SQL, DFT) + "SELECT stream_id, CAST(bin AS INTEGER) AS bin, round(greatest(max(p), -200.0), 4) + 0.0 AS level FROM db GROUP BY 1, 2")
def q3(spark, d):
    return rounded(V.max_hold(V.spectrum_db(frames(spark, d))), 4)


@query("q4_periodogram", with_sql(FRAME_SQL) + f""", c AS (SELECT *, list_avg(samples) AS m FROM frame), term AS (SELECT stream_id, frame_idx, (unnest(samples) - m) AS x0, generate_subscripts(samples, 1) - 1 AS n FROM c),
win AS (SELECT *, x0 * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS x, (0.5 - 0.5 * cos(2 * pi() * n / 64)) ** 2 AS w2 FROM term)
SELECT stream_id, frame_idx, CAST(b.bin AS INTEGER) AS bin, round((sum(x * cos(2 * pi() * b.bin * n / 64)) ** 2 + sum(x * sin(2 * pi() * b.bin * n / 64)) ** 2) / (16000 * sum(w2)) * CASE WHEN b.bin IN (0, 32) THEN 1 ELSE 2 END * 1e6, 4) + 0.0 AS p
FROM win, (SELECT unnest(range(33)) AS bin) b GROUP BY 1, 2, b.bin""")
def q4(spark, d):
    found = V.long_bins(V.periodogram(frames(spark, d), 16000), "psd", ["stream_id", "frame_idx"])
    return rounded(found.withColumn("p", F.col("p") * 1e6), 4)


@query("t3_fundamental", with_sql(FRAME_SQL, DFT, SUMMED) + f"SELECT stream_id, CAST(arg_max(bin, p) AS INTEGER) AS bin, {R('max(p)')} AS p FROM total GROUP BY 1")
def t3(spark, d):
    return rounded(V.fundamental(summed(spark, d)))


@query("q5_thd", with_sql(FRAME_SQL, DFT, SUMMED) + f""", base AS (SELECT stream_id, arg_max(bin, p) AS bin, max(p) AS p FROM total GROUP BY 1),
h AS (SELECT b.stream_id, b.bin, b.p AS p0, t.p FROM base b, (SELECT unnest(range(2, 7)) AS k) k, total t WHERE t.stream_id = b.stream_id AND t.bin = least(32, b.bin * k.k))
SELECT stream_id, CAST(bin AS INTEGER) AS bin, {R('20 * log10(sqrt(sum(p) / p0))')} AS thd_db, {R('100 * sqrt(sum(p) / p0)')} AS thd_percent FROM h GROUP BY stream_id, bin, p0""")
def q5(spark, d):
    return rounded(V.thd(summed(spark, d)))


@query("q6_snr_band", with_sql(FRAME_SQL, DFT, SUMMED) + f"SELECT stream_id, {R('10 * log10(sum(CASE WHEN abs(bin * 250 - 1000) <= 250 THEN p ELSE 0 END) / sum(CASE WHEN abs(bin * 250 - 1000) <= 250 THEN 0 ELSE p END))')} AS snr_db FROM total GROUP BY 1")
def q6(spark, d):
    return rounded(V.snr_band(summed(spark, d), 250.0, 1000, 250))


OTHER = "other AS (SELECT stream_id, bin, sum(CASE WHEN frame_idx % 2 = 0 THEN p ELSE 0.5 * p END) AS p FROM spec GROUP BY 1, 2)"


@query("q7_response_diff", with_sql(FRAME_SQL, DFT, SUMMED, OTHER) + f"SELECT t.stream_id, {R('10 * log10(o.p) - 10 * log10(t.p)')} AS diff_db FROM total t JOIN other o USING (stream_id, bin) WHERE bin = 4")
def q7(spark, d):
    other = power(spark, d).groupBy("stream_id", "bin").agg(F.sum(F.when(F.col("frame_idx") % 2 == 0, F.col("p")).otherwise(0.5 * F.col("p"))).alias("p"))
    return rounded(V.response_diff(summed(spark, d), other, 250.0, 250.0, 1000.0))


@query("q8_spectral_similarity", with_sql(FRAME_SQL, DFT) + f"SELECT stream_id, {R('greatest(0, (corr(p, p * p + bin) + 1) / 2)')} AS similarity FROM db GROUP BY 1")
def q8(spark, d):
    a = V.long_bins(V.spectrum_db(frames(spark, d)), "spectrum", ["stream_id", "frame_idx"])
    return rounded(V.spectral_similarity(a, a.withColumn("p", F.col("p") * F.col("p") + F.col("bin"))))


ENERGY = "energy AS (SELECT stream_id, frame_idx, sum(x * x) AS energy FROM (SELECT stream_id, frame_idx, unnest(samples) AS x FROM frame) GROUP BY 1, 2)"
PEAKS = "peak AS (SELECT * FROM (SELECT *, energy > lag(energy) OVER w AND energy > lead(energy) OVER w AND energy >= 0.1 * max(energy) OVER (PARTITION BY stream_id) AS k FROM energy WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)) WHERE k)"


def energies(spark, d):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    return frames(spark, d).select("stream_id", "frame_idx", total.alias("energy"))


@query("w15_local_peaks", with_sql(FRAME_SQL, ENERGY, PEAKS) + f"SELECT stream_id, frame_idx, {R('energy')} AS energy FROM peak")
def w15(spark, d):
    return rounded(G.local_peaks(energies(spark, d)))


@query("q10_transient_preservation", with_sql(FRAME_SQL, ENERGY, PEAKS, PEAKS.replace("peak AS", "peak2 AS").replace("FROM energy", "FROM (SELECT * FROM energy WHERE frame_idx % 3 > 0)")) + f""", c AS (SELECT s.stream_id, (SELECT count(*) FROM peak p WHERE p.stream_id = s.stream_id) AS i, (SELECT count(*) FROM peak2 p WHERE p.stream_id = s.stream_id) AS o FROM (SELECT DISTINCT stream_id FROM energy) s)
SELECT stream_id, {R('CASE WHEN i = 0 THEN 0 ELSE least(o / i::DOUBLE, 1.0) END')} AS preserved FROM c""")
def q10(spark, d):
    e = energies(spark, d)
    return rounded(V.transient_preservation(e, e.filter("frame_idx % 3 > 0")))


@query("t2_top_bins", with_sql(FRAME_SQL, DFT) + f"SELECT stream_id, frame_idx, CAST(bin AS INTEGER) AS bin, {R('p')} AS p, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_idx ORDER BY p DESC, bin) AS rank FROM spec) WHERE rank <= 3")
def t2(spark, d):
    return rounded(V.top_bins(power(spark, d), 3))


@query("w16_spectral_stability", with_sql(FRAME_SQL, DFT) + "SELECT stream_id, frame_idx, CAST(bin AS INTEGER) AS bin, round(p, 4) + 0.0 AS p, round(stddev_pop(p) OVER (PARTITION BY stream_id, bin ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) + 0.0 AS deviation FROM db")
def w16(spark, d):
    return rounded(V.spectral_stability(V.long_bins(V.spectrum_db(frames(spark, d)), "spectrum", ["stream_id", "frame_idx"]), 5), 4)


@query("q12_howl_candidates", with_sql(FRAME_SQL, DFT) + f""", m AS (SELECT *, avg(p) OVER (PARTITION BY stream_id, frame_idx) AS mean, lag(p) OVER w AS lo, lead(p) OVER w AS hi FROM spec WINDOW w AS (PARTITION BY stream_id, frame_idx ORDER BY bin))
SELECT m.stream_id, m.frame_idx, CAST(m.bin AS INTEGER) AS bin, {R('m.p')} AS p FROM m LEFT JOIN spec h2 ON h2.stream_id = m.stream_id AND h2.frame_idx = m.frame_idx AND h2.bin = 2 * m.bin LEFT JOIN spec h3 ON h3.stream_id = m.stream_id AND h3.frame_idx = m.frame_idx AND h3.bin = 3 * m.bin
WHERE m.bin > 0 AND 10 * log10(m.p / mean) > 3 AND coalesce(10 * log10(m.p / lo), 1e9) > 1 AND coalesce(10 * log10(m.p / hi), 1e9) > 1 AND coalesce(10 * log10(m.p / h2.p), 1e9) > 3 AND coalesce(10 * log10(m.p / h3.p), 1e9) > 3""")
def q12(spark, d):
    return rounded(V.howl_candidates(V.power_spectrum(frames(spark, d)), papr=3.0, phpr=3.0, pnpr=1.0))


@query("q12_howl_stable", with_sql(FRAME_SQL, DFT) + f""", m AS (SELECT *, avg(p) OVER (PARTITION BY stream_id, frame_idx) AS mean, lag(p) OVER w AS lo, lead(p) OVER w AS hi,
  stddev_pop(10 * log10(greatest(p, 1e-20))) OVER (PARTITION BY stream_id, bin ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS deviation FROM spec WINDOW w AS (PARTITION BY stream_id, frame_idx ORDER BY bin))
SELECT m.stream_id, m.frame_idx, CAST(m.bin AS INTEGER) AS bin, {R('m.p')} AS p FROM m LEFT JOIN spec h2 ON h2.stream_id = m.stream_id AND h2.frame_idx = m.frame_idx AND h2.bin = 2 * m.bin LEFT JOIN spec h3 ON h3.stream_id = m.stream_id AND h3.frame_idx = m.frame_idx AND h3.bin = 3 * m.bin
WHERE m.bin > 0 AND deviation <= 4 AND 10 * log10(m.p / mean) > 3 AND coalesce(10 * log10(m.p / lo), 1e9) > 1 AND coalesce(10 * log10(m.p / hi), 1e9) > 1 AND coalesce(10 * log10(m.p / h2.p), 1e9) > 3 AND coalesce(10 * log10(m.p / h3.p), 1e9) > 3""")
def q12b(spark, d):
    return rounded(V.howl_candidates(V.power_spectrum(frames(spark, d)), papr=3.0, phpr=3.0, pnpr=1.0, imsd=4.0, frames=4))


@query("q16_band_split_levels", with_sql(FRAME_SQL, DFT) + f"SELECT stream_id, frame_idx, CAST(CASE WHEN bin * 250 < 500 THEN 0 WHEN bin * 250 < 2000 THEN 1 WHEN bin * 250 < 5000 THEN 2 ELSE 3 END AS INTEGER) AS band, {R('sum(p)')} AS energy FROM spec WHERE NOT (bin * 250 >= 500 AND bin * 250 < 2000) GROUP BY 1, 2, 3")
def q16(spark, d):
    return rounded(G.bands(V.power_spectrum(frames(spark, d)), "power", (500, 2000, 5000), 16000, 64, (False, True, False, False)))


RATES = [8000, 11025, 16000, 22050, 44100]
GRID = """measured AS (SELECT CAST(CASE o_custkey % 2 WHEN 0 THEN 16 ELSE 24 END AS INTEGER) AS bits, CAST([8000, 11025, 16000, 22050, 44100][1 + o_orderkey % 5] AS INTEGER) AS src_rate,
  CAST([8000, 11025, 16000, 22050, 44100][1 + o_custkey % 5] AS INTEGER) AS dst_rate, round(-avg(o_totalprice) / 2500, 3) AS thd_db, round(avg(o_totalprice) / 4000, 3) AS snr_db, round(avg(o_totalprice) / 40000, 3) AS mag_diff
  FROM orders WHERE (o_orderkey + o_custkey) % 7 <> 0 GROUP BY 1, 2, 3)"""


def measured(spark, d):
    rate = lambda c: F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col(c) % 5 + 1).cast("int"))
    o = table(spark, d, "orders").filter((F.col("o_orderkey") + F.col("o_custkey")) % 7 != 0)
    keys = o.groupBy(F.when(F.col("o_custkey") % 2 == 0, 16).otherwise(24).alias("bits"), rate("o_orderkey").alias("src_rate"), rate("o_custkey").alias("dst_rate"))
    p = F.avg("o_totalprice")
    return keys.agg(F.round(-p / 2500, 3).alias("thd_db"), F.round(p / 4000, 3).alias("snr_db"), F.round(p / 40000, 3).alias("mag_diff"))


VERDICT = "verdict AS (SELECT *, thd_db <= -40 AS t, snr_db >= 20 AS s, abs(mag_diff) <= 3 AS m FROM measured)"


@query("q11_quality_verdict", with_sql(GRID, VERDICT) + "SELECT bits, src_rate, dst_rate, thd_db, snr_db, mag_diff, t AS thd_db_passed, s AS snr_db_passed, m AS mag_diff_passed, t AND s AND m AS passed FROM verdict")
def q11(spark, d):
    return V.quality_verdict(measured(spark, d), "batch")


@query("a7_verify_summary", with_sql(GRID, VERDICT) + "SELECT bits, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (t AND s AND m) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT (t AND s AND m)) AS BIGINT) AS n_failed, coalesce(string_agg(CASE WHEN NOT (t AND s AND m) THEN src_rate || '_to_' || dst_rate END, ',' ORDER BY src_rate || '_to_' || dst_rate), '') AS failed FROM verdict GROUP BY 1")
def a7(spark, d):
    named = V.quality_verdict(measured(spark, d), "batch").withColumn("name", F.concat("src_rate", F.lit("_to_"), "dst_rate"))
    return V.verify_summary(named, ["bits"], "name").withColumn("failed", F.array_join("failed", ","))


@query("u1_all_rates", with_sql(GRID) + "SELECT src_rate AS rate FROM measured UNION SELECT dst_rate FROM measured")
def u1(spark, d):
    return V.all_rates(measured(spark, d))


@query("q9_metric_matrix", with_sql(GRID) + ", l AS (SELECT bits, 'thd' AS metric, src_rate, dst_rate, thd_db AS value FROM measured UNION ALL SELECT bits, 'snr', src_rate, dst_rate, snr_db FROM measured), g AS (SELECT DISTINCT bits, metric, unnest([8000, 11025, 16000, 22050, 44100])::INTEGER AS src_rate FROM l)\nSELECT g.bits, g.metric, g.src_rate, "
       + ", ".join(f"coalesce(max(value) FILTER (dst_rate = {r}), -1.0) AS \"{r}\"" for r in RATES) + " FROM g LEFT JOIN l USING (bits, metric, src_rate) GROUP BY 1, 2, 3")
def q9(spark, d):
    long = measured(spark, d).select("bits", "src_rate", "dst_rate", F.explode(F.create_map(F.lit("thd"), F.col("thd_db"), F.lit("snr"), F.col("snr_db"))).alias("metric", "value"))
    return V.metric_matrix(long, RATES).fillna(-1.0)


@query("j10_verify_grid", with_sql(GRID) + """, g AS (SELECT s.r AS src_rate, b.b AS bits, t.r AS dst_rate FROM (SELECT unnest([8000, 11025, 16000, 22050, 44100])::INTEGER AS r) s, (SELECT unnest([16, 24, 32])::INTEGER AS b) b, (SELECT unnest([8000, 11025, 16000, 22050, 44100])::INTEGER AS r) t)
SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM measured m WHERE m.src_rate = g.src_rate AND m.bits = g.bits) AND EXISTS (SELECT 1 FROM measured m WHERE m.src_rate = g.src_rate AND m.bits = g.bits AND m.dst_rate = g.dst_rate) THEN 'ready' ELSE 'skipped' END AS state FROM g""")
def j10(spark, d):
    m = measured(spark, d)
    return V.verify_grid(m, m, RATES, [16, 24, 32])


CODEC = "codec AS (SELECT l_returnflag AS codec, CAST(l_linenumber * 8000 AS INTEGER) AS rate, CAST(1 + l_suppkey % 2 AS INTEGER) AS channel, l_extendedprice AS bytes_in, l_extendedprice * (0.05 + l_discount) AS bytes_out, l_quantity AS cpu FROM lineitem)"


def codecs(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("codec"), (F.col("l_linenumber") * 8000).alias("rate"), (1 + F.col("l_suppkey") % 2).cast("int").alias("channel"), F.col("l_extendedprice").alias("bytes_in"),
        (F.col("l_extendedprice") * (0.05 + F.col("l_discount"))).alias("bytes_out"), F.col("l_quantity").alias("cpu"),
    )


@query("a12_codec_report", with_sql(CODEC) + f"SELECT codec, rate, channel, {R('100 * sum(bytes_out) / sum(bytes_in)')} AS ratio, {R('avg(cpu)')} AS mean_cpu, {R('max(cpu)')} AS max_cpu, CAST(count(*) AS BIGINT) AS n FROM codec GROUP BY 1, 2, 3")
def a12(spark, d):
    return rounded(V.codec_report(codecs(spark, d)))


@query("a12_codec_cube", with_sql(CODEC) + f"SELECT coalesce(codec, 'all') AS codec, CAST(coalesce(rate, 0) AS INTEGER) AS rate, {R('100 * sum(bytes_out) / sum(bytes_in)')} AS ratio, {R('avg(cpu)')} AS mean_cpu, {R('max(cpu)')} AS max_cpu, CAST(count(*) AS BIGINT) AS n FROM codec GROUP BY CUBE (codec, rate)")
def a12b(spark, d):
    return rounded(V.codec_report(codecs(spark, d), cube=True).fillna({"codec": "all", "rate": 0}))
