"""Registered queries over media frames, note events and pixels, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import MEDIA_SQL, MIDI_SQL, PIXEL_SQL, ZONE_SQL, media_frames, midi_events, pixels, table, with_sql, zones
from ..functions import text as X
from ..functions.signal import rgb565_unpack, yuv_to_rgb
from ..operators import catalog as C
from ..operators import frame_formats as B
from ..operators import images as I
from ..operators import midi as N
from .signal_queries import R, rounded

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


@query("f2_select_streams", with_sql(MEDIA_SQL) + "SELECT file_id, stream_type, frame_idx FROM media WHERE stream_type = 'video'")
def f2(spark, d):
    return C.select_streams(media_frames(spark, d), 2).select("file_id", "stream_type", "frame_idx")


@query("f3_enable_first_stream", with_sql(MEDIA_SQL) + """, s AS (SELECT DISTINCT file_id, stream_type, stream_id FROM media)
SELECT file_id, stream_type, stream_id, CASE WHEN stream_id = 2 AND stream_type = 'audio' THEN true ELSE row_number() OVER (PARTITION BY file_id, stream_type ORDER BY stream_id) = 1 END AS enabled FROM s""")
def f3(spark, d):
    m = media_frames(spark, d)
    asked = m.filter("stream_id = 2 AND stream_type = 'audio'").select("file_id", "stream_type", "stream_id").distinct().withColumn("enable", F.lit(True))
    return C.enable_first_stream(m, asked)


SEEK = "target AS (SELECT 'f' || o_orderkey AS file_id, CAST(o_custkey % 3000 AS BIGINT) AS pts FROM orders)"


def targets(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("file_id"), (F.col("o_custkey") % 3000).cast("long").alias("pts"))


def _seek(cond: str) -> str:
    return with_sql(MEDIA_SQL, SEEK) + f"""SELECT t.file_id, t.pts, coalesce((SELECT max((m.pts, m.frame_idx)) FROM media m WHERE m.file_id = t.file_id AND m.pts <= t.pts AND {cond})[2], -1) AS frame FROM target t"""


SEEK_SQL = """, best AS (SELECT t.file_id, t.pts, m.frame_idx, row_number() OVER (PARTITION BY t.file_id, t.pts ORDER BY m.pts DESC, m.frame_idx DESC) AS r
  FROM target t LEFT JOIN media m ON m.file_id = t.file_id AND m.pts <= t.pts{cond}) SELECT file_id, pts, CAST(coalesce(frame_idx, -1) AS BIGINT) AS frame FROM best WHERE r = 1"""


@query("j9_seek_as_of", with_sql(MEDIA_SQL, SEEK) + SEEK_SQL.format(cond=""))
def j9(spark, d):
    return C.seek_as_of(targets(spark, d), media_frames(spark, d)).select("file_id", "pts", F.coalesce("found_frame_idx", F.lit(-1)).alias("frame"))


@query("j9_seek_key_frame", with_sql(MEDIA_SQL, SEEK) + SEEK_SQL.format(cond=" AND m.key_frame"))
def j9b(spark, d):
    return C.seek_as_of(targets(spark, d), media_frames(spark, d), accurate=False).select("file_id", "pts", F.coalesce("found_frame_idx", F.lit(-1)).alias("frame"))


@query("j14_pick_variant", """WITH v AS (SELECT l_orderkey AS stream, l_linenumber AS variant, CAST(trunc(l_extendedprice) AS BIGINT) AS bitrate FROM lineitem), r AS (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bitrate <= 40000 DESC, CASE WHEN bitrate <= 40000 THEN -bitrate ELSE bitrate END, CASE WHEN bitrate <= 40000 THEN -variant ELSE variant END) AS r FROM v)
SELECT stream, variant, bitrate FROM r WHERE r = 1""")
def j14(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("variant"), F.col("l_extendedprice").cast("long").alias("bitrate"))
    return C.pick_variant(rows, 40000)


@query("a6_frame_summary", with_sql(MEDIA_SQL) + "SELECT file_id, stream_type, CAST(count(*) AS BIGINT) AS frames, CAST(sum(size) AS BIGINT) AS bytes, CAST(arg_max(pts, frame_idx) AS BIGINT) AS last_pts FROM media GROUP BY 1, 2")
def a6(spark, d):
    return C.frame_summary(media_frames(spark, d))


@query("a16_gop_report", with_sql(MEDIA_SQL) + ", g AS (SELECT *, sum(key_frame::INT) OVER (PARTITION BY file_id ORDER BY frame_idx) AS gop FROM media) SELECT file_id, CAST(gop AS BIGINT) AS gop, CAST(count(*) AS BIGINT) AS frames, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(pts) AS BIGINT) AS first_pts, CAST(max(pts) AS BIGINT) AS last_pts, CAST(count(*) FILTER (key_frame) AS BIGINT) AS key_frames FROM g GROUP BY 1, 2")
def a16(spark, d):
    return C.gop_report(media_frames(spark, d))


TYPED = "typed AS (SELECT *, CASE WHEN key_frame THEN 'I' WHEN frame_idx % 2 = 0 THEN 'P' ELSE 'B' END AS frame_type FROM media)"


@query("a16_gop_report_by_type", with_sql(MEDIA_SQL, TYPED) + ", g AS (SELECT *, sum(key_frame::INT) OVER (PARTITION BY file_id ORDER BY frame_idx) AS gop FROM typed) SELECT file_id, CAST(gop AS BIGINT) AS gop, frame_type, CAST(count(*) AS BIGINT) AS frames, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(pts) AS BIGINT) AS first_pts, CAST(max(pts) AS BIGINT) AS last_pts, CAST(count(*) FILTER (key_frame) AS BIGINT) AS key_frames FROM g GROUP BY 1, 2, 3")
def a16c(spark, d):
    kind = F.when(F.col("key_frame"), "I").when(F.col("frame_idx") % 2 == 0, "P").otherwise("B")
    return C.gop_report(media_frames(spark, d).withColumn("frame_type", kind), "frame_type")


@query("a16_rate_per_second", with_sql(MEDIA_SQL) + "SELECT file_id, CAST(pts // 1000 AS BIGINT) AS second, CAST(count(*) AS BIGINT) AS frames, CAST(sum(size) * 8 AS BIGINT) AS bits FROM media GROUP BY 1, 2")
def a16b(spark, d):
    return C.rate_per_second(media_frames(spark, d))


@query("a17_resume_points", with_sql(MEDIA_SQL) + """, l AS (SELECT file_id, stream_type, stream_id, max(frame_idx) AS i, arg_max(pts, frame_idx) AS pts, arg_max(pos, frame_idx) AS pos FROM media GROUP BY 1, 2, 3)
SELECT file_id, string_agg(stream_type || ':' || stream_id || ':' || i || ':' || pts || ':' || pos, ',' ORDER BY stream_type, stream_id) AS streams FROM l GROUP BY 1""")
def a17(spark, d):
    told = F.array_join(F.transform("streams", lambda s: F.concat_ws(":", s["stream_type"], s["stream_id"], s["frame_idx"], s["pts"], s["pos"])), ",")
    return C.resume_points(media_frames(spark, d)).select("file_id", told.alias("streams"))


@query("w10_slice_index", with_sql(MEDIA_SQL) + "SELECT file_id, frame_idx, CAST((pts - min(pts) OVER (PARTITION BY file_id)) // 1000 AS BIGINT) AS slice_idx FROM media")
def w10(spark, d):
    return C.slice_index(media_frames(spark, d), 1000).select("file_id", "frame_idx", "slice_idx")


@query("w10_slice_at_key_frame", with_sql(MEDIA_SQL) + ", c AS (SELECT *, (pts - min(pts) OVER (PARTITION BY file_id)) // 1000 AS s FROM media) SELECT file_id, frame_idx, CAST(coalesce(max(CASE WHEN key_frame THEN s END) OVER (PARTITION BY file_id ORDER BY pts, frame_idx ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS slice_idx FROM c")
def w10b(spark, d):
    return C.slice_index(media_frames(spark, d), 1000, at_key=True).select("file_id", "frame_idx", "slice_idx")


@query("t4_mux_order", with_sql(MEDIA_SQL) + "SELECT file_id, frame_idx, CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN dts = 0 THEN pts ELSE dts END, stream_type, stream_id, frame_idx) - 1 AS BIGINT) AS place FROM media")
def t4(spark, d):
    return C.mux_order(media_frames(spark, d)).select("file_id", "frame_idx", "place")


@query("a14_tag_facets", "SELECT lang AS author, source AS genre, CAST(count(*) AS BIGINT) AS tracks, CAST(count(DISTINCT n_chars % 50) AS BIGINT) AS albums FROM documents GROUP BY 1, 2")
def a14(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("author"), F.col("source").alias("genre"), (F.col("n_chars") % 50).alias("album"))
    return C.tag_facets(rows)


@query("w9_byte_offsets", "SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS \"offset\" FROM documents")
def w9(spark, d):
    return C.byte_offsets(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


@query("s3_container_types", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'avi' WHEN 2 THEN 'audio_es' WHEN 3 THEN 'none' ELSE 'none' END AS container FROM pages")
def s3(spark, d):
    k = F.col("page_id") % 5
    path = F.concat("url", F.when(k == 0, "/a.MP4").when(k == 1, "/b.avi").when(k == 2, "/c.x.Mp3").when(k == 3, "/d.xyz").otherwise("/noext"))
    return table(spark, d, "pages").select("page_id", F.coalesce(X.container_type(path), F.lit("none")).alias("container"))


@query("f10_parse_sample_name", with_sql(ZONE_SQL) + "SELECT name, zone_ord AS idx, note, vel_min, vel_max FROM zone WHERE name NOT LIKE '% %'")
def f10(spark, d):
    return zones(spark, d).filter("name NOT LIKE '% %'").select("name", X.parse_sample_name(F.col("name")).alias("p")).select("name", "p.idx", "p.note", "p.vel_min", "p.vel_max")


@query("f10_bad_names", "SELECT CAST(count(*) AS BIGINT) AS bad FROM documents WHERE NOT regexp_matches(source || '_' || doc_id || '.wav', '^[0-9]+_')")
def f10b(spark, d):
    names = table(spark, d, "documents").select(F.concat("source", F.lit("_"), "doc_id", F.lit(".wav")).alias("name"))
    return X.bad_names(names, "name")


@query("m14_trim_nul", "SELECT doc_id, md5(text) AS title FROM documents WHERE text = trim(text, ' ')")
def m14(spark, d):
    """Whole texts with NULs and spaces at both ends and a NUL inside."""
    t = F.col("text")
    padded = F.concat(F.lit("\x00 "), F.substring(t, 1, 5), F.lit("\x00"), F.substr(t, F.lit(6), F.length(t)), F.lit(" \x00\x00"))
    return table(spark, d, "documents").filter(t == F.trim(t)).select("doc_id", F.md5(X.trim_nul(padded).cast("binary")).alias("title"))


@query("j6_match_zone", with_sql(MIDI_SQL, ZONE_SQL) + """SELECT m.file_id, m.seq, m.note, m.velocity, coalesce((SELECT arg_min(z.name, z.zone_ord) FROM zone z WHERE z.note = m.note AND m.velocity >= z.vel_min AND m.velocity < CASE WHEN z.vel_max = 127 THEN 128 ELSE z.vel_max END), 'NOT_FOUND') AS zone
FROM midi m WHERE type = 1""")
def j6(spark, d):
    notes = midi_events(spark, d).filter("type = 1").select("file_id", "seq", "note", "velocity")
    return N.match_zone(notes, zones(spark, d))


@query("j7_state_as_of", with_sql(MIDI_SQL) + "SELECT file_id, seq, CAST(coalesce(p, -1) AS INTEGER) AS in_force FROM (SELECT *, last_value(program IGNORE NULLS) OVER (PARTITION BY file_id, channel ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM midi) WHERE type = 1")
def j7(spark, d):
    return N.state_as_of(midi_events(spark, d)).select("file_id", "seq", F.coalesce("in_force", F.lit(-1)).alias("in_force"))


STATE_SQL = """state AS (SELECT *, CASE WHEN type = 3 AND seq % 2 = 0 THEN seq % 5 END AS bank, CASE WHEN type = 2 THEN seq % 16384 - 8192 END AS pitch, CASE WHEN type = 4 THEN velocity END AS pressure FROM midi)"""


@query("j7_channel_state_as_of", with_sql(MIDI_SQL, STATE_SQL) + ", f AS (SELECT file_id, seq, type, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}_in_force" for c in ("bank", "program", "pitch", "pressure")) + """ FROM state WINDOW w AS (PARTITION BY file_id, channel ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT file_id, seq, """ + ", ".join(f"CAST(coalesce({c}_in_force, -1) AS INTEGER) AS {c}_in_force" for c in ("bank", "program", "pitch", "pressure")) + " FROM f WHERE type = 1")
def j7b(spark, d):
    kind = F.col("type")
    rows = midi_events(spark, d).withColumns({"bank": F.when((kind == 3) & (F.col("seq") % 2 == 0), F.col("seq") % 5), "pitch": F.when(kind == 2, F.col("seq") % 16384 - 8192), "pressure": F.when(kind == 4, F.col("velocity"))})
    names = ("bank", "program", "pitch", "pressure")
    return N.state_as_of(rows, names).select("file_id", "seq", *[F.coalesce(f"{c}_in_force", F.lit(-1)).cast("int").alias(f"{c}_in_force") for c in names])


TICKS = """timed AS (SELECT *, sum(delta_ticks) OVER w AS tick, sum(delta_ticks * tempo) OVER w / 480.0::DOUBLE / 1000 AS ms FROM (
  SELECT *, coalesce(last_value(tempo_us IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500000) AS tempo FROM midi) WINDOW w AS (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query("j8_ticks_to_ms", with_sql(MIDI_SQL, TICKS) + f"SELECT file_id, seq, CAST(tick AS BIGINT) AS tick, {R('ms')} AS ms FROM timed")
def j8(spark, d):
    return rounded(N.ticks_to_ms(midi_events(spark, d), 480).select("file_id", "seq", "tick", "ms"))


@query("w8_note_durations", with_sql(MIDI_SQL, TICKS) + ", n AS (SELECT *, lead(type) OVER w AS nt, lead(tick) OVER w AS ne FROM timed WHERE type IN (1, 2) WINDOW w AS (PARTITION BY file_id, channel, note ORDER BY seq)) SELECT file_id, channel, note, seq, velocity, CAST(tick AS BIGINT) AS start, CAST(CASE WHEN nt = 2 THEN ne - tick ELSE -1 END AS BIGINT) AS duration FROM n WHERE type = 1")
def w8(spark, d):
    return N.note_durations(N.ticks_to_ms(midi_events(spark, d), 480)).withColumn("duration", F.coalesce("duration", F.lit(-1)).cast("long"))


@query("a8_instrument_ranges", with_sql(MIDI_SQL) + "SELECT file_id, CAST(min(note) AS INTEGER) AS low, CAST(max(note) AS INTEGER) AS high, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT note) AS BIGINT) AS notes FROM midi WHERE type = 1 GROUP BY 1")
def a8(spark, d):
    return N.instrument_ranges(midi_events(spark, d).filter("type = 1"), "file_id")


@query("a8_instrument_totals", with_sql(MIDI_SQL) + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT file_id) AS BIGINT) AS instruments FROM midi WHERE type = 1")
def a8b(spark, d):
    return N.instrument_totals(midi_events(spark, d).filter("type = 1"), "file_id")


@query("i1_crop", with_sql(PIXEL_SQL) + "SELECT frame_id, CAST(x - 4 AS INTEGER) AS x, CAST(y - 2 AS INTEGER) AS y, r, g, b FROM pixel WHERE x BETWEEN 4 AND 11 AND y BETWEEN 2 AND 9")
def i1(spark, d):
    return I.crop(pixels(spark, d), 4, 2, 8, 8)


@query("i2_rotate", with_sql(PIXEL_SQL) + "SELECT frame_id, CAST(15 - y AS INTEGER) AS x, x AS y, r, g, b FROM pixel")
def i2(spark, d):
    return I.rotate(pixels(spark, d), 90, 16, 16)


@query("i3_scale_down", with_sql(PIXEL_SQL) + ", k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) SELECT frame_id, a.k AS x, c.k AS y, r, g, b FROM pixel JOIN k a ON x = a.k * 16 // 5 JOIN k c ON y = c.k * 16 // 5")
def i3(spark, d):
    return I.scale_down(pixels(spark, d), 16, 16, 5, 5)


@query("i1_crop_frames", with_sql(PIXEL_SQL) + ", w AS (SELECT frame_id FROM pixel GROUP BY 1 HAVING count(*) = 256) SELECT frame_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, md5(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x)) AS data FROM pixel JOIN w USING (frame_id) WHERE x BETWEEN 4 AND 11 AND y BETWEEN 2 AND 9 GROUP BY 1")
def i1b(spark, d):
    return I.crop_frames(I.to_frames(pixels(spark, d)).filter("width = 16 AND height = 16"), 4, 2, 8, 8).select("frame_id", "width", "height", F.md5(F.hex("data").cast("binary")).alias("data"))


@query("i2_rotate_frames", with_sql(PIXEL_SQL) + ", w AS (SELECT frame_id FROM pixel GROUP BY 1 HAVING count(*) = 256) SELECT frame_id, CAST(16 AS INTEGER) AS width, CAST(16 AS INTEGER) AS height, md5(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY x, 15 - y)) AS data FROM pixel JOIN w USING (frame_id) GROUP BY 1")
def i2b(spark, d):
    return I.rotate_frames(I.to_frames(pixels(spark, d)).filter("width = 16 AND height = 16"), 90).select("frame_id", "width", "height", F.md5(F.hex("data").cast("binary")).alias("data"))


AXIS = "least(greatest((m + 0.5::DOUBLE) * {n} / 8 - 0.5, 0), {n} - 1)"
I4_SQL = with_sql(PIXEL_SQL) + f""", size AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixel GROUP BY 1 HAVING count(*) = (max(x) + 1) * (max(y) + 1)),
ax AS (SELECT frame_id, m AS tx, CAST(floor({AXIS.format(n='w')}) AS INTEGER) AS x0, least(CAST(floor({AXIS.format(n='w')}) AS INTEGER) + 1, w - 1) AS x1, {AXIS.format(n='w')} - floor({AXIS.format(n='w')}) AS fx FROM size, range(8) r(m)),
ay AS (SELECT frame_id, m AS ty, CAST(floor({AXIS.format(n='h')}) AS INTEGER) AS y0, least(CAST(floor({AXIS.format(n='h')}) AS INTEGER) + 1, h - 1) AS y1, {AXIS.format(n='h')} - floor({AXIS.format(n='h')}) AS fy FROM size, range(8) r(m)),
t AS (SELECT frame_id, tx, ty, """ + ", ".join(f"CAST(round_even((a.{c} * (1 - fx) + b.{c} * fx) * (1 - fy) + (e.{c} * (1 - fx) + f.{c} * fx) * fy, 0) AS INTEGER) AS {c}" for c in "rgb") + """
  FROM ax JOIN ay USING (frame_id) JOIN pixel a USING (frame_id) JOIN pixel b USING (frame_id) JOIN pixel e USING (frame_id) JOIN pixel f USING (frame_id)
  WHERE a.x = x0 AND a.y = y0 AND b.x = x1 AND b.y = y0 AND e.x = x0 AND e.y = y1 AND f.x = x1 AND f.y = y1)
SELECT frame_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, md5(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY ty, tx)) AS data FROM t GROUP BY 1"""


@query("i4_scale_bilinear", I4_SQL)
def i4(spark, d):
    return I.scale_bilinear(I.to_frames(pixels(spark, d)), 8, 8).select("frame_id", "width", "height", F.md5(F.hex("data").cast("binary")).alias("data"))


YUV = """yuv AS (SELECT frame_id, x, y, r, g, b, CAST(least(greatest(round(16 + l * 219 / 255), 0), 255) AS INTEGER) AS yy, CAST(least(greatest(round(128 + (b - l) / (1 - 0.114::DOUBLE) / 2 * 224 / 255), 0), 255) AS INTEGER) AS u,
  CAST(least(greatest(round(128 + (r - l) / (1 - 0.299::DOUBLE) / 2 * 224 / 255), 0), 255) AS INTEGER) AS v FROM (SELECT *, 0.299::DOUBLE * r + (1 - 0.299::DOUBLE - 0.114::DOUBLE) * g + 0.114::DOUBLE * b AS l FROM pixel))"""


@query("i5_convert_pixels", with_sql(PIXEL_SQL, YUV) + "SELECT frame_id, x, y, yy, u, v, CAST((r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS INTEGER) AS v565 FROM yuv")
def i5(spark, d):
    return I.to_rgb565(I.to_yuv(pixels(spark, d))).select("frame_id", "x", "y", "yy", "u", "v", "v565")


@query("m11_rgb565_unpack", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((r << 3) + (r >> 2) AS INTEGER) AS r, CAST((g << 2) + (g >> 4) AS INTEGER) AS g, CAST((b << 3) + (b >> 2) AS INTEGER) AS b FROM (SELECT *, (v >> 11) & 31 AS r, (v >> 5) & 63 AS g, v & 31 AS b FROM (SELECT *, CAST(l_partkey * 31 % 65536 AS INTEGER) AS v FROM lineitem))")
def m11(spark, d):
    c = rgb565_unpack((F.col("l_partkey") * 31 % 65536).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.r", "c.g", "c.b")


@query("m12_yuv_to_rgb", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(greatest((298 * (y - 16) + 409 * (v - 128) + 128) >> 8, 0), 255) AS INTEGER) AS r, CAST(least(greatest((298 * (y - 16) - 100 * (u - 128) - 208 * (v - 128) + 128) >> 8, 0), 255) AS INTEGER) AS g,
  CAST(least(greatest((298 * (y - 16) + 516 * (u - 128) + 128) >> 8, 0), 255) AS INTEGER) AS b FROM (SELECT *, CAST(l_partkey % 256 AS INTEGER) AS y, CAST(l_orderkey % 256 AS INTEGER) AS u, CAST(l_suppkey * 7 % 256 AS INTEGER) AS v FROM lineitem)""")
def m12(spark, d):
    c = yuv_to_rgb((F.col("l_partkey") % 256).cast("int"), (F.col("l_orderkey") % 256).cast("int"), (F.col("l_suppkey") * 7 % 256).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.r", "c.g", "c.b")


@query("a15_max_channel_error", with_sql(PIXEL_SQL) + "SELECT CAST(max(abs(r - ((r >> 3 << 3) + (r >> 5)))) AS INTEGER) AS max_r, CAST(max(abs(g - ((g >> 2 << 2) + (g >> 6)))) AS INTEGER) AS max_g, CAST(max(abs(b - ((b >> 3 << 3) + (b >> 5)))) AS INTEGER) AS max_b FROM pixel")
def a15(spark, d):
    p = pixels(spark, d)
    return I.max_channel_error(p, I.from_rgb565(I.to_rgb565(p)))


WHOLE = "whole AS (SELECT * FROM pixel JOIN (SELECT frame_id FROM pixel GROUP BY 1 HAVING count(*) = 256) USING (frame_id))"


def whole_frames(spark, d):
    return I.to_frames(pixels(spark, d)).filter("width = 16 AND height = 16")


def digests(df):
    return df.select("frame_id", "fmt", "status", F.md5(F.hex("data").cast("binary")).alias("data"))


def in_formats(spark, d, formats, standard="bt601"):
    """The frames in each of some formats, in one pass over them each."""
    frames = whole_frames(spark, d)
    return reduce(DataFrame.unionByName, [digests(B.convert_frames(frames, f, standard)) for f in formats])


def listed(fmt: str, pixel: str, order: str = "y, x", source: str = "whole", each: str = "") -> str:
    """SQL of the digest of a frame whose bytes are ``pixel`` (hexadecimal text) in an order, and any ``each`` planes after them."""
    return f"SELECT frame_id, '{fmt}' AS fmt, 'ok' AS status, md5(string_agg({pixel}, '' ORDER BY {order}){each}) AS data FROM {source} GROUP BY frame_id"


WORD = "CAST(({a} >> 3) * 2048 + (g >> 2) * 32 + ({b} >> 3) AS INTEGER)"
LE, BE = "printf('%02X%02X', {v} & 255, {v} >> 8)", "printf('%02X%02X', {v} >> 8, {v} & 255)"


@query("i5_convert_frames_rgb", with_sql(PIXEL_SQL, WHOLE) + " UNION ALL ".join([
    listed("rgb888", "printf('%02X%02X%02X', r, g, b)"), listed("bgr888", "printf('%02X%02X%02X', b, g, r)"), listed("argb888", "printf('%02X%02X%02XFF', r, g, b)"), listed("abgr888", "printf('%02X%02X%02XFF', b, g, r)"),
    *(listed(f"{name}565_{order}", text.format(v=WORD.format(a=a, b=b))) for name, a, b in (("rgb", "r", "b"), ("bgr", "b", "r")) for order, text in (("le", LE), ("be", BE))),
]))
def i5_rgb(spark, d):
    return in_formats(spark, d, [*B.BYTES, *B.WORDS])


def yuv_sql(standard: str) -> str:
    """Each pixel's y, u, v, and the chroma of blocks of two (c2) and four (c4) pixels."""
    kr, kb = I.STANDARDS[standard]
    part = lambda c, k: f"CAST(least(greatest(floor(128 + ({c} - l) / (1 - {k}::DOUBLE) / 2 * 224 / 255 + 0.5), 0), 255) AS INTEGER)"
    mean = lambda c, k: f"CAST(floor(avg({c}) OVER (PARTITION BY frame_id, x // 2, y // {k}) + 0.5) AS INTEGER)"
    return f"""luma AS (SELECT *, {kr}::DOUBLE * r + (1 - {kr}::DOUBLE - {kb}::DOUBLE) * g + {kb}::DOUBLE * b AS l FROM whole),
yuv0 AS (SELECT frame_id, x, y, CAST(least(greatest(floor(16 + l * 219 / 255 + 0.5), 0), 255) AS INTEGER) AS yy, {part("b", kb)} AS u, {part("r", kr)} AS v FROM luma),
yuv AS (SELECT *, {", ".join(f"{mean(c, k)} AS {c}{2 * k}" for c in "uv" for k in (1, 2))} FROM yuv0)"""


PACKED = "CASE WHEN x % 2 = 0 THEN printf('{0}', {1}, {2}) ELSE printf('{0}', {3}, {4}) END"
PLANE = " || string_agg(printf('%02X', {c}), '' ORDER BY y, x)"
CORNER = " FILTER (x % 2 = 0 AND y % 2 = 0)"


@query("i5_convert_frames_yuv", with_sql(PIXEL_SQL, WHOLE, yuv_sql("bt709")) + " UNION ALL ".join([
    listed("y", "printf('%02X', yy)", source="yuv"), listed("yuv_packet", "printf('%02X%02X%02X', yy, u, v)", source="yuv"),
    listed("yuv_planar", "printf('%02X', yy)", source="yuv", each=PLANE.format(c="u") + PLANE.format(c="v")),
    listed("yuyv", PACKED.format("%02X%02X", "yy", "u2", "yy", "v2"), source="yuv"), listed("uyvy", PACKED.format("%02X%02X", "u2", "yy", "v2", "yy"), source="yuv"),
    listed("i420", "printf('%02X', yy)", source="yuv", each=PLANE.format(c="u4") + CORNER + PLANE.format(c="v4") + CORNER),
    listed("o_uyy_e_vyy", "CASE WHEN x % 2 = 0 THEN printf('%02X', CASE WHEN y % 2 = 0 THEN u4 ELSE v4 END) ELSE '' END || printf('%02X', yy)", source="yuv"),
]))
def i5_yuv(spark, d):
    return in_formats(spark, d, B.SHARED, "bt709")


BACK = "least(greatest(({} + 128) >> 8, 0), 255)"
WY, RV, GU, GV, BU = I.back_weights("bt2020")


@query("i5_convert_frames_back", with_sql(PIXEL_SQL, WHOLE, yuv_sql("bt2020")) + f""", back AS (SELECT frame_id, x, y, CAST({BACK.format(f"{WY} * (yy - 16) + {RV} * (v4 - 128)")} AS INTEGER) AS r,
  CAST({BACK.format(f"{WY} * (yy - 16) - {GU} * (u4 - 128) - {GV} * (v4 - 128)")} AS INTEGER) AS g, CAST({BACK.format(f"{WY} * (yy - 16) + {BU} * (u4 - 128)")} AS INTEGER) AS b FROM yuv) """
  + listed("rgb888", "printf('%02X%02X%02X', r, g, b)", source="back"))
def i5_back(spark, d):
    """To planar YUV with shared chroma, between packed forms, and back."""
    there = B.convert_frames(whole_frames(spark, d), "i420", "bt2020")
    return digests(B.convert_frames(B.convert_frames(there, "o_uyy_e_vyy"), "rgb888", "bt2020"))


@query("i3_scale_down_frames", with_sql(PIXEL_SQL, WHOLE) + ", k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS k), s AS (SELECT frame_id, a.k AS x, c.k AS y, r, g, b FROM whole JOIN k a ON x = a.k * 16 // 5 JOIN k c ON y = c.k * 16 // 5) " + listed("bgr888", "printf('%02X%02X%02X', b, g, r)", source="s"))
def i3_frames(spark, d):
    return digests(B.scale_down_frames(B.convert_frames(whole_frames(spark, d), "bgr888"), 5, 5))


@query("i4_scale_bilinear_pixels", I4_SQL.rpartition("SELECT frame_id, CAST(8")[0] + "SELECT frame_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, r, g, b FROM t WHERE frame_id IN (SELECT frame_id FROM size WHERE w = 16 AND h = 16)")
def i4_pixels(spark, d):
    p = pixels(spark, d)
    whole = whole_frames(spark, d).select("frame_id")
    return B.scale_bilinear(p.join(whole, "frame_id", "left_semi"), 16, 16, 8, 8)
