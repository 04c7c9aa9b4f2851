"""Domain tables made from the general star-schema tables, each with the same expression as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.windows import carry, dealt, parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations ('+') and frees ('-') of ten devices; the stack is two made-up return addresses."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 10).alias("device_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "error"), "-").otherwise("+").alias("act"),
        (F.col("event_id") % 4).cast("int").alias("flag"),
        F.col("user_id").alias("addr"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        F.array(F.col("event_id") % 7, F.col("event_id") % 11 + 100).alias("stack"),
        F.col("event_type").alias("module"),
    )


TRACE_SQL = """trace AS (
  SELECT user_id % 10 AS device_id, event_id AS seq, CASE WHEN event_type IN ('view', 'error') THEN '-' ELSE '+' END AS act,
    CAST(event_id % 4 AS INTEGER) AS flag, user_id AS addr, CAST(round(value * 100) AS BIGINT) AS size,
    [event_id % 7, event_id % 11 + 100] AS stack, event_type AS module FROM events)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of some of the trace's return addresses, from the nations: every third is a wrapper file."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(
        F.when(k < 7, k).otherwise(k + 93).alias("addr"),
        F.when(k % 3 == 0, F.concat(F.lit("sys/heap_wrap"), k, F.lit(".c"))).otherwise(F.concat(F.lit("app/mod"), k % 4, F.lit("/f"), k, F.lit(".c"))).alias("path"),
        (k * 10).cast("int").alias("line"),
    )


SYMBOL_SQL = """symbol AS (
  SELECT CAST(CASE WHEN n_nationkey < 7 THEN n_nationkey ELSE n_nationkey + 93 END AS BIGINT) AS addr,
    CASE WHEN n_nationkey % 3 = 0 THEN 'sys/heap_wrap' || n_nationkey || '.c' ELSE 'app/mod' || (n_nationkey % 4) || '/f' || n_nationkey || '.c' END AS path,
    CAST(n_nationkey * 10 AS INTEGER) AS line FROM nation)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of eight sources with wraps, duplicates that come 3 places later and late ones that come 400 places later."""
    e = table(spark, sf_dir, "events")
    later = [(0, F.lit(True)), (3, F.col("event_id") % 50 == 0), (400, F.col("event_id") % 70 == 0)]
    copies = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in later]))
    e = e.withColumn("late", F.explode(copies))
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") % 8).alias("ssrc"),
        (i * 10 + 10 * F.col("late") + F.signum("late").cast("long")).alias("arrival"),
        "ts",
        (((i / 8).cast("long") * 97) % 65536).cast("int").alias("seq"),
        (i * 160 % 4294967296).alias("rtp_ts"),
        F.when(F.col("event_type") == "error", 13).otherwise(96).alias("pt"),
        (F.col("event_type") == "purchase").alias("marker"),
        F.lit(2).alias("version"),
        (i % 5 == 0).alias("has_ext"),
        (i % 3).cast("int").alias("cc"),
        (F.round("value").cast("int") + 12).alias("length"),
        F.when(i % 997 == 0, "out").otherwise("in").alias("direction"),
        F.when(i % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 4)).alias("key_id"),
        (i % 211 != 0).alias("auth_ok"),
    )


PACKET_SQL = """packet AS (
  SELECT user_id % 8 AS ssrc, event_id * 10 + 10 * late + sign(late)::BIGINT AS arrival, ts, CAST(((event_id // 8) * 97) % 65536 AS INTEGER) AS seq,
    event_id * 160 % 4294967296 AS rtp_ts, CASE WHEN event_type = 'error' THEN 13 ELSE 96 END AS pt, event_type = 'purchase' AS marker,
    event_id % 5 = 0 AS has_ext, CAST(event_id % 3 AS INTEGER) AS cc, CAST(round(value) AS INTEGER) + 12 AS length,
    CASE WHEN event_id % 997 = 0 THEN 'out' ELSE 'in' END AS direction,
    CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'k' || (event_id % 4) END AS key_id, event_id % 211 <> 0 AS auth_ok
  FROM events, (VALUES (0), (3), (400)) l(late)
  WHERE late = 0 OR late = 3 AND event_id % 50 = 0 OR late = 400 AND event_id % 70 = 0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen streams of two channels; n counts events of the stream and channel, over buckets (``carry``), as these keys are few whatever the table's size."""
    e = table(spark, sf_dir, "events")
    e = e.select(F.concat(F.lit("s"), F.col("user_id") % 16).alias("stream_id"), (F.col("user_id") / 16).cast("int").alias("c"), "event_id", "value")
    e = e.select("stream_id", (F.col("c") % 2).cast("int").alias("ch"), "event_id", ((F.col("value") - 20) / 500).alias("x"))
    return carry(e, ["stream_id", "ch"], "event_id", {"n": ("count", F.lit(1))}).select("stream_id", "ch", (F.col("n") - 1).alias("n"), "x")


SAMPLE_SQL = """sample AS (
  SELECT 's' || (user_id % 16) AS stream_id, CAST((user_id // 16) % 2 AS INTEGER) AS ch,
    row_number() OVER (PARTITION BY user_id % 16, (user_id // 16) % 2 ORDER BY event_id) - 1 AS n, (value - 20) / 500 AS x FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of 64 samples for each embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("s"), "label").alias("stream_id"), F.col("vec_id").alias("frame_idx"), F.lit(16000).alias("sample_rate"),
        F.lit(1).alias("channel"), F.lit(16).alias("bits"), F.col("embedding").cast("array<double>").alias("samples"),
    )


FRAME_SQL = """frame AS (
  SELECT 's' || label AS stream_id, vec_id AS frame_idx, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)"""


def media_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order and part (line numbers repeat within an order), audio and video by return flag."""
    line = table(spark, sf_dir, "lineitem")
    line = dealt(line, parts_for(line), "l_orderkey")
    key = F.col("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    kept = line.select("*", (n - 1).cast("long").alias("i"))
    return kept.select(
        F.concat(F.lit("f"), key).alias("file_id"),
        F.when(F.col("l_linestatus") == "F", "audio").otherwise("video").alias("stream_type"),
        (F.col("l_suppkey") % 3).cast("int").alias("stream_id"),
        F.col("i").alias("frame_idx"),
        (F.col("i") * 400 + F.col("l_partkey") % 40).alias("pts"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("i") * 400).otherwise(F.lit(0)).cast("long").alias("dts"),
        (F.col("l_returnflag") == "R").alias("key_frame"),
        F.col("l_quantity").cast("long").alias("size"),
        F.col("l_extendedprice").cast("long").alias("pos"),
        F.col("l_linenumber").alias("flag"),
    )


MEDIA_SQL = """media AS (
  SELECT 'f' || l_orderkey AS file_id, CASE WHEN l_linestatus = 'F' THEN 'audio' ELSE 'video' END AS stream_type, CAST(l_suppkey % 3 AS INTEGER) AS stream_id,
    i AS frame_idx, i * 400 + l_partkey % 40 AS pts, CASE WHEN l_linenumber % 2 = 0 THEN i * 400 ELSE 0 END AS dts, l_returnflag = 'R' AS key_frame,
    CAST(l_quantity AS BIGINT) AS size, CAST(trunc(l_extendedprice) AS BIGINT) AS pos, l_linenumber AS flag
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS i FROM lineitem))"""


def midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen files: note on (1), note off (2), program (3), tempo (4), by kind of event."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 4).otherwise(1)
    return e.select(
        F.concat(F.lit("m"), F.col("user_id") % 16).alias("file_id"), F.lit(0).alias("track"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 5).alias("delta_ticks"), kind.alias("type"), (F.col("user_id") % 4).cast("int").alias("channel"),
        (F.col("event_id") % 6 + 22).cast("int").alias("note"), (F.col("value").cast("int") % 128).alias("velocity"),
        F.when(kind == 3, (F.col("event_id") % 128).cast("int")).alias("program"), F.when(kind == 4, 300000 + F.col("event_id") % 7 * 50000).alias("tempo_us"),
    )


MIDI_SQL = """midi AS (
  SELECT 'm' || (user_id % 16) AS file_id, event_id AS seq, event_id % 5 AS delta_ticks, t AS type, CAST(user_id % 4 AS INTEGER) AS channel,
    CAST(event_id % 6 + 22 AS INTEGER) AS note, CAST(trunc(value) AS INTEGER) % 128 AS velocity, CASE WHEN t = 3 THEN CAST(event_id % 128 AS INTEGER) END AS program,
    CASE WHEN t = 4 THEN 300000 + event_id % 7 * 50000 END AS tempo_us
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 1 END AS t FROM events))"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample zones of six notes and three velocity layers, from the nations."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 18")
    k = F.col("n_nationkey").cast("int")
    low = (k % 3) * 40
    return n.select(
        k.alias("zone_ord"), k.alias("idx"), ((k / 3).cast("int") + 22).alias("note"), low.alias("vel_min"), F.when(low == 80, 127).otherwise(low + 40).alias("vel_max"),
        F.concat_ws("_", k, (k / 3).cast("int") + 22, "n_name", low, F.concat(F.when(low == 80, 127).otherwise(low + 40), F.lit(".wav"))).alias("name"),
        F.lit(0).cast("long").alias("offset"), (F.length("n_name") * 100).cast("long").alias("size"),
    )


ZONE_SQL = """zone AS (
  SELECT CAST(n_nationkey AS INTEGER) AS zone_ord, CAST(n_nationkey // 3 + 22 AS INTEGER) AS note, CAST(n_nationkey % 3 * 40 AS INTEGER) AS vel_min,
    CAST(CASE WHEN n_nationkey % 3 = 2 THEN 127 ELSE n_nationkey % 3 * 40 + 40 END AS INTEGER) AS vel_max,
    n_nationkey || '_' || (n_nationkey // 3 + 22) || '_' || n_name || '_' || (n_nationkey % 3 * 40) || '_' || (CASE WHEN n_nationkey % 3 = 2 THEN 127 ELSE n_nationkey % 3 * 40 + 40 END) || '.wav' AS name,
    CAST(length(n_name) * 100 AS BIGINT) AS size FROM nation WHERE n_nationkey < 18)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 16 x 16 pixels, one for each 256 line items of a part."""
    line = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")) - 1
    kept = line.select("*", n.alias("i"))
    return kept.select(
        (F.col("l_suppkey") * 1000 + (F.col("i") / 256).cast("long")).alias("frame_id"), (F.col("i") % 16).cast("int").alias("x"),
        ((F.col("i") / 16).cast("int") % 16).alias("y"), (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_extendedprice").cast("long") % 256).cast("int").alias("b"),
    )


PIXEL_SQL = """pixel AS (
  SELECT l_suppkey * 1000 + i // 256 AS frame_id, CAST(i % 16 AS INTEGER) AS x, CAST((i // 16) % 16 AS INTEGER) AS y, CAST(l_partkey % 256 AS INTEGER) AS r,
    CAST(l_orderkey % 256 AS INTEGER) AS g, CAST(CAST(trunc(l_extendedprice) AS BIGINT) % 256 AS INTEGER) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) - 1 AS i FROM lineitem))"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
