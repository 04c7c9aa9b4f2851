"""Registered queries over streams, logs and user functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import MEDIA_SQL, TRACE_SQL, media_frames, packets, table, trace_events, with_sql
from ..operators import packets as P
from ..operators import quality as V
from ..shared import new_folder
from ..sources import containers, files, tags, trace_log
from ..streaming import streams as R
from .packet_queries import AUTH, INDEXED, PACKET_SQL, status_sql
from .signal_queries import R as ROUND
from .signal_queries import GRID, RATES, measured, rounded

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


def folder(spark) -> str:
    return new_folder(spark, "stream")


def feed(spark, df, order=None, batches=4, cuts=None):
    """A table as a file stream. With an ``order`` the files come in so many batches, by ranges of it or at ``cuts``, each by all tasks; else in one."""
    place = f"{folder(spark)}/in"
    df = df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
    stream = spark.readStream.schema(df.schema)
    if order is None:
        df.write.parquet(place)
        return stream.parquet(place)
    cuts = cuts or df.agg(F.percentile_approx(order, [i / batches for i in range(1, batches)])).first()[0] or []
    bounds = [None, *cuts, None]
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = df if a is None else df.filter(F.col(order) > a)
        (part if b is None else part.filter(F.col(order) <= b)).repartition(2).write.mode("append").parquet(place)
    return stream.option("maxFilesPerTrigger", 2).parquet(place)


def levels_in(spark, d):
    return table(spark, d, "events").select("ts", F.concat(F.lit("s"), F.col("user_id") % 4).alias("stream_id"), (F.col("value") / 500).alias("x"))


def plain(df):
    """Rounded, with times as the tables have them."""
    return rounded(df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


@query("r1_stream_admit", with_sql(PACKET_SQL, AUTH, status_sql(128)) + "SELECT ssrc, arrival, seq, CAST(index AS BIGINT) AS index, status FROM judged")
def r1(spark, d):
    own = R.stateful_session(spark)
    p = packets(own, d).filter("auth_ok").select("ssrc", "arrival", "seq")
    return R.run_available(R.stream_admit(feed(own, p, "arrival")), folder(own))


@query("r1_stream_admit_approx", with_sql(PACKET_SQL, AUTH, status_sql(128)) + """SELECT ssrc, CAST(count(DISTINCT seq) AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS admitted,
  CAST(count(DISTINCT seq) - count(DISTINCT CASE WHEN status = 'ok' THEN seq END) AS BIGINT) AS wrongly_passed FROM judged GROUP BY ssrc""")
def r1b(spark, d):
    """The approximate form beside the exact one: what passes, what the window admits, and numbers that pass although the window admits none of them."""
    p = packets(spark, d).filter("auth_ok").select("ssrc", "arrival", "seq", "ts")
    passed = R.run_available(R.stream_admit_approx(feed(spark, p), "90 days").drop("ts"), folder(spark)).select("ssrc", "seq", F.lit(1).alias("passed"))
    exact = P.admit(packets(spark, d)).groupBy("ssrc", "seq").agg(F.count_if(F.col("status") == "ok").alias("ok"))
    both = passed.join(exact, ["ssrc", "seq"])
    return both.groupBy("ssrc").agg(F.sum("passed").alias("passed"), F.sum("ok").alias("admitted"), F.count_if(F.col("ok") == 0).alias("wrongly_passed"))


LEVEL_SQL = """WITH e AS (SELECT ts, 's' || (user_id % 4) AS stream_id, value / 500 AS x FROM events), w AS ({w})
SELECT a AS start, a + INTERVAL 1 HOUR AS "end", stream_id, {rms} AS rms, {peak} AS peak, {dc} AS dc, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2, 3
HAVING a + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)"""
TOLD = {"rms": ROUND("sqrt(avg(x * x))"), "peak": ROUND("max(abs(x))"), "dc": ROUND("avg(x)")}


@query("r2_stream_levels", LEVEL_SQL.format(w="SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS a FROM e", **TOLD))
def r2(spark, d):
    return plain(R.run_available(R.stream_levels(feed(spark, levels_in(spark, d)), "1 hour", delay="10 minutes"), folder(spark)))


@query("r3_stream_levels_sliding", LEVEL_SQL.format(w="SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS a FROM e, (VALUES (0), (1)) k(k)", **TOLD))
def r3(spark, d):
    return plain(R.run_available(R.stream_levels(feed(spark, levels_in(spark, d)), "1 hour", "30 minutes", "10 minutes"), folder(spark)))


@query("r4_stream_leak_monitor", with_sql(TRACE_SQL) + """, t AS (SELECT t.*, e.ts, lead(e.ts) OVER (PARTITION BY t.device_id, t.addr ORDER BY t.seq) AS nts FROM trace t JOIN events e ON e.event_id = t.seq)
SELECT device_id, addr, seq, size FROM t WHERE act = '+' AND (epoch_ms(nts) > epoch_ms(ts) + 86400000 OR nts IS NULL AND epoch_ms(ts) + 86400000 <= (SELECT epoch_ms(max(ts)) FROM t) - 60000)""")
def r4(spark, d):
    rows = trace_events(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts"), "seq").select("device_id", "addr", "seq", "act", "size", "ts")
    return R.run_available(R.stream_leak_monitor(feed(spark, rows), 86400), folder(spark))


CALLS = "call AS (SELECT user_id AS device_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'hangup' ELSE 'ring' END AS event FROM events)"


def calls(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "answer").when(F.col("event_type") == "error", "hangup").otherwise("ring")
    return table(spark, d, "events").select(F.col("user_id").alias("device_id"), "ts", F.col("event_id").alias("seq"), kind.alias("event"))


def session_sql(source: str, key: str, gap: str) -> str:
    return f"""s AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts, seq) AS sid FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY {key} ORDER BY ts, seq) + INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM {source}))"""


@query("r5_call_sessions", f"WITH {CALLS}, {session_sql('call', 'device_id', '30 MINUTE')} " + """SELECT device_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS events, arg_max(event, ts) AS last_event,
  CASE WHEN count(*) FILTER (event = 'answer') > 0 THEN 'answered' WHEN count(*) FILTER (event = 'hangup') > 0 THEN 'missed' ELSE 'open' END AS outcome FROM s GROUP BY device_id, sid""")
def r5(spark, d):
    return R.call_sessions(calls(spark, d))


@query("r5_stream_call_sessions", f"WITH {CALLS}, {session_sql('call', 'device_id', '30 MINUTE')} " + """SELECT device_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS events, arg_max(event, ts) AS last_event,
  CASE WHEN count(*) FILTER (event = 'answer') > 0 THEN 'answered' WHEN count(*) FILTER (event = 'hangup') > 0 THEN 'missed' ELSE 'open' END AS outcome FROM s GROUP BY device_id, sid
  HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM call)""")
def r5b(spark, d):
    return plain(R.run_available(R.call_sessions(feed(spark, calls(spark, d)), delay="10 minutes"), folder(spark)))


@query("r6_state_durations", f"WITH {CALLS}, n AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq)) - epoch_us(ts)) / 1e6 AS s FROM call) SELECT device_id, event, {ROUND('coalesce(sum(s), 0.0)')} AS seconds, CAST(count(*) AS BIGINT) AS entered FROM n GROUP BY 1, 2")
def r6(spark, d):
    return rounded(R.state_durations(calls(spark, d)))


@query("r6_stream_state_durations", f"WITH {CALLS}, n AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq)) - epoch_us(ts)) / 1e6 AS s FROM call) SELECT device_id, event, {ROUND('coalesce(sum(s), 0.0)')} AS seconds, CAST(count(*) AS BIGINT) AS entered FROM n GROUP BY 1, 2")
def r6b(spark, d):
    found = R.run_available(R.stream_state_durations(feed(spark, calls(spark, d), "seq")), folder(spark))
    return rounded(found.groupBy("device_id", "event").agg(F.sum("seconds").alias("seconds"), F.sum("entered").alias("entered")))


NOTIFY = "notify AS (SELECT 'u' || user_id AS uuid, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'bye' ELSE 'alive' END AS kind FROM events)"


@query("r7_service_liveness", f"WITH {NOTIFY}, {session_sql('notify', 'uuid', '2 HOUR')} SELECT uuid, min(ts) AS start, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS notifies, CASE WHEN arg_max(kind, ts) = 'bye' THEN 'bye' ELSE 'expired' END AS ended_by FROM s GROUP BY uuid, sid")
def r7(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("uuid"), "ts", F.when(F.col("event_type") == "error", "bye").otherwise("alive").alias("kind"))
    return R.service_liveness(e, 3600)


@query("r7_stream_service_liveness", f"WITH {NOTIFY}, {session_sql('notify', 'uuid', '2 HOUR')} SELECT uuid, min(ts) AS start, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS notifies, CASE WHEN arg_max(kind, ts) = 'bye' THEN 'bye' ELSE 'expired' END AS ended_by FROM s GROUP BY uuid, sid HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM notify)")
def r7b(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("uuid"), "ts", F.when(F.col("event_type") == "error", "bye").otherwise("alive").alias("kind"))
    found = R.run_available(R.service_liveness(feed(spark, e), 3600, "10 minutes"), folder(spark))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last_seen")})


SEGMENTS = """WITH m AS (SELECT user_id % 8 AS stream_id, event_id AS seq, event_type = 'signup' AS bos, CAST(event_id % 3 AS INTEGER) AS format, CAST(trunc(value * 10) AS INTEGER) * CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS z FROM events),
s AS (SELECT *, sum(bos::INT) OVER (PARTITION BY stream_id ORDER BY seq) AS segment FROM m WHERE z <> 0)
SELECT stream_id, CAST(segment AS BIGINT) AS segment, arg_min(format, seq) AS format, CAST(sum(CASE WHEN z > 512 THEN 0 ELSE z END) AS BIGINT) AS bytes, CAST(count(*) FILTER (z > 512) AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS metas FROM s GROUP BY 1, 2"""


def segments(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        (F.col("user_id") % 8).alias("stream_id"), i.alias("seq"), (F.col("event_type") == "signup").alias("bos"), (i % 3).cast("int").alias("format"),
        ((F.col("value") * 10).cast("int") * F.when(i % 9 == 0, 0).otherwise(1)).alias("valid_size"),
    )


@query("r8_stream_segment_feed", SEGMENTS + " HAVING segment < (SELECT max(segment) FROM s x WHERE x.stream_id = s.stream_id)")
def r8b(spark, d):
    return R.run_available(R.stream_segment_feed(feed(spark, segments(spark, d), "seq")), folder(spark))


@query("r8_segment_feed", SEGMENTS)
def r8(spark, d):
    return R.segment_feed(segments(spark, d))


@query("r9_late_data_report", with_sql(PACKET_SQL, AUTH, status_sql(128)) + "SELECT ssrc, status AS reason, CAST(count(*) AS BIGINT) AS n FROM judged WHERE status <> 'ok' GROUP BY 1, 2")
def r9(spark, d):
    return R.late_data_report(r1(spark, d))


#: Six batches by arrival; packets that come 400 places later carry a time 12 days before their first copy's.
LATE = 6
LATE_SQL = f"""late0 AS (SELECT ssrc, arrival, seq, CASE WHEN arrival % 10 = 1 AND (arrival - 4001) % 700 = 0 THEN ts - INTERVAL 12 DAY ELSE ts END AS ts FROM packet WHERE auth_ok),
late1 AS (SELECT *, (arrival - min(arrival) OVER ()) * {LATE} // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM late0),
marks AS (SELECT batch + 2 AS batch, max(epoch_ms(max(ts))) OVER (ORDER BY batch) - 3600000 AS mark FROM late1 GROUP BY batch),
late2 AS (SELECT late1.*, mark IS NOT NULL AND epoch_us(ts) <= mark * 1000 AS late FROM late1 LEFT JOIN marks USING (batch))"""


@query("r9_stream_late_data", with_sql(PACKET_SQL, LATE_SQL, INDEXED.format(source="(SELECT * FROM late2 WHERE NOT late)"), status_sql(128)) + """SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT status AS reason, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'late', count(*) FROM late2 WHERE late) GROUP BY 1 HAVING sum(n) > 0""")
def r9b(spark, d):
    """Late, old and repeated packets of one stream, told by its own progress."""
    own = R.stateful_session(spark)
    a = F.col("arrival")
    late = (a % 10 == 1) & ((a - 4001) % 700 == 0)
    p = packets(own, d).filter("auth_ok").select("ssrc", "arrival", "seq", F.when(late, F.col("ts") - F.expr("INTERVAL 12 DAYS")).otherwise(F.col("ts")).alias("ts"))
    low, high = p.agg(F.min("arrival"), F.max("arrival")).first()
    cuts = [low + -(-(high - low + 1) * i // LATE) - 1 for i in range(1, LATE)]
    admitted = R.stream_admit(feed(own, p, "arrival", LATE, cuts), delay="1 hour")
    _, listener = R.run_observed(R.observed(admitted), folder(own), f"late_{new_folder(own, 'q').rpartition('-')[2]}")
    return listener.report(own).groupBy("reason").agg(F.sum("n").alias("n"))


@query("s1_read_trace_log", with_sql(TRACE_SQL) + """SELECT 'log_' || device_id AS path, CAST(row_number() OVER (PARTITION BY device_id ORDER BY seq) - 1 AS BIGINT) AS seq, act, CAST(CASE WHEN act = '+' THEN flag ELSE -1 END AS INTEGER) AS flag, addr,
  CAST(CASE WHEN act = '+' THEN size ELSE -1 END AS BIGINT) AS size, CASE WHEN act = '+' THEN array_to_string(stack, ',') ELSE '' END AS stack FROM trace""")
def s1(spark, d):
    found = trace_log.decode_trace_logs(trace_log.encode_trace_logs(trace_events(spark, d)))
    return found.select("path", "seq", "act", F.coalesce("flag", F.lit(-1)).alias("flag"), "addr", F.coalesce("size", F.lit(-1)).cast("long").alias("size"), F.coalesce(F.array_join("stack", ","), F.lit("")).alias("stack"))



@query("s2_read_metric_report", """WITH m AS (SELECT CAST(CASE o_custkey % 2 WHEN 0 THEN 16 ELSE 24 END AS INTEGER) AS bits, CAST([8000, 11025, 16000, 22050, 44100][1 + o_orderkey % 5] AS INTEGER) AS src_rate, CAST([8000, 11025, 16000, 22050, 44100][1 + o_custkey % 5] AS INTEGER) AS dst_rate,
  round(-avg(o_totalprice) / 2500, 3) AS thd, round(avg(o_totalprice) / 4000, 3) AS snr, round(avg(o_totalprice) / 40000, 3) AS mag_diff FROM orders WHERE (o_orderkey + o_custkey) % 7 <> 0 GROUP BY 1, 2, 3) SELECT * FROM m""")
def s2(spark, d):
    m = measured(spark, d)
    block = F.format_string(
        "==== run (%d -> %d, bits: %d) ====\n some text\n thd_db: %.3f\n snr_db: %.3f\n magnitude_response_diff: %.3f\n", "src_rate", "dst_rate", "bits", "thd_db", "snr_db", "mag_diff"
    )
    reports = m.groupBy("bits").agg(F.concat_ws("", F.collect_list(block)).alias("value"))
    return reports.select(F.explode(files.parse_metric_report(F.col("value"))).alias("m")).select("m.*")


def _tag_bytes(title, author):
    """A version 2.3 tag with two text frames, as hexadecimal text."""
    frame = lambda name, text: F.concat(F.hex(F.lit(name)), F.lpad(F.hex(F.octet_length(text) + 1), 8, "0"), F.lit("000003"), F.hex(text.cast("binary")))
    body = F.concat(frame("TIT2", title), frame("TPE1", author))
    n = (F.length(body) / 2).cast("int")
    seven = lambda k: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127)), 2, "0")
    return F.concat(F.lit("494433030000"), seven(3), seven(2), seven(1), seven(0), body)


@query("s4_read_tags", "SELECT 'd' || doc_id AS path, '2.3' AS version, md5(trim(text, ' ')) AS title, source AS author FROM documents WHERE doc_id % 10 <> 3 AND trim(text, ' ') <> ''")
def s4(spark, d):
    """Whole texts as titles."""
    docs = table(spark, d, "documents").filter(F.trim("text") != "")
    raw = F.unhex(F.when(F.col("doc_id") % 10 == 3, F.lit("49443309000000000000")).otherwise(_tag_bytes(F.col("text"), F.col("source"))))
    found = tags.decode_tags(docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), raw.alias("content")))
    return found.select("path", "version", F.md5(F.col("title").cast("binary")).alias("title"), "author")


@query("x1_with_frame_parser", with_sql(TRACE_SQL) + ", p AS (SELECT device_id, seq, CASE WHEN act = '+' THEN 20 ELSE 6 END AS size FROM trace) SELECT 'log_' || device_id AS path, CAST(sum(size) OVER (PARTITION BY device_id ORDER BY seq) - size AS BIGINT) AS pos, CAST(size AS BIGINT) AS size, CASE WHEN size = 20 THEN 'alloc' ELSE 'free' END AS kind FROM p")
def x1(spark, d):
    logs = trace_log.encode_trace_logs(trace_events(spark, d))
    step = 1000
    idx = F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / step).cast("int")))
    chunks = logs.select("path", "content", idx.alias("idx")).select("path", "idx", F.substr("content", F.col("idx") * step + 1, F.lit(step)).alias("data"))

    def parse(data: bytes) -> tuple[int, int, dict]:
        if data[:1] == b"+":
            return 0, 12 + 4 * data[1] if len(data) >= 12 else 0, {"kind": "alloc"}
        return 0, 6, {"kind": "free"}

    return files.with_frame_parser(chunks, parse, "kind string")


@query("s7_read_packets", "SELECT CAST(event_id % 128 AS BIGINT) AS pt, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s7(spark, d):
    i = F.col("event_id")
    payload = F.unhex(F.concat(F.lit("80"), F.lpad(F.hex(i % 128), 2, "0"), F.lit("0001"), F.lpad(F.hex(i % 4294967296), 8, "0"), F.lit("00000001")))
    return P.decode_rtp_header(table(spark, d, "events").select(payload.alias("payload"))).groupBy("pt").agg(F.count("*").alias("n"))


@query("s5_write_slices", with_sql(MEDIA_SQL) + ", m AS (SELECT 'f' || (CAST(substr(file_id, 2) AS BIGINT) % 16) AS f, * FROM media) SELECT f AS file_id, 'slice_' || CAST((pts - min(pts) OVER (PARTITION BY f)) // 1000 AS BIGINT) AS slice, size, pts FROM m")
def s5(spark, d):
    m = media_frames(spark, d)
    m = m.withColumn("file_id", F.concat(F.lit("f"), F.substring("file_id", 2, 20).cast("long") % 16))
    place = f"{folder(spark)}/slices"
    files.write_slices(m, place, 1000)
    return spark.read.parquet(place).select("file_id", "slice", "size", "pts")


@query("s6_write_matrix", with_sql(GRID) + ", g AS (SELECT DISTINCT bits, unnest([8000, 11025, 16000, 22050, 44100])::INTEGER AS src_rate FROM measured)\nSELECT g.bits, 'thd' AS metric, g.src_rate, " + ", ".join(f"coalesce(printf('%.2f', max(floor(thd_db * 4) / 4) FILTER (dst_rate = {r})), '') AS r{r}" for r in RATES) + " FROM g LEFT JOIN measured USING (bits, src_rate) GROUP BY 1, 2, 3")
def s6(spark, d):
    long = measured(spark, d).select("bits", F.lit("thd").alias("metric"), "src_rate", "dst_rate", (F.floor(F.col("thd_db") * 4) / 4).alias("value"))  # quarters print alike everywhere
    place = f"{folder(spark)}/matrix"
    files.write_matrix(V.metric_matrix(long, RATES), place)
    schema = "src_rate int, " + ", ".join(f"r{r} string" for r in RATES) + ", bits int, metric string"
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(place).na.fill("")


LINES_SQL = with_sql(MEDIA_SQL) + "SELECT file_id, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(pts AS BIGINT) AS pts, size, key_frame, false AS bad FROM media"


def frame_lines(spark, d):
    """Media frames written as files of a user's container."""
    place = f"{folder(spark)}/lines"
    m = media_frames(spark, d)
    m.select(F.concat_ws(";", "file_id", "frame_idx", "pts", "size", F.col("key_frame").cast("int")).alias("value")).write.text(place)
    containers.register_container(spark, containers.LineFrames())
    return place


@query("x2_container_source", LINES_SQL)
def x2(spark, d):
    """Read in ranges of 64 kB, so that most ranges begin within a line."""
    found = spark.read.format("line_frames").option("splitBytes", 65536).load(frame_lines(spark, d))
    return found.select("file_id", "frame_idx", "pts", "size", "key_frame", "bad")


@query("x2_container_stream", with_sql(MEDIA_SQL) + "SELECT key_frame, CAST(count(*) AS BIGINT) AS frames, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(pts) AS BIGINT) AS pts FROM media GROUP BY 1")
def x2b(spark, d):
    stream = spark.readStream.format("line_frames").option("splitBytes", 1 << 20).load(frame_lines(spark, d))
    found = R.run_available(stream.select("size", "pts", "key_frame"), folder(spark))
    return found.groupBy("key_frame").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.sum("pts").alias("pts"))
