"""Registered queries over packets and configuration tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import PACKET_SQL, packets, table, with_sql
from ..operators import config as C
from ..operators import packets as P

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


#: In the packets made from events neighbours differ by less than half the range, so wraps can be counted.
INDEXED = """indexed AS (
  SELECT *, seq + 65536 * sum(w) OVER (PARTITION BY ssrc ORDER BY arrival) AS index FROM (
    SELECT *, CASE WHEN seq - lag(seq) OVER o < -32768 THEN 1 WHEN seq - lag(seq) OVER o > 32768 THEN -1 ELSE 0 END AS w FROM {source} WINDOW o AS (PARTITION BY ssrc ORDER BY arrival)))"""
ALL, AUTH = INDEXED.format(source="packet"), INDEXED.format(source="(SELECT * FROM packet WHERE auth_ok)")


def status_sql(window: int) -> str:
    return f"""judged AS (SELECT *, CASE WHEN max(index) OVER b - index > {window - 1} THEN 'replay_old'
    WHEN row_number() OVER (PARTITION BY ssrc, index ORDER BY arrival) > 1 THEN 'replay_fail' ELSE 'ok' END AS status
  FROM indexed WINDOW b AS (PARTITION BY ssrc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w2_extend_sequence", with_sql(PACKET_SQL, ALL) + "SELECT ssrc, arrival, seq, CAST(index AS BIGINT) AS index FROM indexed")
def w2(spark, d):
    return P.extend_sequence(packets(spark, d).select("ssrc", "arrival", "seq"))


@query("w2_extend_sequence_by_wraps", with_sql(PACKET_SQL, ALL) + "SELECT ssrc, arrival, seq, CAST(index AS BIGINT) AS index FROM indexed")
def w2b(spark, d):
    return P.extend_sequence_by_wraps(packets(spark, d).select("ssrc", "arrival", "seq"))


@query("w3_replay_status", with_sql(PACKET_SQL, AUTH, status_sql(128)) + "SELECT ssrc, arrival, CAST(index AS BIGINT) AS index, status FROM judged")
def w3(spark, d):
    return P.admit(packets(spark, d).select("ssrc", "arrival", "seq", "auth_ok")).select("ssrc", "arrival", "index", "status")


@query("w4_control_replay_status", with_sql(PACKET_SQL) + """, c AS (SELECT ssrc, arrival, CAST(rtp_ts // 1280 AS BIGINT) AS index FROM packet)
SELECT ssrc, arrival, index, CASE WHEN index < greatest(0, coalesce(max(index) OVER b, 0) - 127) THEN 'replay_old'
  WHEN row_number() OVER (PARTITION BY ssrc, index ORDER BY arrival) > 1 THEN 'replay_fail' ELSE 'ok' END AS status
FROM c WINDOW b AS (PARTITION BY ssrc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w4(spark, d):
    return P.control_replay_status(packets(spark, d).select("ssrc", "arrival", F.floor(F.col("rtp_ts") / 1280).alias("index")))


@query("w5_loss_report", with_sql(PACKET_SQL, ALL) + """, late AS (
  SELECT ssrc, index, coalesce(max(index) OVER (PARTITION BY ssrc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > index, false) AS late FROM indexed),
h AS (SELECT ssrc, index, count(*) AS n, sum(late::INT) AS late FROM late GROUP BY 1, 2),
g AS (SELECT *, index - lag(index) OVER (PARTITION BY ssrc ORDER BY index) AS step FROM h)
SELECT ssrc, CAST(sum(n) AS BIGINT) AS packets, CAST(count(*) AS BIGINT) AS distinct_packets, CAST(max(index) - min(index) + 1 - count(*) AS BIGINT) AS lost,
  CAST(count(*) FILTER (step > 1) AS BIGINT) AS gaps, CAST(sum(late) AS BIGINT) AS late FROM g GROUP BY ssrc""")
def w5(spark, d):
    return P.loss_report(P.extend_sequence_by_wraps(packets(spark, d).select("ssrc", "arrival", "seq")))


@query("w6_key_budget", with_sql(PACKET_SQL, AUTH, status_sql(128)) + """, n AS (SELECT ssrc, arrival, 66000 - row_number() OVER (PARTITION BY ssrc ORDER BY arrival) AS l FROM judged WHERE status = 'ok')
SELECT ssrc, arrival, CAST(greatest(0, l) AS INTEGER) AS packets_left, CASE WHEN l < 0 THEN 'key_expired' WHEN l < 1 THEN 'hard' WHEN l < 65536 THEN 'soft' ELSE 'ok' END AS key_state FROM n""")
def w6(spark, d):
    ok = P.admit(packets(spark, d).select("ssrc", "arrival", "seq", "auth_ok")).filter("status = 'ok'")
    return P.key_budget(ok, 66000).select("ssrc", "arrival", "packets_left", "key_state")


@query("w7_ssrc_collision", with_sql(PACKET_SQL) + "SELECT ssrc, arrival, direction, f AS first_direction FROM (SELECT *, first(direction) OVER (PARTITION BY ssrc ORDER BY arrival) AS f FROM packet) WHERE direction <> f")
def w7(spark, d):
    return P.ssrc_collision(packets(spark, d)).select("ssrc", "arrival", "direction", "first_direction")


#: The scan as a recursion: high and pending are the state after each packet.
W17_SQL = with_sql(PACKET_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (
  SELECT ssrc, arrival, seq, CASE WHEN arrival % 500 = 0 THEN arrival // 9000 END AS roc, row_number() OVER (PARTITION BY ssrc ORDER BY arrival) AS k FROM packet
), r AS (
  SELECT DISTINCT ssrc, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS INTEGER) AS seq, CAST(NULL AS BIGINT) AS roc, CAST(NULL AS BIGINT) AS index, CAST(NULL AS VARCHAR) AS epoch_status FROM packet
  UNION ALL
  SELECT ssrc, k, CASE WHEN s = 'pkt_idx_old' THEN high ELSE greatest(high, i) END, CASE WHEN s = 'pkt_idx_adv' THEN 0 ELSE count END, arrival, seq, roc, i, s FROM (
    SELECT *, CASE WHEN count > 0 AND i - high > 32768 THEN 'pkt_idx_adv' WHEN count > 0 AND high - i > 32768 THEN 'pkt_idx_old' ELSE 'ok' END AS s FROM (
      SELECT *, CASE WHEN count > 0 THEN count * 65536 + seq WHEN high <= 32768 THEN seq
        ELSE (high // 65536 + CASE WHEN high % 65536 < 32768 THEN CASE WHEN seq - high % 65536 > 32768 THEN -1 ELSE 0 END WHEN high % 65536 - 32768 > seq THEN 1 ELSE 0 END) * 65536 + seq END AS i FROM (
        SELECT p.*, r.high, coalesce(p.roc, r.pending) AS count FROM r JOIN p ON p.ssrc = r.ssrc AND p.k = r.k + 1)))
) SELECT ssrc, arrival, seq, roc, index, epoch_status FROM r WHERE k > 0"""


@query("w17_resync_epoch", W17_SQL)
def w17(spark, d):
    p = packets(spark, d).select("ssrc", "arrival", "seq")
    roc = F.when(F.col("arrival") % 500 == 0, F.floor(F.col("arrival") / 9000))
    return P.resync_epoch(p.withColumn("roc", roc))


POLICY_SQL = """policy AS (SELECT CASE WHEN n_nationkey < 4 THEN 'specific' ELSE 'any_inbound' END AS ssrc_type, CASE WHEN n_nationkey < 4 THEN n_nationkey END AS ssrc,
    CAST(CASE n_nationkey WHEN 0 THEN 0 WHEN 1 THEN 63 WHEN 2 THEN 64 WHEN 3 THEN 32768 ELSE 128 END AS INTEGER) AS win FROM nation WHERE n_nationkey < 5)"""


def policies(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").filter("n_nationkey < 5").select(
        F.when(k < 4, "specific").otherwise("any_inbound").alias("ssrc_type"), F.when(k < 4, k.cast("long")).alias("ssrc"),
        F.when(k == 0, 0).when(k == 1, 63).when(k == 2, 64).when(k == 3, 32768).otherwise(128).alias("window"), F.lit(False).alias("allow_repeat"), F.lit(100000).cast("long").alias("key_limit"),
    )


@query("j5_route_to_policy", with_sql(PACKET_SQL, POLICY_SQL) + """SELECT p.ssrc, p.arrival, coalesce(x.win, t.win) AS "window", x.win IS NULL AND t.win IS NOT NULL AS provisional,
  CASE WHEN x.win IS NULL AND t.win IS NULL THEN 'no_ctx' ELSE 'ok' END AS route
FROM packet p LEFT JOIN policy x ON x.ssrc_type = 'specific' AND x.ssrc = p.ssrc LEFT JOIN policy t ON t.ssrc_type = 'any_inbound' AND p.direction = 'in'""")
def j5(spark, d):
    return P.route_to_policy(packets(spark, d), policies(spark, d)).select("ssrc", "arrival", "window", "provisional", "route")


@query("j13_select_key", with_sql(PACKET_SQL) + """, k AS (SELECT CAST(n_nationkey // 3 AS BIGINT) AS ssrc, 'k' || (n_nationkey % 3) AS key_id, CAST(n_nationkey AS INTEGER) AS key_no FROM nation WHERE n_nationkey < 14),
s AS (SELECT DISTINCT ssrc FROM k)
SELECT p.ssrc, p.arrival, CASE WHEN s.ssrc IS NULL THEN 0 ELSE k.key_no END AS key_no, CASE WHEN s.ssrc IS NOT NULL AND k.key_no IS NULL THEN 'bad_mki' ELSE 'ok' END AS key_status
FROM packet p LEFT JOIN k ON p.ssrc = k.ssrc AND p.key_id = k.key_id LEFT JOIN s ON s.ssrc = p.ssrc""")
def j13(spark, d):
    k = F.col("n_nationkey")
    keys = table(spark, d, "nation").filter("n_nationkey < 14").select((k / 3).cast("long").alias("ssrc"), F.concat(F.lit("k"), k % 3).alias("key_id"), k.cast("int").alias("key_no"))
    return P.select_key(packets(spark, d), keys).select("ssrc", "arrival", "key_no", "key_status")


@query("a13_status_counts", with_sql(PACKET_SQL, AUTH, status_sql(128)) + """SELECT ssrc, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'replay_fail') AS BIGINT) AS replay_fail,
  CAST(count(*) FILTER (status = 'replay_old') AS BIGINT) AS replay_old, CAST(0 AS BIGINT) AS no_ctx, CAST(0 AS BIGINT) AS bad_param, CAST(0 AS BIGINT) AS key_expired FROM judged GROUP BY ssrc""")
def a13(spark, d):
    return P.status_counts(P.admit(packets(spark, d).select("ssrc", "arrival", "seq", "auth_ok")))


@query("u3_common_streams", with_sql(PACKET_SQL) + "SELECT ssrc FROM packet WHERE direction = 'in' INTERSECT SELECT ssrc FROM packet WHERE direction = 'out'")
def u3(spark, d):
    p = packets(spark, d)
    return P.common_streams(p.filter("direction = 'in'"), p.filter("direction = 'out'"))


@query("f5_decode_rtp_header", """WITH e AS (SELECT event_id, 128 + CASE WHEN event_id % 5 = 0 THEN 16 ELSE 0 END + event_id % 3 AS b0, CASE WHEN event_type = 'error' THEN 128 ELSE 0 END + 96 AS b1,
  event_id * 97 % 65536 AS seq, event_id * 160 % 4294967296 AS rtp_ts, user_id AS ssrc, event_id % 5 = 0 AS x, CAST(event_id % 3 AS BIGINT) AS cc, event_id % 11 AS cut FROM events),
s AS (SELECT *, 12 + 4 * cc + CASE WHEN x THEN 8 ELSE 0 END AS n, greatest(0, 12 + 4 * cc + CASE WHEN x THEN 8 ELSE 0 END + 4 - cut) AS has FROM e),
o AS (SELECT *, has >= n AS ok FROM s)
SELECT event_id, CASE WHEN ok THEN 'ok' ELSE 'bad_param' END AS status, CAST(CASE WHEN ok THEN 2 ELSE -1 END AS BIGINT) AS version, false AS padding, ok AND x AS has_ext,
  CAST(CASE WHEN ok THEN cc ELSE -1 END AS BIGINT) AS cc, ok AND b1 >= 128 AS marker, CAST(CASE WHEN ok THEN 96 ELSE -1 END AS BIGINT) AS pt, CAST(CASE WHEN ok THEN seq ELSE -1 END AS BIGINT) AS seq,
  CAST(CASE WHEN ok THEN rtp_ts ELSE -1 END AS BIGINT) AS rtp_ts, CAST(CASE WHEN ok THEN ssrc ELSE -1 END AS BIGINT) AS ssrc,
  CAST(CASE WHEN NOT ok THEN -1 WHEN x THEN 8 ELSE 0 END AS BIGINT) AS ext_length, CAST(CASE WHEN ok THEN n ELSE -1 END AS BIGINT) AS header_length FROM o""")
def f5(spark, d):
    i = F.col("event_id")
    byte = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    cc, x = i % 3, i % 5 == 0
    size = 12 + 4 * cc + F.when(x, 8).otherwise(0)
    text = F.concat(
        byte(128 + F.when(x, 16).otherwise(0) + cc, 1), byte(F.when(F.col("event_type") == "error", 128).otherwise(0) + 96, 1), byte(i * 97 % 65536, 2), byte(i * 160 % 4294967296, 4), byte(F.col("user_id"), 4),
        F.repeat(F.lit("00000001"), cc.cast("int")), F.when(x, F.lit("BEDE000100000000")).otherwise(F.lit("")), F.lit("FFFFFFFF"),
    )
    kept = F.substr(text, F.lit(1), (2 * F.greatest(F.lit(0), size + 4 - i % 11)).cast("int"))
    rows = table(spark, d, "events").select("event_id", F.unhex(kept).alias("payload"))
    found = P.decode_rtp_header(rows).drop("payload")
    return found.select("event_id", "status", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) if t != "boolean" else F.coalesce(c, F.lit(False)).alias(c) for c, t in found.dtypes[2:]])


@query("f6_validate_config", """WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 40000 AS INTEGER) AS win, l_discount * 400 AS q, l_quantity - 25 AS gain, l_tax * 12 AS feedback, l_extendedprice AS fc FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE WHEN win = 0 THEN 128 ELSE win END AS INTEGER) AS "window", concat_ws(',', CASE WHEN win <> 0 AND (win < 64 OR win >= 32768) THEN 'window' END,
  CASE WHEN q NOT BETWEEN 0.1 AND 20 THEN 'eq_q' END, CASE WHEN gain NOT BETWEEN -15 AND 15 THEN 'eq_gain' END, CASE WHEN fc >= 48000 / 2 THEN 'eq_fc' END, CASE WHEN feedback NOT BETWEEN 0 AND 0.95 THEN 'delay_feedback' END) AS violations FROM c""")
def f6(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 40000).cast("int").alias("window"), (F.col("l_discount") * 400).alias("q"), (F.col("l_quantity") - 25).alias("gain"),
        (F.col("l_tax") * 12).alias("feedback"), F.col("l_extendedprice").alias("fc"), F.lit(48000).alias("sample_rate"),
    )
    return C.validate_config(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "window", F.array_join("violations", ",").alias("violations"))


@query("f7_validate_filter_bank", """WITH b AS (SELECT l_orderkey AS bank, CASE l_linenumber WHEN 1 THEN 'high_pass' WHEN 2 THEN 'low_pass' ELSE 'peak' END AS kind, l_extendedprice AS fc FROM lineitem),
g AS (SELECT bank, count(*) FILTER (kind = 'high_pass') AS h, count(*) FILTER (kind = 'low_pass') AS l, min(fc) AS lo, max(fc) AS hi, min(fc) FILTER (kind = 'high_pass') AS hp, max(fc) FILTER (kind = 'low_pass') AS lp FROM b GROUP BY 1)
SELECT bank, concat_ws(',', CASE WHEN h > 1 THEN 'two_high_pass' END, CASE WHEN l > 1 THEN 'two_low_pass' END, CASE WHEN hp > lo THEN 'high_pass_not_lowest' END, CASE WHEN lp < hi THEN 'low_pass_not_highest' END) AS violations FROM g""")
def f7(spark, d):
    kind = F.when(F.col("l_linenumber") == 1, "high_pass").when(F.col("l_linenumber") == 2, "low_pass").otherwise("peak")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bank"), kind.alias("kind"), F.col("l_extendedprice").alias("fc"))
    return C.validate_filter_bank(rows).withColumn("violations", F.array_join("violations", ","))
