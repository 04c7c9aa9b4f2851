"""Registered queries over allocation traces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SYMBOL_SQL, TRACE_SQL, symbols, table, trace_events, with_sql
from ..functions.text import is_playlist_url, is_wrapper_file, normalize_path
from ..operators import trace as T

WRAPPERS = ["heap_wrap*.c", "libc/"]
Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


PAIRED = """paired AS (
  SELECT *, lag(act) OVER w AS p_act, lag(seq) OVER w AS p_seq, lag(size) OVER w AS p_size, lag(module) OVER w AS p_module, lag(stack) OVER w AS p_stack, lead(act) OVER w AS n_act
  FROM trace WINDOW w AS (PARTITION BY device_id, addr ORDER BY seq))"""
MOVED = """moved AS (
  SELECT device_id, seq, CASE WHEN act = '+' THEN module ELSE p_module END AS module, CASE WHEN act = '+' THEN stack ELSE p_stack END AS stack,
    CASE WHEN act = '+' THEN size ELSE -p_size END AS delta FROM paired WHERE act = '+' OR p_act = '+')"""


def _peaks(source: str, keys: str) -> str:
    return f"""(SELECT *, greatest(0, max(balance) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM (
      SELECT *, sum(delta) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS balance FROM {source}))"""


@query("f1_filter_trace_flag", with_sql(TRACE_SQL) + "SELECT act, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM trace WHERE act <> '+' OR (flag & 2) <> 0 GROUP BY act")
def f1(spark, d):
    return T.filter_trace_flag(trace_events(spark, d), 2).groupBy("act").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("j1_pair_alloc_free", with_sql(TRACE_SQL, PAIRED) + "SELECT device_id, addr, p_seq AS alloc_seq, seq AS free_seq, p_size AS size, p_module AS module FROM paired WHERE act = '-' AND p_act = '+'")
def j1(spark, d):
    return T.pair_alloc_free(trace_events(spark, d))


@query("j2_find_leaks", with_sql(TRACE_SQL, PAIRED) + "SELECT device_id, addr, seq, size, module FROM paired WHERE act = '+' AND n_act IS NULL")
def j2(spark, d):
    return T.find_leaks(trace_events(spark, d)).drop("stack")


PROBES = "probe AS (SELECT user_id % 10 AS device_id, user_id + event_id % 300 AS probe FROM events WHERE event_type = 'click' GROUP BY ALL)"


@query("j3_last_owner", with_sql(TRACE_SQL, PROBES) + """, h AS (
  SELECT p.device_id, p.probe, t.addr, t.size, t.seq, row_number() OVER (PARTITION BY p.device_id, p.probe ORDER BY t.seq DESC) AS r
  FROM probe p JOIN trace t ON p.device_id = t.device_id AND t.act = '+' AND p.probe BETWEEN t.addr AND t.addr + t.size)
SELECT device_id, probe, addr, size, probe - addr AS position,
  EXISTS (SELECT 1 FROM trace f WHERE f.act = '-' AND f.device_id = h.device_id AND f.addr = h.addr AND f.seq > h.seq) AS freed FROM h WHERE r = 1""")
def j3(spark, d):
    probes = table(spark, d, "events").filter("event_type = 'click'").select((F.col("user_id") % 10).alias("device_id"), (F.col("user_id") + F.col("event_id") % 300).alias("probe")).distinct()
    return T.last_owner(trace_events(spark, d), probes)


SITES = """site AS (
  SELECT stack, CASE WHEN max(ok) THEN arg_min(path, CASE WHEN ok THEN pos END) ELSE max(CASE WHEN pos = 2 THEN path END) END AS path,
    CASE WHEN max(ok) THEN arg_min(line, CASE WHEN ok THEN pos END) ELSE max(CASE WHEN pos = 2 THEN line END) END AS line
  FROM (SELECT s.stack, s.pos, y.path, y.line, coalesce(NOT regexp_matches(y.path, 'heap_wrap.*?\\.c|libc/'), false) AS ok
    FROM (SELECT DISTINCT stack, unnest([1, 2]) AS pos FROM trace) s LEFT JOIN symbol y ON y.addr = s.stack[s.pos]) GROUP BY stack)""".replace("\\\\", "\\")


@query("j4_call_site_after", with_sql(TRACE_SQL, SYMBOL_SQL) + """SELECT array_to_string(t.stack, ',') AS stack, y.path, y.line, y.path IS NULL AS error
FROM (SELECT DISTINCT stack FROM trace) t LEFT JOIN symbol y ON t.stack[1] = 3 AND y.addr = t.stack[2]""")
def j4b(spark, d):
    found = T.resolve_call_site(trace_events(spark, d), symbols(spark, d), WRAPPERS, after=3)
    return found.withColumn("stack", F.array_join("stack", ","))


@query("j4_resolve_call_site", with_sql(TRACE_SQL, SYMBOL_SQL, SITES) + "SELECT array_to_string(stack, ',') AS stack, path, line, path IS NULL AS error FROM site")
def j4(spark, d):
    found = T.resolve_call_site(trace_events(spark, d), symbols(spark, d), WRAPPERS)
    return found.withColumn("stack", F.array_join(F.col("stack").cast("array<string>"), ","))


@query("j12_keep_matched", with_sql(TRACE_SQL, PAIRED) + "SELECT device_id, addr, seq FROM paired WHERE act = '-' AND p_act = '+'")
def j12a(spark, d):
    return T.keep_matched(trace_events(spark, d)).select("device_id", "addr", "seq")


@query("j12_drop_orphan_frees", with_sql(TRACE_SQL, PAIRED) + "SELECT device_id, addr, seq, act FROM paired WHERE act = '+' OR p_act = '+'")
def j12b(spark, d):
    return T.drop_orphan_frees(trace_events(spark, d)).select("device_id", "addr", "seq", "act")


@query("w1_running_usage", with_sql(TRACE_SQL, PAIRED, MOVED) + f"SELECT device_id, seq, CAST(delta AS BIGINT) AS delta, CAST(balance AS BIGINT) AS balance, CAST(peak AS BIGINT) AS peak FROM {_peaks('moved', 'device_id')}")
def w1(spark, d):
    changes = T.usage_events(trace_events(spark, d)).select("device_id", "seq", "delta")
    return T.running_usage(changes, ["device_id"])


@query("a1_usage_by_module", with_sql(TRACE_SQL, PAIRED, MOVED) + f"""SELECT device_id, module, CAST(sum(delta) AS BIGINT) AS used, CAST(max(peak) AS BIGINT) AS peak, CAST(count(*) AS BIGINT) AS n_events
FROM {_peaks('moved', 'device_id, module')} GROUP BY 1, 2
UNION ALL SELECT device_id, NULL, CAST(sum(delta) AS BIGINT), CAST(max(peak) AS BIGINT), CAST(count(*) AS BIGINT) FROM {_peaks('moved', 'device_id')} GROUP BY 1""")
def a1(spark, d):
    return T.usage_by_module(trace_events(spark, d))


@query("a2_leak_summary", with_sql(TRACE_SQL, PAIRED) + "SELECT coalesce(CAST(device_id AS VARCHAR), 'all') AS device_id, coalesce(module, 'all') AS module, CAST(count(*) AS BIGINT) AS n_leaks, CAST(sum(size) AS BIGINT) AS leaked_bytes FROM paired WHERE act = '+' AND n_act IS NULL GROUP BY ROLLUP (device_id, module)")
def a2(spark, d):
    found = T.leak_summary(trace_events(spark, d))
    return found.withColumn("device_id", F.coalesce(F.col("device_id").cast("string"), F.lit("all"))).withColumn("module", F.coalesce("module", F.lit("all")))


NODES = """node AS (
  SELECT device_id, seq, delta, array_to_string(parts[1:n], '/') AS node FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (
      SELECT m.device_id, m.seq, m.delta, list_append(string_split(s.path, '/'), CAST(s.line AS VARCHAR)) AS parts FROM moved m JOIN site s ON m.stack = s.stack AND s.path IS NOT NULL)))"""
TREE = f"""tree AS (
  SELECT device_id, node, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS alloc_count, CAST(count(*) FILTER (delta <= 0) AS BIGINT) AS free_count,
    CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS total_malloc, CAST(sum(delta) AS BIGINT) AS used, CAST(max(peak) AS BIGINT) AS max_use
  FROM {_peaks('node', 'device_id, node')} GROUP BY 1, 2)"""


def _tree(spark, d):
    t = trace_events(spark, d)
    return T.call_tree(t, T.resolve_call_site(t, symbols(spark, d), WRAPPERS))


@query("a3_call_tree", with_sql(TRACE_SQL, SYMBOL_SQL, PAIRED, MOVED, SITES, NODES, TREE) + "SELECT * FROM tree")
def a3(spark, d):
    return _tree(spark, d)


@query("t1_top_sites", with_sql(TRACE_SQL, SYMBOL_SQL, PAIRED, MOVED, SITES, NODES, TREE) + """SELECT * FROM (
  SELECT device_id, regexp_extract(node, '^(.*)/[^/]*$', 1) AS parent, node, max_use, used,
    CAST(row_number() OVER (PARTITION BY device_id, regexp_extract(node, '^(.*)/[^/]*$', 1) ORDER BY max_use DESC, node) AS INTEGER) AS rank FROM tree) WHERE rank <= 3""")
def t1(spark, d):
    return T.top_sites(_tree(spark, d), 3)


@query("f4_is_playlist_url", r"""WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/a.m3u8' WHEN 1 THEN '/b.M3U8?x=1' WHEN 2 THEN '/c.m3u8x' ELSE '.m3u8/d' END AS url FROM pages)
SELECT page_id, coalesce(regexp_matches(regexp_extract(url, '[^/]*$'), '^([^.]|\.[^mM]|\.[mM][^3])*(\.m3u8|\.M3U8)(\W|$)'), false) AS playlist FROM u""")
def f4(spark, d):
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 0, "/a.m3u8").when(k == 1, "/b.M3U8?x=1").when(k == 2, "/c.m3u8x").otherwise(".m3u8/d"))
    return table(spark, d, "pages").select("page_id", is_playlist_url(url).alias("playlist"))


@query("f8_normalize_path", """SELECT page_id, 'root/' || array_to_string(list_filter(string_split(CASE page_id % 3 WHEN 0 THEN 'x/' || url WHEN 1 THEN 'src//' || url ELSE 'b/' || url END, '/'), lambda p: p <> ''), '/') AS path FROM pages""")
def f8(spark, d):
    """The whole address of each page below paths with "." and ".." parts, within a root and without."""
    k = F.col("page_id") % 3
    raw = F.concat(F.when(k == 0, "/home/u/./proj/x/y/../").when(k == 1, "/a/../proj/src//").otherwise("b/./c/../"), "url")
    return table(spark, d, "pages").select("page_id", normalize_path(raw, "proj").alias("path"))


@query("f9_is_wrapper_file", with_sql(SYMBOL_SQL) + "SELECT addr, path, path LIKE '%heap\\_wrap%.c%' ESCAPE '\\' AS wrapper FROM symbol")
def f9(spark, d):
    return symbols(spark, d).select("addr", "path", is_wrapper_file(F.col("path"), WRAPPERS).alias("wrapper"))
