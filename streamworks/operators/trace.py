"""Allocation traces: pairing, leaks, usage, call trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_wrapper_file
from .windows import running_balance

BY_ADDRESS = ["device_id", "addr"]


def filter_trace_flag(df: DataFrame, mask: int) -> DataFrame:
    """keeps '+' rows that share a bit with the mask (0: all); '-' rows stay."""
    return df if not mask else df.filter((F.col("act") != "+") | (F.col("flag").bitwiseAND(mask) != 0))


def _address() -> Window:
    return Window.partitionBy(*BY_ADDRESS).orderBy("seq")


def with_pairing(df: DataFrame) -> DataFrame:
    """Each '-' with the live '+' of its address, by looking one row back: live means that the row before is a '+'."""
    prev = lambda c: F.lag(c).over(_address())
    closes = (F.col("act") == "-") & (prev("act") == "+")
    return (
        df.withColumn("closes", F.coalesce(closes, F.lit(False)))
        .withColumn("alloc_seq", F.when(F.col("closes"), prev("seq")))
        .withColumn("alloc_size", F.when(F.col("closes"), prev("size")))
        .withColumn("alloc_module", F.when(F.col("closes"), prev("module")))
        .withColumn("alloc_stack", F.when(F.col("closes"), prev("stack")))
        .withColumn("next_act", F.lead("act").over(_address()))
    )


def pair_alloc_free(df: DataFrame) -> DataFrame:
    """(device_id, addr, alloc_seq, free_seq, size, module)."""
    return with_pairing(df).filter("closes").select("device_id", "addr", "alloc_seq", F.col("seq").alias("free_seq"), F.col("alloc_size").alias("size"), F.col("alloc_module").alias("module"))


def find_leaks(df: DataFrame) -> DataFrame:
    """Allocations that are the last record of their address."""
    return df.withColumn("next_act", F.lead("act").over(_address())).filter("act = '+' AND next_act IS NULL").select("device_id", "addr", "seq", "size", "module", "stack")


def keep_matched(df: DataFrame, matched: bool = True) -> DataFrame:
    """J12: '-' rows that close an allocation, or (False) those that don't."""
    return with_pairing(df).filter("act = '-'").filter(F.col("closes") if matched else ~F.col("closes")).select(*df.columns)


def drop_orphan_frees(df: DataFrame) -> DataFrame:
    """The trace without '-' rows that close nothing."""
    return with_pairing(df).filter((F.col("act") == "+") | F.col("closes")).select(*df.columns)


def _nodes(low: Column, high: Column) -> Column:
    """array<struct<level, node>>: the largest aligned blocks of 2^level addresses that make up [low, high], two of each level at most."""
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def of_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, last = shift(low + size - 1, k), shift(high + 1, k) - 1  # blocks that lie inside
        inside = first <= last
        node = lambda x: F.struct(k.alias("level"), x.alias("node"))
        # a block whose sibling isn't inside too
        return F.array_compact(F.array(F.when(inside & (first % 2 != 0), node(first)), F.when(inside & (last % 2 == 0), node(last))))

    top = F.floor(F.log2((high - low + 1).cast("double"))).cast("int") + 1  # one more, should the logarithm be rounded down
    return F.flatten(F.transform(F.sequence(F.lit(0), top), of_level))


def last_owner(df: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (device_id, probe) the latest allocation with addr <= probe <= addr + size, both ends inclusive.

    An allocation is cut into aligned blocks of powers of two, two of each size at most, and each block keeps its latest owner (combined
    before the shuffle). A probe asks the one block of each size that it lies in. So however many allocations cover an address, a
    probe meets as many rows as there are block sizes.
    """
    plus = df.filter("act = '+'").select("device_id", "addr", "size", "seq", F.explode(_nodes(F.col("addr"), F.col("addr") + F.col("size"))).alias("b"))
    owner = plus.groupBy("device_id", "b.level", "b.node").agg(F.max_by(F.struct("addr", "size", "seq"), "seq").alias("a"))
    levels = owner.groupBy("device_id").agg(F.max("level").alias("most"))
    asked = probes.distinct().join(levels, "device_id").withColumn("level", F.explode(F.sequence(F.lit(0), "most")))
    asked = asked.withColumn("node", F.call_function("shiftright", F.col("probe"), F.col("level")))
    best = asked.join(owner, ["device_id", "level", "node"]).groupBy("device_id", "probe").agg(F.max_by("a", F.col("a.seq")).alias("a"))
    best = best.select("device_id", "probe", "a.addr", "a.size", "a.seq", (F.col("probe") - F.col("a.addr")).alias("position"))
    frees = df.filter("act = '-'").groupBy("device_id", "addr").agg(F.max("seq").alias("free_seq"))
    return best.join(frees, BY_ADDRESS, "left").select(
        "device_id", "probe", "addr", "size", "position", F.coalesce(F.col("free_seq") > F.col("seq"), F.lit(False)).alias("freed")
    )


def resolve_call_site(stacks: DataFrame, symbols: DataFrame, wrappers: list[str], after: int | None = None) -> DataFrame:
    """For each distinct ``stack`` the first frame that resolves outside wrapper files, else the last frame if it resolves.

    With ``after`` only frames behind the first one at that address count; a stack without it doesn't resolve.

    Distinct stacks are resolved once; Spark broadcasts the symbols only below its size limit. ``error``: nothing resolved.
    """
    distinct = stacks.select("stack").distinct()
    frame = distinct.select("stack", F.posexplode("stack").alias("pos", "addr"))
    known = frame.join(symbols, "addr", "left").withColumn("wrapper", is_wrapper_file(F.col("path"), wrappers))
    if after is not None:
        behind = (F.array_position("stack", F.lit(after).cast("long")) > 0) & (F.col("pos") >= F.array_position("stack", F.lit(after).cast("long"))) & (F.col("addr") != after)
        known = known.withColumn("path", F.when(behind, F.col("path"))).withColumn("line", F.when(behind, F.col("line")))
    last = F.size("stack") - 1
    site = F.struct("path", "line")
    found = known.groupBy("stack").agg(
        F.min_by(site, F.when(F.col("path").isNotNull() & ~F.col("wrapper"), F.col("pos"))).alias("first"),
        F.max(F.when((F.col("pos") == last) & F.col("path").isNotNull(), site)).alias("last"),
        F.max(F.when(F.col("path").isNotNull() & ~F.col("wrapper"), 1)).alias("any"),
    )
    best = F.when(F.col("any") == 1, F.col("first")).otherwise(F.col("last"))
    return found.select("stack", best["path"].alias("path"), best["line"].alias("line"), best.isNull().alias("error"))


def usage_events(df: DataFrame) -> DataFrame:
    """Signed byte changes: '+' adds its size, a '-' that closes takes its allocation's size from the module that allocated."""
    p = with_pairing(df).filter((F.col("act") == "+") | F.col("closes"))
    plus = F.col("act") == "+"
    return p.select(
        "device_id", "seq", F.when(plus, F.col("module")).otherwise(F.col("alloc_module")).alias("module"),
        F.when(plus, F.col("size")).otherwise(-F.col("alloc_size")).alias("delta"),
    )


def running_usage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Running balance and peak in event order."""
    return running_balance(df, keys, "seq", "delta")


def usage_by_module(df: DataFrame) -> DataFrame:
    """A1: unfreed bytes and peak of each device's modules and (module null) of the whole device."""
    changes = usage_events(df)
    told = [F.sum("delta").alias("used"), F.max("peak").alias("peak"), F.count("*").alias("n_events")]
    by_module = running_usage(changes, ["device_id", "module"]).groupBy("device_id", "module").agg(*told)
    total = running_usage(changes, ["device_id"]).groupBy("device_id").agg(*told)
    return by_module.unionByName(total.withColumn("module", F.lit(None).cast("string")))


def leak_summary(df: DataFrame) -> DataFrame:
    """A2: leaks and their bytes by module, device and in total (grand total: device null)."""
    return find_leaks(df).rollup("device_id", "module").agg(F.count("*").alias("n_leaks"), F.sum("size").alias("leaked_bytes"))


def prefixes(path: Column, line: Column) -> Column:
    """All prefixes of path/line as joined paths."""
    parts = F.concat(F.split(path, "/"), F.array(line.cast("string")))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def call_tree(df: DataFrame, sites: DataFrame) -> DataFrame:
    """A3: a row for each device and path prefix. A '+' of size 0 counts as a free, as its size isn't above 0."""
    p = with_pairing(df).filter((F.col("act") == "+") | F.col("closes"))
    plus = F.col("act") == "+"
    moved = p.select(
        "device_id", "seq", F.when(plus, F.col("stack")).otherwise(F.col("alloc_stack")).alias("stack"),
        F.when(plus, F.col("size")).otherwise(-F.col("alloc_size")).alias("delta"),
    )
    located = moved.join(sites.filter(~F.col("error")), "stack")
    nodes = located.select("device_id", "seq", "delta", F.explode(prefixes(F.col("path"), F.col("line"))).alias("node"))
    run = running_usage(nodes, ["device_id", "node"])
    return run.groupBy("device_id", "node").agg(
        F.count_if(F.col("delta") > 0).alias("alloc_count"), F.count_if(F.col("delta") <= 0).alias("free_count"),
        F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("total_malloc"), F.sum("delta").alias("used"), F.max("peak").alias("max_use"),
    )


def top_sites(tree: DataFrame, k: int) -> DataFrame:
    """The k children of each node by max_use (ties: by name)."""
    parent = F.regexp_extract("node", r"^(.*)/[^/]*$", 1)
    own = Window.partitionBy("device_id", "parent").orderBy(F.desc("max_use"), "node")
    return tree.withColumn("parent", parent).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("device_id", "parent", "node", "max_use", "used", "rank")
