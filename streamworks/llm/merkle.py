"""A Merkle manifest of a dataset: a digest tree for each source below a tree of the sources, a proof for each row, and proofs folded again to find tampering.

A row's leaf is the digest of its columns. Leaves of a source ascend by id and are numbered over range partitions, so that a source with most rows is cut
like any other; three consecutive nodes become their parent until one is left.

**Cogrouped subtree exchange.** ``FAN ** height`` consecutive nodes are a superblock. Going up, every superblock is reduced to its top node, and the top
nodes are numbered nodes again; a few rounds lead to a source's subroot, and the subroots are the nodes of one more tree. Going down, each superblock gets
one row of what it needs from outside: the siblings on the way from its top to the root, with the subroot and the root. Nodes and outer row are cogrouped by
superblock, and one ``applyInPandas`` finishes there: it reduces the superblock, joins inner and outer siblings to a proof for each node, and folds a claimed
leaf along that proof up to the root. A group holds ``FAN ** height`` digests and an outer row, whatever the table's size; a superblock's nodes are never
moved for another one's sake. Digests move as 32 bytes; texts stay where they were read.

Defined results: a null column is ``-``; null sources are a tree of their own and come first, then sources by their UTF-8 bytes; rows without an id come
first, rows with the same id by their leaf; equal rows keep their number, each with its own proof; a lone leaf is its tree's subroot, a lone subroot the root;
a proof without siblings is that of an empty string; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

FAN = 3
#: Levels of a superblock: 729 nodes.
HEIGHT = 6
#: Rows of range starts (one for each range and tree that meet) that are broadcast after they were counted; more are joined.
BROADCAST_ROWS = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: Sequence[str | Column]) -> Column:
    """The digest of a row (lowercase hex): each column as its byte count, a colon and its value, or ``-`` if null."""

    def part(c: str | Column) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def _digest(nodes: str) -> str:
    return hashlib.sha256(nodes.encode()).hexdigest()


def levels_above(count: int) -> int:
    """How often ``count`` nodes are reduced until one is left."""
    n = 0
    while count > 1:
        count, n = -(-count // FAN), n + 1
    return n


def _subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones to the top."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column tree) and their number within their tree in order of ``order`` (nulls first), and the count of rows of the tree.

    Ranges of (tree, order) are sorted one by one; the counts of each tree in each range give every range's start. Equal rows are split as well.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "copy")]
    placed = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("copy")
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    starts = cut_lineage(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(tree).alias("count")))
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return placed.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _with_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**height)).cast("long"))


def _top(height: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The top node of a superblock, numbered by the superblock."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        count, pos = int(rows["count"].iloc[0]), int(rows["pos"].iloc[0])
        levels = min(height, levels_above(count))
        top = _subtree([x.hex() for x in rows["node"]], levels)[-1]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "pos": [pos // FAN**height], "count": [-(-count // FAN**levels)], "node": [bytes.fromhex(top[0])]})

    return run


def _exchange(height: int, last: bool, full: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Inner and outer siblings of a superblock joined to a proof for each node; the last round folds the claimed leaves as well."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        nodes = [x.hex() for x in rows["node"]]
        levels = _subtree(nodes, min(height, levels_above(int(rows["count"].iloc[0]))))
        paths = [list(zip(outer["before"].iloc[0], outer["after"].iloc[0], strict=True))]  # of each node of a level, from the top down
        for level in reversed(levels[:-1]):
            own = []
            for i in range(len(level)):
                run_ = i - i % FAN
                own.append([("".join(level[run_:i]), "".join(level[i + 1 : run_ + FAN])), *paths[i // FAN]])
            paths = own
        subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
        fixed = {"subroot": subroot, "root": root}
        if not last:
            found = {"tree": rows["tree"], "block": rows["pos"], "before": [[b for b, _ in p] for p in paths], "after": [[a for _, a in p] for p in paths]}
            return pd.DataFrame(found).assign(**fixed)
        folded = []
        for claimed, path in zip(rows["claimed"], paths, strict=True):
            node = claimed.hex()
            for b, a in path:
                node = _digest(b + node + a)
            folded.append(node)
        found = {"id": rows["id"], "leaf": nodes, "proof_sha256": [_digest("".join(b + a for b, a in p)) for p in paths], "folded_root": folded}
        if full:
            found |= {"before": [[b for b, _ in p] for p in paths], "after": [[a for _, a in p] for p in paths]}
        return pd.DataFrame(found).assign(**fixed)

    return run


PATH = "before array<string>, after array<string>"


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The numbered nodes of each round of superblocks; the last one has a single node for each tree."""
    most = nodes.agg(F.max("count")).first()[0] or 1
    out = [_with_block(nodes, height)]
    while most > 1:
        tops = out[-1].select("tree", "block", "pos", "count", "node").groupBy("tree", "block").applyInPandas(_top(height), "tree string, pos long, count long, node binary")
        out.append(_with_block(cut_lineage(tops), height))
        most = -(-most // FAN**height)
    return out


def _down(rounds: list[DataFrame], outer: DataFrame, height: int, last: Callable, schema: str) -> DataFrame:
    """Proofs of the nodes of the lowest round, given the outer row of each tree."""
    for nodes in reversed(rounds[:-1] if len(rounds) > 1 else rounds):
        lowest = nodes is rounds[0]
        got = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        if lowest:
            return got.applyInPandas(last, schema)
        outer = got.applyInPandas(_exchange(height, False, False), f"tree string, block long, {PATH}, subroot string, root string")
    raise AssertionError("a tree has a round at least")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", columns: Sequence[str] = COLUMNS, claimed: Column | None = None, height: int = HEIGHT, full: bool = True
) -> DataFrame:
    """(id, leaf, proof_sha256, folded_root, subroot, root) of each row, and with ``full`` its proof: for each level the siblings before and after.

    ``claimed`` is a leaf (hex) that each row is checked with instead of its own; ``folded_root`` is the root that follows from it and the proof.
    """
    own = leaf(columns)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),  # null first
        F.col(id_col).alias("id"), F.unhex(own).alias("node"), F.unhex(own if claimed is None else claimed).alias("claimed"),
    )
    id_type = rows.schema["id"].dataType
    leaves = numbered(cut_lineage(rows), ["id", "node"]).withColumn("id", F.col("id").cast("string"))  # pandas would make doubles of whole numbers beside a null
    rounds = _rounds(leaves, height)

    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node")
    sources = _rounds(numbered(subroots, ["id"]).withColumn("claimed", F.col("node")), height)
    top = sources[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("block"), *(F.array().cast("array<string>").alias(c) for c in ("before", "after")), F.lower(F.hex("node")).alias("root"))
    of_sources = _down(
        sources, top.withColumn("subroot", F.col("root")), height, _exchange(height, True, True),
        f"id string, leaf string, proof_sha256 string, folded_root string, {PATH}, subroot string, root string",
    )
    outer = cut_lineage(of_sources.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("block"), "before", "after", F.col("leaf").alias("subroot"), "root"))

    schema = "id string, leaf string, proof_sha256 string, folded_root string, " + f"{PATH}, " * full + "subroot string, root string"
    found = _down(rounds, outer, height, _exchange(height, True, full), schema)
    return found.withColumn("id", F.col("id").cast(id_type))


def tampered_rows(id_col: str = "doc_id") -> Column:
    """The rows that the check tampers with: 2 divides the crc32 of the id's digits. A null id isn't one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def checked_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``documents``, each row verified against the text as tampering left it (line ends deleted)."""
    text = F.when(tampered_rows(), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, claimed=leaf([*COLUMNS[:-1], text]), height=height, full=False).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
