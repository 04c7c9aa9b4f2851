"""SimHash near-duplicates with deletion-variant signatures.

A text's words (``A-Z`` lower-cased, cut at ASCII white space) give overlapping shingles; a fingerprint bit is
1 where more than half of the shingles' XXH64 values have it. Two fingerprints link at ``distance`` (4) or fewer
differing bits.

Search: the 64 bits are cut into ``distance - 1`` segments. Among 3 segments with 4 differing bits one differs by
at most one bit (fewer segments than the 5 that an exact match would need). For that segment
each fingerprint is indexed once for each bit left out, so two fingerprints that differ there by one bit or none share a
key. Rows meet by equality of the key, and only rows in one key are compared, exactly, on all 64 bits. The number of segments follows
the number of distinct fingerprints (``segments_for``), so that a key holds eight random ones at most on average: with more than three, the
key joins ``segments - distance + 1`` segments, which differ together by at most one bit for some choice of them, and random
meetings become rarer by a power of two for each further bit of the key. The result is the same for any number.

What grows: one row for each distinct fingerprint and left-out bit (64 of 3 segments). Rows of one key never become
pairs: each task compares a key's fingerprints in blocks and emits a spanning forest of the links, at most one
row for each fingerprint and key. A key that holds more than ``most`` fingerprints is cut into blocks by hash, and each pair of blocks is compared in
a task of its own, so no task holds more than two blocks. Copies of one fingerprint count once. For components each task contracts its own edges to
stars; what doesn't fit one block by then goes through alternating large-star and small-star steps, each an aggregation and an equi-join. A component's least id is aggregated before it is joined back.

Defined results: null text is empty text; no words give fingerprint 0, linked like any other; fewer words than a shingle
give the whole sequence as one; repeated rows are rows of one class; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GATHERED, counted, cut_lineage, gathered, slices, small

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Edges that a task contracts at once, some 50 bytes each.
BLOCK_EDGES = 1_000_000


def simhash(text: str, words: int = 4) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64, len(found) - k + 1,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def keys(segments: int, distance: int) -> list[list[int]]:
    """The bits of each key: all choices of ``segments - distance + 1`` segments (at least one)."""
    if segments < distance - 1 or segments > 64:
        raise ValueError("so few segments may each differ by more than one bit")
    cuts = [64 * i // segments for i in range(segments + 1)]
    # n segments with d differing bits: the n - d + 1 that differ least together differ by at most one bit
    take = max(1, segments - distance + 1)
    return [[b for s in chosen for b in range(cuts[s], cuts[s + 1])] for chosen in itertools.combinations(range(segments), take)]


def segments_for(n: int, distance: int = 4, crowd: int = 8) -> int:
    """The fewest segments whose keys hold at most ``crowd`` of ``n`` random fingerprints on average."""
    tried = [distance - 1, *range(distance + 1, 2 * distance)]
    return next((s for s in tried if n <= crowd << (min(map(len, keys(s, distance))) - 1)), tried[-1])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(key_no, key, fp) for each (number, mask)."""
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("no"), F.lit(_signed(m)).cast("long").alias("mask")) for i, m in masks])
    return fps.select("fp", F.explode(listed).alias("m")).select(F.col("m.no").alias("key_no"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")


def _masks(segments: int, distance: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Whole masks, and (number, number of the whole mask, mask) of each with one bit left out."""
    whole = [sum(1 << b for b in bits) for bits in keys(segments, distance)]
    parts = [(k, w & ~(1 << b)) for k, w in enumerate(whole) for b in range(64) if w >> b & 1]
    return whole, [(i, k, m) for i, (k, m) in enumerate(parts)]


def variants(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """(key_no, key, fp): each key with each of its bits left out."""
    return _masked(fps, [(i, m) for i, _, m in _masks(segments, distance)[1]])


def crowded(fps: DataFrame, segments: int, distance: int, most: int) -> DataFrame:
    """(key_no, key, parts): the keys that may hold more than ``most`` fingerprints, and how many blocks they are cut into.

    A key is one of two whole values (its missing bit 0 or 1). So whole values are counted, of which there are far fewer: if neither has more
    than ``most / 2``, the key has at most ``most``.
    """
    whole, parts = _masks(segments, distance)
    counts = _masked(fps, list(enumerate(whole))).groupBy("key_no", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most // 2)
    under = F.array(*[F.struct(F.lit(i).cast("long").alias("no"), F.lit(k).cast("long").alias("whole"), F.lit(_signed(m)).cast("long").alias("mask")) for i, k, m in parts])
    each = counts.select("key", "n", F.explode(F.filter(under, lambda u: u["whole"] == F.col("key_no"))).alias("u"))
    held = each.select(F.col("u.no").alias("key_no"), F.col("key").bitwiseAND(F.col("u.mask")).alias("key"), "n").groupBy("key_no", "key").agg(F.sum("n").alias("n"))
    return held.select("key_no", "key", (2 * F.ceil(F.col("n") / most)).cast("int").alias("parts"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, distance: int) -> np.ndarray:
    """Rows (a, b) of a spanning forest of the links among distinct ``fps``, searched breadth first.

    What a found fingerprint reaches is taken out of the search, so a dense group of copies costs little
    more than one pass for each of its edges, and memory is that of the fingerprints.
    """
    left, edges = fps, []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = _popcount(left ^ x) <= distance
            if near.any():
                found = left[near]
                edges.append(np.stack([np.full(len(found), x), found], axis=1))
                reached.extend(found)
                left = left[~near]
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key that reaches into the next batch waits for it."""
        rest: list[np.ndarray] = []

        def emit(no: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.concatenate(([True], (no[1:] != no[:-1]) | (key[1:] != key[:-1]))))
            ends = np.append(new[1:], len(no))
            size = ends - new
            two = new[size == 2]
            ok = _popcount(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= distance
            a, b = [fp[two[ok]]], [fp[two[ok] + 1]]
            for s, e in zip(new[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                own = np.unique(fp[s:e])
                found = forest(own.view(np.uint64), distance).view(np.int64)
                a.append(found[:, 0])
                b.append(found[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key_no", "key", "fp")]
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            open_from = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(open_from[-1]) + 1 if len(open_from) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield emit(*(c[:cut] for c in cols))
        if rest and len(rest[0]):
            yield emit(*rest)

    return run


def links(fps: DataFrame, distance: int = 4, segments: int = 3, most: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that hold every component together."""
    found = variants(fps, segments, distance)
    hot, n = counted(crowded(fps, segments, distance, most))
    if n:
        # a block of a crowded key meets each other block of it in a task of their own
        block, parts = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.col("parts")
        others = F.filter(F.sequence(F.lit(0), parts - 1), lambda i: i != block)
        pair = F.transform(others, lambda i: F.least(i, block) * parts + F.greatest(i, block) + 1)
        found = found.join(hot, ["key_no", "key"], "left").withColumn("pair", F.explode(F.when(parts.isNull(), F.array(F.lit(0))).otherwise(pair)))
        found = found.select((F.col("key_no") + F.col("pair").cast("long") * 4096).alias("key_no"), "key", "fp")  # there are fewer key numbers
    found = found.repartition("key_no", "key").sortWithinPartitions("key_no", "key")
    return found.mapInArrow(_links(distance), "a long, b long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each upper end u has one edge and is no lower end v: then v is its component's least node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("uppers"), F.lit(0).alias("lower")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("uppers"), F.lit(1).alias("lower")))
    each = ends.groupBy("x").agg(F.sum("uppers").alias("uppers"), F.max("lower").alias("lower"))
    # counted, not filtered: see components
    return not each.agg(F.count_if((F.col("uppers") > 1) | ((F.col("uppers") > 0) & (F.col("lower") > 0)))).first()[0]


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node of each one's component: roots hang below lesser ones until no edge joins two."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (low != low[low]).any():
            low = low[low]


def _contracted(edges: DataFrame, with_roots: bool = False) -> DataFrame:
    """(u, v): of each block of ``BLOCK_EDGES`` edges in a partition the stars, v the least node; ``with_roots`` has a row (v, v) for each of those."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = least_nodes(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))
        kept = slice(None) if with_roots else u != v
        return pa.RecordBatch.from_arrays([pa.array(u[kept]), pa.array(v[kept])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_EDGES:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60, rows: int = GATHERED, n: int | None = None) -> DataFrame:
    """(node, root): the least node of each component that has an edge. ``edges``: columns a, b.

    Each task first contracts its blocks of edges to stars. Edges that fit one block (``rows``) are done by that; more
    go through large-star and small-star steps, contracted before each, until the stars fit or nothing is left to move.
    ``n`` tells the number of edges where they are gathered already.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    if n is None or n > rows:
        now, n = gathered(now.distinct(), rows)
    for _ in range(rounds):
        if n > rows:
            now, n = gathered(_contracted(now).distinct(), rows)
        if n <= rows:
            return _contracted(now, with_roots=True).toDF("node", "root")
        if _are_stars(now):
            break
        # u > v in each edge; upward edges go from the lesser node. No filter stands above a union: Spark 4.1's optimizer fails on some
        upward = now.select(F.col("v").alias("u"), F.col("u").alias("w"))
        least = now.select("u", F.col("v").alias("w")).unionByName(upward).groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = upward.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now, n = gathered(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, segments: int | None = None, most: int = 16_384
) -> DataFrame:
    """(id, fingerprint, component_id): a row for each document; component_id is the least id of its component."""
    own = cut_lineage(with_fingerprint(docs, id_col, text_col, words))
    least, n = counted(own.groupBy("fp").agg(F.min("id").alias("first")))
    found, n = gathered(links(least.select("fp"), distance, segments or segments_for(n, distance), most))
    roots = small(components(found, n=n).withColumnRenamed("node", "fp"), n)
    joined = cut_lineage(least.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # read anew on both sides, so that a component of very many fingerprints is split in the join, as is a fingerprint of very many copies below
    smallest = cut_lineage(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    named = joined.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
