"""Near copies by their shingles: texts whose sets of five-word shingles have a Jaccard similarity of ``least`` (0.8) or more.

SimHash at 4 bits reaches a similarity of about 0.95; this finds what lies between. Candidates come from MinHash bands: 32 of 6 rows each, so
that a pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^32 > 0.9999. Every candidate is then checked by its exact sets, so no pair below
``least`` is linked. Texts with equal sets are one class.

Members of a band value are compared in rounds (``ROUNDS``), each time with one of them, another in each round, and only if they are still in different
components; the first rounds look at few bands, which join most of a dense group. So such a group costs a few comparisons for each member. What is
still apart after the rounds are unlike texts that meet in a band: by chance, or because they share a template. Band values that hold ``CROWD`` of
them or fewer are compared pair by pair, which is in proportion to their members. The members of larger ones meet by their rarest shingles instead: sets of n shingles can only have the
similarity if they share one of the n - ceil(0.8 n) + 1 that are rarest among those texts, so pages of one template, whose rare shingles are
their own, don't meet at all, and no near pair is lost. Sets are made only for texts that are in a pair or in such a value.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_and_gather, cut_lineage, gathered, slices, small
from .simhash import LOWER, SEED, WORD, components

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 32, 6
#: (bands, salt): how many bands a round looks at, and what picks the member that the others are compared with.
ROUNDS = ((4, 0), (BANDS, 1), (BANDS, 2))
#: Members of a band value, still apart after the rounds, that are compared pair by pair at most; more meet by rare shingles.
CROWD = 32
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' XXH64 values, sorted; words as SimHash has them."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + k]), SEED) for i in range(len(found) - k + 1) if k), np.uint64))


def band_values(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band, unlike those of other bands; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[i : i + 2048, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    made = b"".join(xxhash.xxh64_digest(row.tobytes(), SEED + band) for band, row in enumerate(least.reshape(BANDS, ROWS)))
    return np.frombuffer(made, "<i8").tolist()


def marked(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, node, n, bands): node names the set of n shingles."""
    kept = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_values(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), bands], ["key", "node", "n", "bands"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, node long, n long, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<bigint>")


def met_by(rows: DataFrame, value: str, fits) -> DataFrame:
    """Pairs (p, q, a, b) of rows (node, n, c) that share a value, are of different components and fit in size."""
    l, r = rows.alias("l"), rows.alias("r")
    on = (F.col(f"l.{value}") == F.col(f"r.{value}")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.c") != F.col("r.c"))
    return l.join(r, on & fits(F.col("l.n"), F.col("r.n"))).select(F.col("l.node").alias("p"), F.col("r.node").alias("q"), F.col("l.c").alias("a"), F.col("r.c").alias("b"))


def rare_shingles(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, h): of each set (node, hashes) the shingles, rarest first, of which two sets with a similarity of ``least`` share one; those of one set only are left out."""
    each = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("held")), "h")
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "h"))
    prefix = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    return cut_lineage(counted.withColumn("place", place).filter((F.col("place") <= prefix) & (F.col("held") > 1)).select("node", "h"))


def merged(docs: DataFrame, found: DataFrame, key: str, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``found`` (key, component_id: the least key of a component so far) with components joined where texts are near copies."""
    found = cut_lineage(found.select(F.col(key).alias("key"), "component_id").distinct())
    # components by number, in their order
    numbers = found.select("component_id").distinct().repartitionByRange("component_id").sortWithinPartitions("component_id")
    numbers = cut_lineage(numbers.withColumn("c", F.monotonically_increasing_id()))
    found = cut_lineage(found.join(numbers, "component_id").select("key", "c"))
    marks = cut_lineage(marked(docs, key, text_col).dropDuplicates(["key"]))
    member = marks.select("key", "node").join(found, "key").select("node", F.col("c").alias("own")).distinct()
    lowest = member.groupBy("node").agg(F.min("own").alias("c"))
    edges = member.join(lowest, "node").filter(F.col("own") != F.col("c")).select(F.col("own").alias("a"), F.col("c").alias("b"))
    node = cut_lineage(marks.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")).join(lowest, "node"))

    fits = lambda n, m: F.least(n, m) >= least * F.greatest(n, m) - 1e-9

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, hashes) of some nodes."""
        # counted, so that the texts are not shuffled for few pairs; more than the bound are joined by a shuffle
        wanted, n = gathered(node.select("node", "key").join(nodes, "node"))
        texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(wanted, n), "key").select("node", "text")
        return cut_lineage(_sets(texts).dropDuplicates(["node"]))

    def checked(pairs: DataFrame) -> tuple[DataFrame, int]:
        """(a, b): the components of the pairs (p, q, a, b) of nodes whose sets are near, and their number."""
        pairs = cut_and_gather(pairs.distinct())
        few = F.broadcast if pairs.rdd.getNumPartitions() == 1 else lambda df: df
        sets = sets_of(few(pairs.select(F.explode(F.array("p", "q")).alias("node")).distinct()))
        both = sets.select(F.col("node").alias("p"), F.col("hashes").alias("hp")).join(few(pairs), "p").join(sets.select(F.col("node").alias("q"), F.col("hashes").alias("hq")), "q")
        shared = F.size(F.array_intersect("hp", "hq"))
        return gathered(both.filter(shared >= least * (F.size("hp") + F.size("hq") - shared) - 1e-9).select("a", "b").distinct())

    new, n = gathered(edges)
    place, rows, joined = node.select("node", "n", "c", "bands"), None, []
    for bands, salt in (*ROUNDS, (BANDS, None)):
        # who is where by now; the edges of each round are between the components of the one before
        if n:
            joined.append(new)
            roots = small(components(new, n=n).select(F.col("node").alias("c"), F.col("root").alias("r")), n)
            now = lambda df: cut_lineage(df.join(roots, "c", "left").withColumn("c", F.coalesce("r", "c")).drop("r"))  # noqa: B023, E731
            place, rows = (now(place), None) if rows is None else (place, now(rows))  # later rounds look at rows only
        # rows of band values that hold more than one component; once all bands are in, later rounds only look at what is left
        each = place.select("node", "n", "c", F.explode(F.slice("bands", 1, bands)).alias("value")) if rows is None else rows.select("node", "n", "c", "value")
        # x: the member that the others are compared with
        met = each.groupBy("value").agg(
            F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.min_by(F.struct("node", "n", "c"), F.xxhash64("node", F.lit(salt or 0))).alias("x")
        )
        met, values = gathered(met.filter("low != high").select("value", "members", "x"))
        if bands == BANDS:
            if not values:
                n = 0
                break
            rows = each = cut_and_gather(each.join(small(met.select("value"), values), "value"))
        each = each.join(small(met, values), "value")
        if salt is None:
            pairs = met_by(each.filter(F.col("members") <= CROWD), "value", fits)
            crowded, n = gathered(each.filter(F.col("members") > CROWD).select("node", "n", "c").distinct())
            if n:
                pairs = pairs.union(met_by(rare_shingles(sets_of(small(crowded.select("node"), n)), least).join(crowded, "node"), "h", fits))
        else:
            pairs = each.filter((F.col("c") != F.col("x.c")) & fits(F.col("n"), F.col("x.n")))
            pairs = pairs.select(F.col("x.node").alias("p"), F.col("node").alias("q"), F.col("x.c").alias("a"), F.col("c").alias("b"))
        new, n = checked(pairs)
    if n:
        joined.append(new)
    # all rounds' edges are between numbers, so together they make the components
    if joined:
        roots = components(functools.reduce(DataFrame.union, joined)).select(F.col("node").alias("c"), F.col("root").alias("r"))
        found = found.join(roots, "c", "left").select("key", F.coalesce("r", "c").alias("c"))
    return found.join(numbers, "c").select(F.col("key").alias(key), "component_id")
