"""Exact top-k by inner product, by norm buckets with pruning inside each bucket.

Vectors are integer (``floor(scale * x)``). Candidates are grouped by length into buckets, cut into blocks of at most ``block`` rows
and packed, one row a block; they stay where they are. The queries come to them: packed likewise, in rounds of at most ``round_bytes`` (summed up before
each is sent), each round broadcast once. A task runs over its blocks, longest first, and keeps the k best of every query of the round, whose k-th
score is the query's threshold t and rises from block to block. The longest bucket comes first for all tasks, so that the others begin with a threshold.

In a block each query has a local cosine threshold c = t / (|q| * greatest length of the block). If c is above 1 the query skips the block. Else the block is pruned
by length (candidates with |p| < t / |q| go, a suffix of the block's order) or also by coordinates (the few largest coordinates of q; a unit vector
within the angle has each of them in q_i c -+ sqrt((1 - q_i^2)(1 - c^2))), whichever is cheaper by an estimate of what is left.
What is left is verified by exact integer products. ``pruned_shares`` reports how many pairs each branch met and how many of them it verified.

A candidate equal to the threshold is never pruned (bounds are widened by more than rounding can reach), so ties to the smaller id are
exact. Work: the product of queries and candidates at worst. What is shuffled: each vector once, to pack it, and k rows for each query and task.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids; a
query and a candidate of different dimension don't meet; an id in several rows counts once, with its highest score,
and a query id in several rows asks with its least vector; a query with fewer candidates gets them all; an empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

WIDEN = 1e-7
COORDINATES = 4  # how many of a query's coordinates prune
PRODUCT = 0.2  # cost of one multiplication in a product of blocks, against one comparison of coordinates


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec array<long>) of the rows that take part."""
    doubles = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = doubles.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(finite)
    return kept.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("vec"))


PACKED = "dim int, bucket int, ids binary, vecs binary"


def _pack(rows: int):
    """(dim, bucket, id, vec), sorted by dim and bucket, to packed blocks in order of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key: tuple | None = None

        def emit() -> pa.RecordBatch:
            ids = np.array([i for i, _ in held], np.int64)
            vecs = np.stack([v for _, v in held]).astype(np.int64)
            norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
            order = np.lexsort((ids, -norms))
            row = (key[0], key[1], ids[order].tobytes(), vecs[order].tobytes())
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["dim", "bucket", "ids", "vecs"])

        for batch in batches:
            for d, b, i, v in zip(batch.column("dim").to_pylist(), batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), batch.column("vec").to_numpy(zero_copy_only=False), strict=True):
                if held and (key != (d, b) or len(held) >= rows):
                    yield emit()
                    held = []
                key = (d, b)
                held.append((i, np.asarray(v)))
        if held:
            yield emit()

    return run


def _exact(vecs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer products of all queries and vectors: as doubles where they are exact, else as 64-bit integers."""
    bound = float(np.abs(vecs).max(initial=0)) * float(np.abs(queries).sum(axis=1).max(initial=0))
    if bound < 2**53:
        return queries.astype(np.float64) @ vecs.astype(np.float64).T
    if bound >= 2**63:
        raise OverflowError("a score does not fit into 64 bits")
    return queries @ vecs.T


def coordinate_bounds(unit: float, local: float) -> tuple[float, float]:
    """Where a coordinate of a unit vector lies whose cosine with q is ``local`` or more, if it is ``unit`` in q."""
    spread = np.sqrt(max(0.0, (1 - unit**2) * (1 - local**2)))
    low, high = unit * local - spread - WIDEN, unit * local + spread + WIDEN
    if unit >= local:
        high = 1 + WIDEN  # q itself lies beyond the boundary circle there
    if -unit >= local:
        low = -1 - WIDEN
    return low, high


def estimated_share(unit: np.ndarray, local: float) -> float:
    """How many of random directions the coordinates of a query would leave: as if coordinates were independent and normal."""
    share, scale = 1.0, math.sqrt(len(unit) / 2)
    for x in unit[np.argsort(-np.abs(unit))[:COORDINATES]].tolist():
        low, high = coordinate_bounds(x, local)
        share *= (math.erf(high * scale) - math.erf(low * scale)) / 2
    return share


class Best:
    """The k best so far of some queries of one dimension."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, thetas: np.ndarray, k: int):
        self.ids, self.vecs, self.k, self.thetas = ids, vecs, k, thetas.copy()
        self.norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        self.found: list[dict[int, int]] = [{} for _ in ids]
        self.stats: dict[str, list[int]] = {b: [0, 0] for b in ("skipped", "by length", "by coordinates")}

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """One block, in order of falling length."""
        norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        known = self.thetas > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(known, np.where(self.norms > 0, self.thetas / self.norms, np.inf), -np.inf)
        local = need / max(float(norms[0]), 1e-300) - WIDEN
        upto = np.searchsorted(-norms, -need * (1 - WIDEN), side="right")
        upto = np.where(known, upto, len(ids))
        live = (local <= 1) & (upto > 0)
        self._count("skipped", int((~live).sum()) * len(ids), 0)
        whole = []
        for i in np.flatnonzero(live).tolist():
            share = estimated_share(self.vecs[i] / self.norms[i], local[i]) if known[i] and local[i] > 0 else 1.0
            if COORDINATES + share * vecs.shape[1] < PRODUCT * vecs.shape[1]:
                self._by_coordinates(i, local[i], ids, vecs, norms, int(upto[i]))
            else:
                whole.append(i)
        copies = int(np.unique(ids, return_counts=True)[1].max(initial=1))
        for at in range(0, len(whole), 256):
            part = np.array(whole[at : at + 256])
            rows = int(upto[part].max())
            scores = _exact(vecs[:rows], self.vecs[part])
            self._count("by length", len(part) * len(ids), len(part) * rows)
            least, most = self.thetas[part], (self.k + 1) * copies  # of the query's own id and of copies one stays
            if rows > most and np.count_nonzero(scores >= least[:, None]) > 8 * most * len(part):
                least = np.maximum(least, np.partition(scores, rows - most, axis=1)[:, rows - most])
            hit, col = np.nonzero(scores >= least[:, None])
            cuts = np.searchsorted(hit, np.arange(len(part) + 1))
            for n in np.unique(hit).tolist():
                own = col[cuts[n] : cuts[n + 1]]
                self._add(int(part[n]), ids[own], scores[n, own])

    def _by_coordinates(self, i: int, local: float, ids: np.ndarray, vecs: np.ndarray, norms: np.ndarray, upto: int) -> None:
        unit, rows = self.vecs[i] / self.norms[i], np.arange(upto)
        for f in np.argsort(-np.abs(unit))[:COORDINATES].tolist():
            low, high = coordinate_bounds(float(unit[f]), local)  # a shorter candidate needs a greater cosine, so the block's is safe for all
            at = vecs[rows, f] / norms[rows]
            rows = rows[(at >= low) & (at <= high)]
        self._count("by coordinates", len(ids), len(rows))
        scores = _exact(vecs[rows], self.vecs[i : i + 1])[0]
        kept = scores >= self.thetas[i]
        self._add(i, ids[rows[kept]], scores[kept])

    def _count(self, branch: str, pairs: int, verified: int) -> None:
        self.stats[branch][0] += pairs
        self.stats[branch][1] += verified

    def _add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        found, own = self.found[i], int(self.ids[i])
        for c, score in zip(ids.tolist(), scores.tolist(), strict=True):
            if c != own and int(score) > found.get(c, -(1 << 63)):
                found[c] = int(score)
        if len(found) > self.k:
            self.found[i] = found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[: self.k])
        if len(found) == self.k:
            self.thetas[i] = max(self.thetas[i], min(found.values()))


def _search(k: int, sent: Broadcast, report: bool):
    """Runs the round's queries over a task's blocks: (query_id, id, score), or (branch, pairs, verified) of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for x in batch.to_pylist():
                d = x["dim"]
                if d in sent.value:
                    if d not in best:
                        raw_ids, raw_vecs, raw_thetas = sent.value[d]
                        best[d] = Best(np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_vecs, np.int64).reshape(-1, d), np.frombuffer(raw_thetas), k)
                    best[d].meet(np.frombuffer(x["ids"], np.int64), np.frombuffer(x["vecs"], np.int64).reshape(-1, d))
        if report:
            rows = [(b, *n) for own in best.values() for b, n in own.stats.items()]
            names, kinds = ["branch", "pairs", "verified"], [pa.string(), pa.int64(), pa.int64()]
        else:
            rows = [(int(q), c, s) for own in best.values() for q, found in zip(own.ids.tolist(), own.found, strict=True) for c, s in found.items()]
            names, kinds = ["query_id", "id", "score"], [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], names)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ids once. Rank limits are pushed below the shuffle by Spark."""
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
    block: int = 2048, buckets: int = 16, round_bytes: int = 32 << 20, report: bool = False,
) -> DataFrame:
    """(query_id, rank, id, score). ``is_query`` is a condition on the id column."""
    rows = integer_vectors(df, id_col, vec_col, scale).withColumn("dim", F.size("vec"))
    asked = rows.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    measured = rows.withColumn("length", length)
    cuts = measured.agg(F.percentile_approx("length", [i / buckets for i in range(1, buckets)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)  # bucket 0 holds the longest
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("length"))) if cuts else F.lit(0)
    placed = measured.withColumn("bucket", bucket.cast("int"))
    # a bucket may hold most rows (one common length): it is dealt out in parts, each of about a block
    sizes = placed.groupBy("dim", "bucket").count().collect()  # a row for each dimension and bucket
    parts = {(r["dim"], r["bucket"]): -(-5 * r["count"] // (4 * block)) for r in sizes}
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    number = F.create_map(*[x for (d, b), n in parts.items() for x in (F.concat_ws(":", F.lit(d), F.lit(b)), F.lit(n))])
    part = F.pmod(F.xxhash64("id"), F.element_at(number, F.concat_ws(":", "dim", "bucket"))).cast("int")

    dealt = placed.withColumn("part", part).repartition("dim", "bucket", "part").sortWithinPartitions("dim", "bucket", "part")
    blocks = cut_lineage(dealt.select("dim", "bucket", "id", "vec").mapInArrow(_pack(block), PACKED))
    asking = max(1, -(-5 * asked.count() // (4 * block)))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(asking)).cast("int")).repartition("dim", "bucket").sortWithinPartitions("dim", "bucket")
    queries = cut_lineage(asked.select("dim", "bucket", "id", "vec").mapInArrow(_pack(block), PACKED))
    queries, rounds = _in_rounds(queries, round_bytes)

    least = blocks.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    # tasks take their blocks longest first
    longest = blocks.join(least, ["dim", "bucket"], "left_semi").sortWithinPartitions("bucket")
    shorter = blocks.join(least, ["dim", "bucket"], "left_anti").sortWithinPartitions("bucket")
    found, kind = [], "branch string, pairs long, verified long" if report else "query_id long, id long, score long"
    context = df.sparkSession.sparkContext
    for r in range(rounds):
        held = [tuple(x) for x in queries.filter(F.col("round") == r).select("dim", "ids", "vecs").collect()]  # round_bytes at most
        first = _once(longest.mapInArrow(_search(k, context.broadcast(_joined(held, {})), False), "query_id long, id long, score long"))
        first = cut_lineage(_best(first, k))
        known = {x["query_id"]: float(x["score"]) for x in first.filter(F.col("rank") == k).select("query_id", "score").collect()}  # a row for each query of the round
        rest = shorter.mapInArrow(_search(k, context.broadcast(_joined(held, known)), report), kind)
        if report:
            found += [longest.mapInArrow(_search(k, context.broadcast(_joined(held, {})), True), kind), rest]
        else:
            found.append(cut_lineage(_best(_once(first.select("query_id", "id", "score").unionByName(rest)), k)))
    if report:
        return reduce(DataFrame.unionByName, found).groupBy("branch").agg(F.sum("pairs").alias("pairs"), F.sum("verified").alias("verified"))
    return reduce(DataFrame.unionByName, found).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def pruned_shares(df: DataFrame, is_query: Column, **options) -> DataFrame:
    """(branch, pairs, verified): pairs of a query and a candidate that a search meets in each branch, and those it multiplies out."""
    return top_k(df, is_query, report=True, **options)


def _in_rounds(queries: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Query blocks with the number of their round, and the number of rounds; no round has more than ``most`` bytes (or one block)."""
    sized = queries.withColumn("bytes", F.length("ids") + F.length("vecs")).withColumn("no", F.xxhash64("dim", "bucket", "ids"))
    total, largest = sized.agg(F.sum("bytes"), F.max("bytes")).first()
    rounds = max(1, -(-(total or 0) // most))
    while True:
        dealt = sized.withColumn("round", F.pmod("no", F.lit(rounds)).cast("int"))
        if (dealt.groupBy("round").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] or 0) <= max(most, largest or 0):
            return dealt, rounds
        rounds = rounds + rounds // 2 + 1


def _joined(held: list[tuple[int, bytes, bytes]], known: dict[int, float]) -> dict[int, tuple[bytes, bytes, bytes]]:
    """By dimension: ids, vectors and thresholds of a round's queries."""
    out = {}
    for d in {x[0] for x in held}:
        ids, vecs = (b"".join(x[i] for x in held if x[0] == d) for i in (1, 2))
        out[d] = ids, vecs, np.array([known.get(q, -np.inf) for q in np.frombuffer(ids, np.int64).tolist()]).tobytes()
    return out


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
