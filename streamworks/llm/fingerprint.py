"""Document fingerprints from content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes: each step shifts the hash by one bit and adds a table value, so that a
32-bit hash depends on the last 32 bytes only, and numpy computes it for a whole batch by doubling (hashes of 1, 2, 4, ...
bytes). A chunk ends where masked bits of the hash are zero, after ``least`` bytes at the soonest and ``most`` at the
latest; the mask has two more bits before the normal length than after it, which draws lengths towards the normal one. Boundaries
depend on near bytes only, so an insertion shifts chunks without changing those behind it.

A fingerprint is the set of (64-bit digest, length) of a text's chunks. ``containment`` of a in b is the length of
a's distinct chunks that b has too, over the length of all of a's distinct chunks.

Neighbours in order of id come from one range partitioning of the texts: bounds are taken from the ids' quantiles, each
range is sorted, and each range also gets the first row of the next one (the last range: the first row of all).
There are three ranges for each shuffle partition, whatever that number is. No task holds more than a batch, and no row but those first ones is copied. Rows
of one id are one range, read one after the other.

Defined results: null text is empty; an empty text has an empty fingerprint, contained wholly in any other
empty one (1.0) and not at all (0.0) in another; equal ids follow each other in order of their text; null ids come first;
repeated rows are neighbours of each other; a single row is its own next; an empty table gives an empty result. Extra columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, with_field

LEAST, NORMAL, MOST = 16, 32, 128  # bytes
#: A random value for each byte, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20240101)).integers(0, 1 << 32, 256, np.uint32)
LOOSE, STRICT = np.uint32(0xF << 28), np.uint32(0x3F << 26)  # the highest bits depend on the most bytes


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash that ends at each byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """The ends of a text's chunks; the last is the text's length."""
    n = len(data)
    if not n:
        return []
    h = gear_hashes(data)
    at = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[at] & STRICT) == 0).tolist()
    ends, start = [], 0
    for p, s in zip((at + 1).tolist(), strict, strict=True):
        while p - start > MOST:
            start += MOST
            ends.append(start)
        size = p - start
        if size >= LEAST and (s or size >= NORMAL):
            ends.append(p)
            start = p
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_digests(text: str) -> dict[int, int]:
    """Length by digest of the text's distinct chunks."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = boundaries(np.frombuffer(raw, np.uint8))
    digest, start, out = xxhash.xxh3_64_intdigest, 0, {}
    for end in ends:
        out[digest(raw[start:end])] = end - start
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def packed(chunks: dict[int, int]) -> str:
    """The set as text: base 64 of all digests, in order, then of all lengths."""
    digests = np.sort(np.fromiter(chunks, np.uint64, len(chunks)))
    lengths = np.fromiter((chunks[d] for d in digests.tolist()), np.uint8, len(chunks))
    return base64.b64encode(digests.astype("<u8").tobytes() + lengths.tobytes()).decode()


def unpacked(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 9
    return dict(zip(np.frombuffer(raw[: 8 * n], "<u8").tolist(), raw[8 * n :], strict=True))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "chunks") -> DataFrame:
    """``docs`` with the set of (digest, length) of each text."""
    text, out = free_name(docs, "cdc_text"), free_name(docs, out)
    names = [*docs.columns, out]
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            sets = [
                [{"digest": d - (1 << 64) if d >> 63 else d, "length": n} for d, n in sorted(chunk_digests(t).items())]
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(sets, kind)], names)

    kept = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    return kept.mapInArrow(run, with_field(docs.schema, out, "array<struct<digest:bigint,length:int>>"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _longs(values: list[int | None]) -> Column:
    """A constant array; as text it stays small in the plan, and Spark folds it once."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def in_ranges(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """(range, id, text), and in each range the first row of the next one under ahead = true."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = docs.select(F.col(id_col).cast("long").alias("id")).agg(
        F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("cuts") if ranges > 1 else F.array().cast("array<long>").alias("cuts")
    ).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # how many cuts are below the id: a search in every n-th of them, then in the n behind
    n = max(1, math.isqrt(len(cuts)))
    coarse = F.size(F.filter(_longs(cuts[n - 1 :: n]), lambda c: c < F.col("id")))
    fine = F.size(F.filter(F.slice(_longs(cuts), coarse * n + 1, n), lambda c: c < F.col("id")))
    number = F.when(F.col("id").isNull(), F.lit(0)).otherwise(coarse * n + fine) if cuts else F.lit(0)
    numbered = rows.withColumn("range", number)
    firsts = numbered.select("range", "id").groupBy("range").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("nulls")).collect()
    firsts = sorted((r["range"], None if r["nulls"] else r["id"]) for r in firsts)  # a row for each range
    # by range: its first id, and the range that looks ahead to it
    first_id, before = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for i, (r, first) in enumerate(firsts):
        first_id[r], before[r] = first, firsts[i - 1][0]
    is_first = F.col("id").eqNullSafe(F.get(_longs(first_id), F.col("range")))
    target = F.when(is_first, F.get(_longs(before), F.col("range")).cast("int"))
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")), F.struct(target.alias("range"), F.lit(True).alias("ahead")))
    return numbered.withColumn("p", F.explode(F.filter(places, lambda p: p["range"].isNotNull()))).select("p.range", "p.ahead", "id", "text")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each text."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 3 * tasks  # several for each task, so that hashing deals them evenly
    placed = in_ranges(docs, id_col, text_col, ranges)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (range, id, text, fingerprint), waiting for its next

        def row(own: tuple, following: str, next_print: dict[int, int]) -> tuple:
            _, doc, text, chunks = own
            new = edited(text, following)
            new_chunks = chunks if new == text else chunk_digests(new)
            own_packed = packed(chunks)
            return (
                doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own_packed,
                own_packed if new == text else packed(new_chunks), containment(chunks, new_chunks), containment(chunks, next_print),
            )

        for batch in slices(batches, "text"):
            out = []
            for r, ahead, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and (last is None or last[0] != r):
                    continue  # a tie of the first row ahead
                chunks = chunk_digests(text)
                if last is not None:
                    out.append(row(last, text, chunks))
                last = None if ahead else (r, doc, text, chunks)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names)

    dealt = placed.repartition(tasks, "range").sortWithinPartitions("range", "ahead", F.asc_nulls_first("id"), "text")
    found = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
