"""Windows that stay bounded when one key holds most rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 1 << 16


def running_balance(df: DataFrame, keys: list[str], order: str, delta: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``balance`` (running sum of delta) and ``peak`` (its running maximum, 0 at least) in order of an integer column.

    Two levels: rows are summed within buckets of the order column, bucket totals give each bucket's start. No task
    holds more than one bucket of a key or all bucket totals of a key, so one hot key spreads over as many tasks as it has buckets.
    """
    df = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    own = [*keys, "_bucket"]
    within = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_sum", F.sum(delta).over(within)).withColumn("_max", F.max("_sum").over(within))
    totals = local.groupBy(*own).agg(F.sum(delta).alias("_total"), F.max("_sum").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    starts = starts.withColumn("_before", F.max(F.col("_start") + F.col("_top")).over(before))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], "_start", "_before")
    match = None
    for i, k in enumerate(own):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        match = same if match is None else match & same
    joined = local.join(starts, match)
    balance = F.col("_start") + F.col("_sum")
    peak = F.greatest(F.lit(0), F.coalesce("_before", F.lit(0)), F.col("_start") + F.col("_max"))
    return joined.withColumn("balance", balance).withColumn("peak", peak).select(*[c for c in df.columns if c != "_bucket"], "balance", "peak")


#: Rows that a task should sort, where they are counted first.
TASK_ROWS = 1 << 18


def parts_for(*dfs: DataFrame) -> int | None:
    """How many partitions the rows of large tables need, so that a task's memory doesn't grow with them; None if the session's number will do."""
    conf = dfs[0].sparkSession.conf
    needed = -(-sum(df.count() for df in dfs) // TASK_ROWS)
    return needed if needed > int(conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Repartitioned by the keys, if ``parts`` is given (``parts_for``)."""
    return df.repartition(parts, *keys) if parts else df


def carry(df: DataFrame, keys: list[str], order: str | list[str], adds: dict[str, tuple[str, Column]], bucket: int = BUCKET, parts: int | None = None) -> DataFrame:
    """Adds running values in order of ``order`` within the keys, for keys of any number of rows. ``adds``: name -> (kind, column).

    Kinds: "sum" and "count" (up to the row), "max_before" (of the rows before), "last" and "last_before" (the last that isn't null, up to the row or before it),
    "first" (of the key's first row), "min" (of all rows of the key). Rows without an order come first. Rows are windowed within buckets of so many steps of the first order column, a number; what a bucket
    hands on (a total, a maximum, a last value) is aggregated from the rows before they are shuffled, carried over the key's buckets and joined back, so no
    task holds more than a bucket of a key, or one row for each of its buckets. Null keys are a key. ``parts``: how many partitions rows are dealt to, if not the session's number.
    """
    order = [order] if isinstance(order, str) else order
    rows = df.withColumns({"_key": F.struct(*keys), "_bucket": F.coalesce(F.floor(F.col(order[0]) / bucket), F.lit(-(1 << 62))), **{f"_in_{n}": c for n, (_, c) in adds.items()}})
    at = F.struct(*[F.col(c) for c in order])
    within = Window.partitionBy("_key", "_bucket").orderBy(*order)
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside, totals, starts, out = {}, [], {}, {}
    for name, (kind, _) in adds.items():
        c, own, start = F.col(f"_in_{name}"), F.col(f"_own_{name}"), F.col(f"_start_{name}")
        last = F.max_by(c, F.when(c.isNotNull(), at))
        inside[f"_own_{name}"], total, carried, out[name] = {
            "sum": (F.sum(c).over(upto), F.sum(c), F.sum, F.coalesce(start + own, own, start)),
            "count": (F.count("*").over(upto), F.count("*"), F.sum, F.coalesce(start, F.lit(0)) + own),
            "max_before": (F.max(c).over(before), F.max(c), F.max, F.greatest(start, own)),
            "last": (F.last(c, ignorenulls=True).over(upto), last, lambda x: F.last(x, ignorenulls=True), F.coalesce(own, start)),
            "last_before": (F.last(c, ignorenulls=True).over(before), last, lambda x: F.last(x, ignorenulls=True), F.coalesce(own, start)),
            "min": (F.min(c).over(Window.partitionBy("_key", "_bucket")), F.min(c), F.min, F.least(start, own)),
            "first": (F.first(F.struct(c.alias("v"))).over(upto), F.min_by(F.struct(c.alias("v")), at), F.first, F.coalesce(start, own)["v"]),
        }[kind]
        totals.append(total.alias(f"_start_{name}"))
        starts[f"_start_{name}"] = carried(F.col(f"_start_{name}")).over(Window.partitionBy("_key") if kind == "min" else earlier)
    told = dealt(dealt(rows, parts, "_key", "_bucket").groupBy("_key", "_bucket").agg(*totals), parts, "_key")
    told = told.withColumns({**starts, "_first": F.min("_bucket").over(Window.partitionBy("_key")), "_last": F.max("_bucket").over(Window.partitionBy("_key"))})
    told = told.filter("_first < _last").drop("_first", "_last")
    # keys that have one bucket only, mostly all of them, take nothing over; rows go without a second copy of their keys
    kept = {c: F.col("_key")[c] if c in keys else F.col(c) for c in df.columns if c not in adds}
    found = dealt(rows.drop(*keys), parts, "_key", "_bucket").withColumns(inside).join(told, ["_key", "_bucket"], "left").withColumns(out)
    return found.select(*[c.alias(name) for name, c in kept.items()], *adds)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, take: list[str], bucket: int = BUCKET, parts: int | None = None) -> DataFrame:
    """For each left row the last right row of its keys at or before it (nulls without one), by one sort and no join of the two sides (``carry``)."""
    state = F.struct(F.lit(True).alias("hit"), *take)
    both = left.withColumn("_side", F.lit(1)).withColumn("_state", F.lit(None).cast("struct<hit:boolean," + ",".join(f"{c}:{right.schema[c].dataType.simpleString()}" for c in take) + ">"))
    other = right.select(*keys, order, F.lit(0).alias("_side"), state.alias("_state"))
    found = carry(both.unionByName(other, allowMissingColumns=True), keys, [order, "_side"], {"_found": ("last", F.col("_state"))}, bucket, parts).filter("_side = 1")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(f"found_{c}") for c in take])


#: Arrow's types of the columns that scans add.
KINDS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each run of equal keys."""
    own, at = zip(*(batch.column(k).to_pylist() for k in keys), strict=True), 0
    for key, rows in groupby(own):
        n = sum(1 for _ in rows)
        yield key, batch.slice(at, n)
        at += n


def ordered_scan(df: DataFrame, keys: list[str], order: str, added: str, begin: Callable[[], object], step: Callable[[object, pa.RecordBatch], list]) -> DataFrame:
    """Adds (or, by the same name, replaces) columns by a scan of each key's rows in order, with a state that is carried from batch to batch.

    For what depends on all rows before, step by step. ``step`` gets the state, which it changes, and the next rows of its key, and returns
    an array for each column of the DDL ``added``. Keys are dealt to tasks and sorted there, so a task holds one batch and one state, whatever a key's length.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(added)
    kinds = [KINDS[f.dataType.simpleString()] for f in new]
    schema = T.StructType([*[f for f in df.schema if f.name not in new.names], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for key, part in runs(batch, keys):
                if state is None or key != last:
                    last, state = key, begin()
                found = [pa.array(x, kind) for x, kind in zip(step(state, part), kinds, strict=True)]
                cols = dict(zip(part.schema.names, part.columns, strict=True)) | dict(zip(new.names, found, strict=True))
                yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
