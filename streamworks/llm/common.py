"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there.

    A lost executor costs no more than reading the files again.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows that one task reads back at most of a small result.
GATHERED = 100_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, which are observed as they are written: no job of its own counts them."""
    seen = Observation()
    return cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen.get["rows"]


def gathered(df: DataFrame, rows: int = GATHERED) -> tuple[DataFrame, int]:
    """``counted``, read back in one task for so many rows."""
    kept, n = counted(df)
    return kept.coalesce(max(1, -(-n // rows))), n


def cut_and_gather(df: DataFrame, rows: int = GATHERED) -> DataFrame:
    """``gathered``: what follows a small result then shuffles few files, and a large one stays spread."""
    return gathered(df, rows)[0]


def small(df: DataFrame, n: int) -> DataFrame:
    """A gathered result of ``n`` rows as the side of a join: broadcast if it is one task's, so that the other side isn't shuffled."""
    return F.broadcast(df) if n <= GATHERED else df


def tree_sum(parts: DataFrame, partitions: int | None = None, fan_in: int = 16) -> np.ndarray | None:
    """Adds rows of doubles (``sums binary``) in a tree of shuffles; one row reaches the driver, None if there is no row.

    Each level deals its rows anew, so what lies below keeps all its tasks. ``partitions`` tells their number where the caller knows it.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("sums"):
                x = np.frombuffer(raw.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    n = partitions or parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "sums binary")
    got = parts.collect()
    return np.frombuffer(got[0]["sums"]) if got else None


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns came along."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_field(schema: T.StructType, name: str, ddl: str) -> T.StructType:
    """A new schema with one more field."""
    return T.StructType([*schema.fields, T.StructField(name, T.DataType.fromDDL(ddl))])


#: Texts that Python holds at once, in characters; longer single texts come alone.
BATCH_CHARS = 8_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most`` bytes of ``text``, or one row."""
    for batch in batches:
        start, held = 0, 0
        sizes = [len(x) if x is not None else 0 for x in _views(batch.column(batch.schema.get_field_index(text)))]
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _views(column: pa.Array):
    offsets = column.offsets if hasattr(column, "offsets") else None
    if offsets is None:
        return (x.as_py() for x in column)
    ends = offsets.to_numpy()
    return (range(n) for n in (ends[1:] - ends[:-1]).tolist())
