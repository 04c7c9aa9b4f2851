"""Reports, inventories, packets, slices and matrices as files; user-supplied readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import container_type, extension
from ..operators.catalog import slice_index
from ..operators.packets import decode_rtp_header
from ..operators.windows import runs

#: One block of a metric report; what stands between the parts is skipped lazily, over lines.
BLOCK = r"(?s)====[^\n(]*\((\d+) -> (\d+), bits: (\d+)\)\s*====.*?thd_db:\s*(-?[\d.]+).*?snr_db:\s*(-?[\d.]+).*?magnitude_response_diff:\s*(-?[\d.]+)"


def parse_metric_report(text: Column) -> Column:
    """array<struct<src_rate, dst_rate, bits, thd, snr, mag_diff>> of a report's text."""
    names = ("src_rate", "dst_rate", "bits", "thd", "snr", "mag_diff")
    parts = [F.regexp_extract_all(text, F.lit(BLOCK), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    kinds = ("int", "int", "int", "double", "double", "double")
    return F.transform(F.arrays_zip(*parts), lambda z: F.struct(*[z[n].try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]))


def read_metric_report(spark: SparkSession, path: str) -> DataFrame:
    """A row for each block of the reports below a path."""
    return spark.read.text(path, wholetext=True).select(F.explode(parse_metric_report(F.col("value"))).alias("m")).select("m.*")


def read_media_catalog(spark: SparkSession, path: str, exts: list[str] | None = None) -> DataFrame:
    """S3: (path, length, modificationTime, ext, container) of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    found = files.withColumn("ext", extension(F.col("path"))).withColumn("container", container_type(F.col("path")))
    return found.filter(F.col("ext").isin([e.lower().lstrip(".") for e in exts])) if exts else found


def write_slices(df: DataFrame, path: str, slice_ms: int) -> None:
    """Media frames as one folder for each file and time slice, slice_0 first."""
    cut = slice_index(df, slice_ms).withColumn("slice", F.concat(F.lit("slice_"), "slice_idx"))
    cut.repartition("file_id", "slice").sortWithinPartitions("file_id", "slice", "pts").write.mode("errorifexists").partitionBy("file_id", "slice").parquet(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """One folder of CSV for each (bits, metric), two decimals, empty for missing."""
    cols = [F.format_string("%.2f", F.col(f"`{c}`").cast("double")).alias(c) if c not in ("bits", "metric", "src_rate") else F.col(c) for c in matrix.columns]
    shown = matrix.select(*[F.when(F.col(f"`{c}`").isNull(), "").otherwise(x).alias(c) if c not in ("bits", "metric", "src_rate") else x for c, x in zip(matrix.columns, cols, strict=True)])
    shown.repartition("bits", "metric").sortWithinPartitions("src_rate").write.mode("errorifexists").partitionBy("bits", "metric").option("header", "true").option("emptyValue", "").csv(path)


def read_packets(spark: SparkSession, path: str, payload: str | None = None) -> DataFrame:
    """Captured packets; with ``payload`` their headers are decoded from that binary column."""
    df = spark.read.parquet(path)
    return decode_rtp_header(df, payload) if payload else df


Parser = Callable[[bytes], tuple[int, int, dict]]
#: Bytes that a parser is shown at first; more where it asks for more.
SHOWN = 4096


class Frames:
    """The bytes of one key that aren't parsed yet, and their place in its stream."""

    def __init__(self):
        self.rest, self.at = b"", 0

    def feed(self, data: bytes, fn: Parser) -> Iterator[tuple[int, int, dict]]:
        """(pos, size, info) of the frames that are whole by now. A parser sees ``SHOWN`` bytes, doubled as often as it asks for more, so each byte is copied a few times."""
        whole, done, shown = self.rest + data if self.rest else data, 0, SHOWN
        while done < len(whole):
            seen = whole[done : done + shown]
            skipped, size, info = fn(seen)
            if size <= 0 or skipped + size > len(seen):
                if done + shown >= len(whole):
                    break
                shown *= 2
                continue
            yield self.at + done + skipped, size, info
            done, shown = done + skipped + size, SHOWN
        self.rest, self.at = whole[done:], self.at + done


def with_frame_parser(df: DataFrame, fn: Parser, schema: str, key: str = "path", order: str = "idx", data: str = "data") -> DataFrame:
    """(key, order, data) chunks through a user's parser, which gets the bytes at hand and says (skipped, frame_size, info).

    A frame_size of 0 asks for more data: the rest waits for the next chunk of its key. Chunks of a key meet in one task, in order, a batch of them at a
    time; what waits is the part of a frame that hasn't ended. Null chunks hold nothing.
    """
    found = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(f"pos long, size long, {schema}")])
    arrow = to_arrow_schema(found)
    names = found.names[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, frames = None, None
        for batch in batches:
            rows = []
            for own, part in runs(batch, [key]):
                if frames is None or own != last:
                    last, frames = own, Frames()
                for chunk in part.column(data):
                    rows += [(own[0], pos, size, *map(info.get, names)) for pos, size, info in frames.feed(chunk.as_py() or b"", fn)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.types[i]) for i in range(len(arrow))], arrow.names)

    dealt = df.select(key, order, data).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, found)
