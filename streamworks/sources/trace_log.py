"""Binary allocation logs: '+' and '-' records to trace events."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, seq long, act string, flag int, addr long, size long, stack array<long>, truncated_at long"


def decode_log(data: bytes) -> Iterator[tuple]:
    """(seq, act, flag, addr, size, stack, truncated_at). An unknown act byte or a cut record ends the log with a row that tells its place."""
    at, seq = 0, 0
    while at < len(data):
        act = data[at : at + 1]
        if act == b"+" and at + 12 <= len(data) and at + 12 + 4 * data[at + 1] <= len(data):
            depth, flag, _, addr, size = struct.unpack_from("<BBBII", data, at + 1)
            yield seq, "+", flag, addr, size, list(struct.unpack_from(f"<{depth}I", data, at + 12)), None
            at += 12 + 4 * depth
        elif act == b"-" and at + 6 <= len(data):
            yield seq, "-", None, struct.unpack_from("<BI", data, at + 1)[1], None, None, None
            at += 6
        else:
            yield seq, None, None, None, None, None, at
            return
        seq += 1


def decode_trace_logs(files: DataFrame) -> DataFrame:
    """(path, content) to trace events; a file is decoded by one task, as its records have no marks to start from."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = [(path, *r) for r in decode_log(bytes(content))]
                for i in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[i : i + 50_000], columns=["path", "seq", "act", "flag", "addr", "size", "stack", "truncated_at"]).astype(
                        {"flag": "Int32", "addr": "Int64", "size": "Int64", "truncated_at": "Int64"}
                    )

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_trace_log(spark: SparkSession, path: str) -> DataFrame:
    """Trace events of all logs below a path."""
    return decode_trace_logs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def encode_trace_logs(events: DataFrame, key: str = "device_id") -> DataFrame:
    """The other way: (path, content) by key, with DataFrame functions only."""
    little = lambda c, n: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    plus = F.concat(
        F.lit("2B"), little(F.size("stack"), 1), little(F.col("flag"), 1), F.lit("00"), little(F.col("addr"), 4), little(F.col("size"), 4),
        F.array_join(F.transform("stack", lambda a: little(a, 4)), ""),
    )
    minus = F.concat(F.lit("2D00"), little(F.col("addr"), 4))
    text = F.when(F.col("act") == "+", plus).otherwise(minus)
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("r"))
    return listed.select(F.concat(F.lit("log_"), F.col(key).cast("string")).alias("path"), F.unhex(F.array_join(F.transform("r", lambda r: r["t"]), "")).alias("content"))
