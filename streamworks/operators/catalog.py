"""Media files and frames: selection, seeking, slices, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import as_of, carry, dealt, parts_for

STREAM_BITS = {"audio": 1, "video": 2}


def select_streams(df: DataFrame, mask: int) -> DataFrame:
    """audio 1, video 2, both 3."""
    return df.filter(F.col("stream_type").isin([k for k, bit in STREAM_BITS.items() if mask & bit]))


def enable_first_stream(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(file_id, stream_type, stream_id, enabled): the first stream of each type, unless (file_id, stream_type, stream_id, enable) says otherwise."""
    streams = df.select("file_id", "stream_type", "stream_id").distinct()
    first = F.row_number().over(Window.partitionBy("file_id", "stream_type").orderBy("stream_id")) == 1
    out = streams.withColumn("enabled", first)
    if overrides is None:
        return out
    keys = ["file_id", "stream_type", "stream_id"]
    return out.join(overrides.select(*keys, "enable"), keys, "left").select(*keys, F.coalesce("enable", "enabled").alias("enabled"))


def seek_as_of(targets: DataFrame, frames: DataFrame, accurate: bool = True) -> DataFrame:
    """For each (file_id, pts) the last frame at or before it; not accurate: the last key frame **[choice]**. No frame: nulls."""
    kept = frames if accurate else frames.filter("key_frame")
    parts = parts_for(targets, frames)
    one = dealt(kept, parts, "file_id", "pts").groupBy("file_id", "pts").agg(F.max(F.struct("frame_idx", "pos")).alias("f")).select("file_id", "pts", F.col("f.frame_idx").alias("frame_idx"), F.col("f.pos").alias("pos"), F.col("pts").alias("at"))
    return as_of(targets, one, ["file_id"], "pts", ["frame_idx", "pos", "at"], parts=parts)


def pick_variant(df: DataFrame, prefer: int) -> DataFrame:
    """Of each stream's (stream, variant, bitrate) the greatest bitrate up to the preferred one, else the least **[choice]**."""
    fits = F.when(F.col("bitrate") <= prefer, F.struct("bitrate", "variant"))
    return df.groupBy("stream").agg(F.max(fits).alias("a"), F.min(F.struct("bitrate", "variant")).alias("b")).select(
        "stream", F.coalesce(F.col("a.variant"), F.col("b.variant")).alias("variant"), F.coalesce(F.col("a.bitrate"), F.col("b.bitrate")).alias("bitrate")
    )


def frame_summary(df: DataFrame) -> DataFrame:
    """Frames, bytes and the last pts (by frame index) of each file's stream types."""
    return df.groupBy("file_id", "stream_type").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.max_by("pts", "frame_idx").alias("last_pts"))


def gop_report(df: DataFrame, frame_type: str | None = None) -> DataFrame:
    """Frames, bytes and the pts range of each group of pictures, or of each type of frame in it; group 0 is what comes before the first key frame."""
    return carry(df, ["file_id"], "frame_idx", {"gop": ("sum", F.col("key_frame").cast("int"))}).groupBy("file_id", "gop", *([frame_type] if frame_type else [])).agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.count_if("key_frame").alias("key_frames")
    )


def rate_per_second(df: DataFrame) -> DataFrame:
    """Frames and bits of each second of a file."""
    return df.groupBy("file_id", F.floor(F.col("pts") / 1000).alias("second")).agg(F.count("*").alias("frames"), (F.sum("size") * 8).alias("bits"))


def resume_points(df: DataFrame) -> DataFrame:
    """The last frame of each stream, and each file's streams in order."""
    last = df.groupBy("file_id", "stream_type", "stream_id").agg(F.max(F.struct("frame_idx", "pts", "pos")).alias("l"))
    point = F.struct("stream_type", "stream_id", F.col("l.frame_idx").alias("frame_idx"), F.col("l.pts").alias("pts"), F.col("l.pos").alias("pos"))
    return last.groupBy("file_id").agg(F.array_sort(F.collect_list(point)).alias("streams"))


def slice_index(df: DataFrame, slice_ms: int, at_key: bool = False) -> DataFrame:
    """Slice number by pts since the file's first; ``at_key``: a slice begins at its first key frame, frames before stay in the slice before **[choice]**."""
    adds = {"_first": ("min", F.col("pts"))}
    if at_key:
        adds["_begun"] = ("last", F.when(F.col("key_frame"), F.col("pts")))
    cut = carry(df, ["file_id"], ["pts", "frame_idx"], adds, parts=parts_for(df))
    # slices rise with pts, so the greatest one begun is that of the last key frame
    slice_idx = F.floor((F.col("_begun" if at_key else "pts") - F.col("_first")) / slice_ms)
    return cut.withColumn("slice_idx", F.coalesce(slice_idx, F.lit(0)).cast("long") if at_key else slice_idx).drop(*adds)


def mux_order(df: DataFrame) -> DataFrame:
    """T4: each file's packets in one timeline by dts, or pts where dts is 0 **[choice]**; ties by stream type, stream and index. ``place`` counts from 0."""
    at = F.when(F.col("dts") == 0, F.col("pts")).otherwise(F.col("dts"))
    placed = carry(df.withColumn("at", at), ["file_id"], ["at", "stream_type", "stream_id", "frame_idx"], {"place": ("count", F.lit(1))})
    return placed.withColumn("place", (F.col("place") - 1).cast("long"))


def tag_facets(df: DataFrame) -> DataFrame:
    """Tracks and distinct albums by author and genre."""
    return df.groupBy("author", "genre").agg(F.count("*").alias("tracks"), F.count_distinct("album").alias("albums"))


def byte_offsets(df: DataFrame, order: str = "name", size: str = "size", ranges: int = 64) -> DataFrame:
    """Where each blob starts when all are laid out in order of name: an exclusive prefix sum without a key.

    Names are cut into ranges by their quantiles. Each range sums its own rows and the ranges' totals (one row for each range) give the
    starts, so no window holds more than one range. Names are unique.
    """
    cuts = _cuts(df, order, ranges)
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_end", F.sum(F.col(size).cast("long")).over(own))
    totals = rows.groupBy("_part").agg(F.sum(F.col(size).cast("long")).alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_end") - F.col(size)).alias("offset"))


def _cuts(df: DataFrame, order: str, ranges: int) -> list:
    """Bounds between ranges from a sample of the names; only balance depends on it, the result doesn't."""
    share = min(1.0, 200 * ranges / max(1, df.count()))
    found = sorted(r[0] for r in df.select(order).sample(share, seed=1).distinct().limit(400 * ranges).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if len(found) > ranges else []
