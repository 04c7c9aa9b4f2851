"""Columns over text: paths, playlists, sample names, tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_playlist_url(url: Column) -> Column:
    """the first ".m3u8" or ".M3U8" after the last slash isn't followed by a word character."""
    name = F.substring_index(url, "/", -1)
    at = F.regexp_instr(name, F.lit(r"\.m3u8|\.M3U8"))
    return F.coalesce((at > 0) & ~F.substr(name, at + 5, F.lit(1)).rlike(r"^\w"), F.lit(False))


def normalize_path(path: Column, root: str | None = None) -> Column:
    """F8: drops "." parts, lets ".." take its parent away, keeps what follows ``root`` and puts it below root/."""
    step = lambda acc, p: (
        F.when(p.isin(".", ""), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    )
    out = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    if root is None:
        return out
    tail = F.regexp_extract(out, rf"(?:^|/){re.escape(root)}/(.*)$", 1)
    return F.concat(F.lit("root/"), F.when(tail != "", tail).otherwise(out))


def is_wrapper_file(path: Column, patterns: list[str]) -> Column:
    """whether the path holds any of the patterns ("*" stands for any text)."""
    if not patterns:
        return F.lit(False)
    each = [".*?".join(re.escape(p) for p in w.split("*")) for w in patterns]
    return F.coalesce(path.rlike("|".join(each)), F.lit(False))


def parse_sample_name(name: Column) -> Column:
    """struct(idx, note, vel_min, vel_max) of idx_note_..._min_max.wav; null for a bad name."""
    parts = F.split(F.regexp_replace(name, r"\.wav$", ""), "_")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    found = F.struct(number(1).alias("idx"), number(2).alias("note"), number(-2).alias("vel_min"), number(-1).alias("vel_max"))
    ok = name.endswith(".wav") & (F.size(parts) >= 4) & number(1).isNotNull() & number(2).isNotNull() & number(-2).isNotNull() & number(-1).isNotNull()
    return F.when(ok, found)


def bad_names(names: DataFrame, name_col: str) -> DataFrame:
    """how many names don't parse."""
    return names.agg(F.count_if(parse_sample_name(F.col(name_col)).isNull()).alias("bad"))


def trim_nul(text: Column) -> Column:
    """NULs and spaces go at both ends, inner NULs go too."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00 ]+|[\x00 ]+$", ""), r"\x00", "")


#: Container types by file extension.
CONTAINERS = {
    "mp4": "mp4", "m4a": "mp4", "mov": "mp4", "3gp": "mp4", "ts": "ts", "flv": "flv", "avi": "avi", "ogg": "ogg", "opus": "ogg",
    "caf": "caf", "wav": "wav", "mp3": "audio_es", "aac": "audio_es", "flac": "audio_es", "amr": "audio_es",
}


def extension(path: Column) -> Column:
    """The lower-cased extension without its dot; null without one."""
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found != "", found)


def container_type(path: Column) -> Column:
    """S3: the container by extension; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in CONTAINERS.items() for x in pair])
    return F.try_element_at(known, F.coalesce(extension(path), F.lit("")))
