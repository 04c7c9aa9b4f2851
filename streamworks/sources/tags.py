"""Tags at the head of audio files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import TAG

#: Frame names of the named columns.
NAMED = {
    "title": ("TIT2", "TT2"), "author": ("TPE1", "TP1"), "album": ("TALB", "TAL"), "date": ("TDRC", "TYER", "TYE"), "genre": ("TCON", "TCO"),
}
CODECS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
COLUMN = {frame: col for col, frames in NAMED.items() for frame in frames}
HEAD = 10


def big(b: bytes) -> int:
    return int.from_bytes(b, "big")


def syncsafe(b: bytes) -> int:
    out = 0
    for x in b:
        out = out << 7 | x & 127
    return out


def clean(raw: bytes, codec: str = "latin-1") -> str | None:
    """Text without NULs and spaces at its ends and NULs inside; None if nothing is left."""
    text = raw.decode(codec, "replace").strip("\0 ").replace("\0", "")
    return text or None


def parse_tag(data: bytes) -> dict | None:
    """The tag of a file's head; None where there is none, it is cut off or its version is unknown."""
    if data[:3] == b"TAG" and len(data) >= 128:
        fields = {k: clean(data[a:b]) for k, a, b in (("title", 3, 33), ("author", 33, 63), ("album", 63, 93), ("date", 93, 97))}
        return {"version": "1", **fields, "genre": str(data[127]), "encoding": 0, "extra": []}
    if data[:3] != b"ID3" or len(data) < HEAD or data[3] not in (2, 3, 4):
        return None
    version, at, end = data[3], HEAD, HEAD + syncsafe(data[6:10])
    number = syncsafe if version == 4 else big
    if data[5] & 0x40 and end - at >= 4:
        size = number(data[at : at + 4])
        if version == 4 and not 4 <= size <= end - at or version != 4 and size > end - at - 4:
            return None
        at += size if version == 4 else size + 4
    out: dict = {"version": f"2.{version}", "extra": []}
    name_size, head = (3, 6) if version == 2 else (4, HEAD)
    while end - at >= head:
        frame = data[at : at + head]
        if len(frame) < head:
            return None
        at += head
        size = big(frame[3:6]) if version == 2 else number(frame[4:8])
        if frame[0] == 0 or size == 0 or size > end - at:
            break
        body, name = data[at : at + size], frame[:name_size].decode("latin-1")
        if len(body) < size:
            return None
        at += size
        if name[0] == "T":
            value = clean(body[1:], CODECS.get(body[0], "latin-1"))
            if value is None:
                continue
            out["encoding"] = body[0]
            if name in COLUMN:
                out[COLUMN[name]] = value
            else:
                out["extra"].append({"key": name, "value": value, "encoding": body[0]})
        elif name in ("PIC", "APIC") and size >= 5:
            mime_end = body.find(b"\0", 1)
            text_end = body.find(b"\0", mime_end + 2) if mime_end >= 0 else -1
            if text_end >= 0:
                out["cover_mime"], out["cover_size"] = clean(body[1:mime_end]), size - text_end - 1
    return out


EXTRA = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("encoding", pa.int32())]))
ARROW = pa.schema([
    *((c, pa.string()) for c in ("path", "version", "title", "author", "album", "date", "genre", "cover_mime")),
    ("cover_size", pa.int64()), ("encoding", pa.int32()), ("extra", EXTRA),
])


def decode_tags(files: DataFrame) -> DataFrame:
    """(path, content) to a row for each file that has a readable tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": r["path"], **t} for r in batch.to_pylist() if (t := parse_tag(bytes(r["content"])))]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "content").mapInArrow(run, TAG)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """The tags of all files below a path."""
    return decode_tags(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
