"""User-supplied containers as data sources, read by ``spark.read.format(name)`` and ``spark.readStream.format(name)``.

A container says which columns its records have, how to find the first record at or after a place of a file, and how to read the records that begin in a
range. Registering it makes a data source: files are listed on the driver by name and size only, cut into ranges of ``splitBytes``, and each range is read by a
task, so one long file is read by many. A container that has no marks to start from (``splittable = False``) is read whole file by whole file.

Options: ``path`` (a folder, a file or a pattern), ``splitBytes`` (64 MB), ``recursive`` (true). The files must lie where all machines reach them by name.
A file's last record may be cut: it is ``records``' part to leave it out or to say so.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20


class Container:
    """What a user supplies."""

    #: The format's name and the DDL of its records.
    name, schema = "", ""
    splittable = True
    #: Files to read, by the end of their names; all if empty.
    suffixes: tuple[str, ...] = ()

    def sync(self, file: BinaryIO, at: int) -> int:
        """The place of the first record that begins at or after ``at``, which isn't 0."""
        raise NotImplementedError

    def records(self, file: BinaryIO, path: str, at: int, end: int) -> Iterator[tuple]:
        """The records that begin in [at, end), as rows of the schema; ``at`` is a record's beginning."""
        raise NotImplementedError


class Range(InputPartition):
    """Bytes of a file."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def local_path(path: str) -> str:
    """The name of a file in the machines' own tree; other stores are read by Spark's own formats."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"a container is read from files that machines reach by name, not from {url.scheme}:")
    return unquote(url.path) if url.scheme else path


def listed(path: str, suffixes: tuple[str, ...], recursive: bool) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files below a folder, of a file or of a pattern; hidden ones and Spark's own marks are left out."""
    place, found = local_path(path), []
    if os.path.isdir(place):
        for folder, folders, names in os.walk(place):
            folders[:] = sorted(d for d in folders if recursive and d[0] not in "._")
            found += [os.path.join(folder, n) for n in names]
    else:
        found = glob.glob(place)
        if not found and not glob.has_magic(place):
            raise FileNotFoundError(path)
    kept = [f for f in sorted(found) if os.path.basename(f)[0] not in "._" and (not suffixes or f.endswith(suffixes)) and os.path.isfile(f)]
    return [(f, s.st_size, s.st_mtime_ns) for f in kept for s in [os.stat(f)]]


def cut(container: Container, files: list[tuple[str, int, int]], split: int) -> list[Range]:
    """Ranges of the files; a container that can't start anywhere gets whole files. Empty files have none."""
    out = []
    for path, size, _ in files:
        step = split if container.splittable else max(size, 1)
        out += [Range(path, at, min(at + step, size)) for at in range(0, size, step)]
    return out


def read_range(container: Container, part: Range) -> Iterator[tuple]:
    with open(part.path, "rb") as file:
        at = part.start if part.start == 0 else container.sync(file, part.start)
        if at < part.end:
            yield from container.records(file, part.path, at, part.end)


class ContainerReader(DataSourceReader):
    def __init__(self, container: Container, options: dict):
        self.container, self.options = container, options

    def partitions(self) -> list[Range]:
        recursive = self.options.get("recursive", "true").lower() == "true"
        files = listed(self.options["path"], self.container.suffixes, recursive)
        return cut(self.container, files, int(self.options.get("splitBytes", SPLIT_BYTES))) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(self.container, partition) if partition.path else iter(())


class ContainerStream(DataSourceStreamReader):
    """New files as they appear, each once: an offset is the last file by (time of change, name), so files are moved in whole and get a later time."""

    def __init__(self, container: Container, options: dict):
        self.container, self.options = container, options

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _files(self) -> list[tuple[str, int, int]]:
        recursive = self.options.get("recursive", "true").lower() == "true"
        return sorted(listed(self.options["path"], self.container.suffixes, recursive), key=lambda f: (f[2], f[0]))

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        files = [f for f in self._files() if low < (f[2], f[0]) <= high]
        return cut(self.container, files, int(self.options.get("splitBytes", SPLIT_BYTES))) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(self.container, partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


def register_container(spark: SparkSession, container: Container) -> None:
    """Makes ``container`` a format of this session; a later one of the same name takes its place."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return container.name

        def schema(self) -> str:
            return container.schema

        def reader(self, schema) -> ContainerReader:
            return ContainerReader(container, dict(self.options))

        def streamReader(self, schema) -> ContainerStream:
            return ContainerStream(container, dict(self.options))

    if not container.name or not container.schema:
        raise ValueError("a container has a name and a schema")
    spark.dataSource.register(Source)


class LineFrames(Container):
    """A text container: a line for each media frame, ``file_id;frame_idx;pts;size;key``. Lines that don't hold five fields of these kinds are bad frames."""

    name, schema = "line_frames", "path string, pos long, file_id string, frame_idx long, pts long, size long, key_frame boolean, bad boolean"

    def sync(self, file: BinaryIO, at: int) -> int:
        file.seek(at - 1)  # a line that begins right here has its end before it
        return at - 1 + len(file.readline())

    def records(self, file: BinaryIO, path: str, at: int, end: int) -> Iterator[tuple]:
        file.seek(at)
        while at < end and (line := file.readline()):
            name = os.path.basename(path)
            try:
                own, idx, pts, size, key = line.decode().rstrip("\r\n").split(";")
                yield name, at, own, int(idx), int(pts), int(size), {"0": False, "1": True}[key], False
            except (ValueError, KeyError):
                yield name, at, None, None, None, None, None, True
            at += len(line)


class TraceRecords(Container):
    """Binary allocation logs as a container: records have no marks to start from, so a file is one range. A cut or unknown record ends its file."""

    name, schema = "trace_records", "path string, seq long, act string, flag int, addr long, size long, stack array<long>, truncated_at long"
    splittable = False

    def records(self, file: BinaryIO, path: str, at: int, end: int) -> Iterator[tuple]:
        from .trace_log import decode_log

        file.seek(at)
        for record in decode_log(file.read(end - at)):
            yield os.path.basename(path), *record
