"""Containers as data sources: every record once whatever the ranges, whole files, streams of new files, refusals; the frame parser on large chunks."""

import random
import struct
import time

import pytest

from streamworks.sources import containers as C
from streamworks.sources import files


class Short(C.LineFrames):
    name, suffixes = "short_lines", (".lines",)


@pytest.fixture
def lines(tmp_path):
    rng, rows = random.Random(2), []
    for n in (0, 1, 40):
        text = [f"f{n};{i};{i * 10};{rng.randrange(10 ** rng.randrange(1, 7))};{i % 2}" for i in range(n)]
        (tmp_path / f"{n}.lines").write_text("\n".join(text) + ("\n" if n == 1 else ""))
        rows += text
    (tmp_path / "_hidden.lines").write_text("x\n")
    (tmp_path / "other.txt").write_text("x\n")
    return tmp_path, sorted(rows)


def told(df):
    return sorted(f"{r.file_id};{r.frame_idx};{r.pts};{r['size']};{int(r.key_frame)}" for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 16, 100, 1 << 20])
def test_every_record_once(spark, lines, split):
    place, rows = lines
    C.register_container(spark, Short())
    read = spark.read.format("short_lines").option("splitBytes", split)
    got = read.load(str(place))
    assert told(got) == rows and not any(r.bad for r in got.collect())
    assert told(read.load(f"file://{place}/40.lines")) == [r for r in rows if r.startswith("f40")]
    assert told(read.load(f"{place}/4*.lines")) == [r for r in rows if r.startswith("f40")]
    assert len({(r.path, r.pos) for r in got.collect()}) == len(rows)


def test_one_file_is_read_by_many_tasks(lines):
    place, _ = lines
    parts = C.cut(Short(), C.listed(str(place), (".lines",), True), 50)
    assert len(parts) > 8 and sum(p.end - p.start for p in parts) == sum(f.stat().st_size for f in place.glob("[0-9]*.lines"))


def test_bad_lines_empty_folders_and_refusals(spark, tmp_path):
    C.register_container(spark, Short())
    read = spark.read.format("short_lines")
    assert read.load(str(tmp_path)).collect() == []
    (tmp_path / "a.lines").write_bytes(b"f;1;2;3;1\nf;x;2;3;1\n\xff\xfe\nf;1;2;3\n")
    got = read.load(str(tmp_path)).collect()
    assert [r.bad for r in sorted(got, key=lambda r: r.pos)] == [False, True, True, True]
    with pytest.raises(Exception, match="by name"):
        read.load("s3://bucket/x").collect()
    with pytest.raises(ValueError, match="name and a schema"):
        C.register_container(spark, C.Container())


def test_whole_files_without_marks(spark, tmp_path):
    log = struct.pack("<cBBBII2I", b"+", 2, 1, 0, 100, 64, 7, 8) + struct.pack("<cBI", b"-", 0, 100)
    (tmp_path / "a.bin").write_bytes(log * 3)
    (tmp_path / "b.bin").write_bytes(log + b"?")
    C.register_container(spark, C.TraceRecords())
    got = spark.read.format("trace_records").option("splitBytes", 5).load(str(tmp_path)).collect()
    assert [(r.act, r.truncated_at) for r in sorted(got, key=lambda r: (r.path, r.seq))] == [("+", None), ("-", None)] * 3 + [("+", None), ("-", None), (None, 26)]


def test_stream_reads_each_new_file_once(spark, tmp_path):
    C.register_container(spark, Short())
    place, out = tmp_path / "in", tmp_path / "out"
    place.mkdir()
    for n in range(3):
        (place / f"{n}.lines").write_text(f"f;{n};0;1;1\nf;{n};1;1;0\n")
        time.sleep(0.02)
        stream = spark.readStream.format("short_lines").option("splitBytes", 12).load(str(place))
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(str(out)).count() == 2 * (n + 1)


def test_frame_parser_on_a_large_chunk(spark):
    """40,000 frames in one chunk, one of them longer than what a parser sees at first; and frames cut by chunks at every place."""
    sizes = [10] * 40_000
    sizes[5] = 30_000
    data = b"".join(struct.pack("<I", n) + b"x" * (n - 4) for n in sizes)

    def parse(seen):
        return 0, struct.unpack("<I", seen[:4])[0] if len(seen) >= 4 else 0, {"first": len(seen[:1])}

    df = spark.createDataFrame([("a", 0, data), ("b", 0, None), ("b", 1, data[:9]), ("b", 2, data[9:21]), ("b", 3, data[21:25])], "path string, idx int, data binary")
    began = time.time()
    got = files.with_frame_parser(df, parse, "first int").collect()
    assert time.time() - began < 30
    own = sorted((r.pos, r["size"]) for r in got if r.path == "a")
    assert [n for _, n in own] == sizes and own[-1][0] + 10 == len(data)
    assert [(r.pos, r["size"]) for r in got if r.path == "b"] == [(0, 10), (10, 10)]
