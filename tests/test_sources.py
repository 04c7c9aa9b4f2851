"""Readers and writers on real files."""

import pytest
from pyspark.sql import functions as F

from streamworks.operators import quality as V
from streamworks.schemas import MEDIA_FRAME, TRACE_EVENT
from streamworks.sources import files, tags, trace_log
from streamworks.streaming import streams


def test_trace_log_files(spark, tmp_path):
    rows = [(1, 0, "+", 1, 0x3C0B636C, 1024, [1, 2, 3], "m"), (1, 1, "-", 0, 0x3C0B636C, None, None, None)]
    content = trace_log.encode_trace_logs(spark.createDataFrame(rows, TRACE_EVENT)).first().content
    (tmp_path / "a.bin").write_bytes(bytes(content))
    (tmp_path / "b.bin").write_bytes(bytes(content) + b"?")
    got = trace_log.read_trace_log(spark, str(tmp_path)).collect()
    assert len(got) == 5 and [r.truncated_at for r in got if r.act is None] == [len(content)]
    assert {(r.addr, r["size"]) for r in got if r.act == "+"} == {(0x3C0B636C, 1024)}


def test_catalog_reads_no_contents(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "sub/c.avi", "noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = files.read_media_catalog(spark, str(tmp_path), ["mp4", ".AVI"])
    assert sorted((r.ext, r.container, r.length) for r in got.collect()) == [("avi", "avi", 5), ("mp4", "mp4", 5)]
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_metric_report(spark, tmp_path):
    block = "==== x ({} -> {}, bits: 16) ====\nfoo\n thd_db: -{}.5 dB\nbar\n snr_db: 60.25\n baz magnitude_response_diff: 0.5\n"
    (tmp_path / "r.txt").write_text(block.format(8000, 16000, 61) + "noise\n" + block.format(44100, 8000, 70))
    got = sorted(map(tuple, files.read_metric_report(spark, str(tmp_path)).collect()))
    assert got == [(8000, 16000, 16, -61.5, 60.25, 0.5), (44100, 8000, 16, -70.5, 60.25, 0.5)]


def test_slices(spark, tmp_path):
    rows = [("f", "video", 0, i, 400 * i, 0, i % 3 == 0, 10, 0, 0) for i in range(10)]
    files.write_slices(spark.createDataFrame(rows, MEDIA_FRAME), str(tmp_path / "out"), 1000)
    assert {p.name for p in (tmp_path / "out/file_id=f").iterdir()} == {f"slice=slice_{k}" for k in range(4)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_matrix(spark, tmp_path):
    long = spark.createDataFrame([(16, "thd", 8000, 16000, -61.234)], "bits int, metric string, src_rate int, dst_rate int, value double")
    files.write_matrix(V.metric_matrix(long, [8000, 16000]), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m/bits=16/metric=thd").glob("*.csv"))
    assert text.splitlines() == ["src_rate,8000,16000", "8000,,-61.23", "16000,,"]


def test_packets_and_containers(spark, tmp_path):
    spark.createDataFrame([(bytes.fromhex("80600001000000020000000A"),), (b"\x80",)], "payload binary").write.parquet(str(tmp_path / "p"))
    got = files.read_packets(spark, str(tmp_path / "p"), "payload")
    assert {(r.status, r.ssrc, r.pt) for r in got.collect()} == {("ok", 10, 96), ("bad_param", None, None)}


def test_tag_files(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"TAG" + b"T".ljust(30, b"\0") + b"A".ljust(30) + b"L".ljust(30, b"\0") + b"1999" + b"\0" * 30 + bytes([17]))
    (tmp_path / "b.mp3").write_bytes(b"none")
    assert [(r.title, r.author) for r in tags.read_tags(spark, str(tmp_path)).collect()] == [("T", "A")]


def test_frame_parser_waits_for_more(spark):
    df = spark.createDataFrame([("a", 0, b"xx\x03a"), ("a", 1, b"bc\x01"), ("a", 2, b"d")], "path string, idx int, data binary")

    def parse(data):  # a length byte, then so many bytes; "x" is skipped
        skip = len(data) - len(data.lstrip(b"x"))
        rest = data[skip:]
        return (skip, 1 + rest[0], {"first": chr(rest[1])}) if len(rest) > 1 else (skip, 0, {})

    got = sorted((r.pos, r["size"], r["first"]) for r in files.with_frame_parser(df, parse, "first string").collect())
    assert got == [(2, 4, "a"), (6, 2, "d")]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 2, i, (i * 7) % 40) for i in range(60)]
    df = spark.createDataFrame(rows, "ssrc long, arrival long, seq int")
    df.filter("arrival < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("arrival >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.stream_admit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "run"))
    from streamworks.operators import packets as P

    want = P.replay_status(P.extend_sequence(df), 128)
    assert sorted((r.ssrc, r.arrival, r.status) for r in got.collect()) == sorted((r.ssrc, r.arrival, r.status) for r in want.collect())
    assert streams.late_data_report(got).agg(F.sum("n")).first()[0] == want.filter("status <> 'ok'").count()
