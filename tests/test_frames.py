"""Frames in all pixel formats: buffers against pixel tables, odd sizes, refusals, and how far a round trip may be off."""

import itertools

import numpy as np
import pytest

from streamworks.operators import frame_formats as B
from streamworks.operators import images as I

SCHEMA = "frame_id long, width int, height int, fmt string, data binary"


def frames(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, w, h, "rgb888", rng.integers(0, 256, w * h * 3, dtype=np.uint8).tobytes()) for i, (w, h) in enumerate(sizes)]
    return spark.createDataFrame(rows, SCHEMA)


def pixels(frame):
    a = np.frombuffer(bytes(frame.data), np.uint8).reshape(frame.height, frame.width, 3)
    return [(frame.frame_id, x, y, *map(int, a[y, x])) for y in range(frame.height) for x in range(frame.width)]


SIZES = [(4, 4), (5, 3), (1, 1), (4, 4), (2, 7), (8, 2)]


@pytest.mark.parametrize("fmt", B.FORMATS)
def test_sizes_and_way_back(spark, fmt):
    """A buffer has the format's size, also where a side is odd, and comes back as what the pixel table says."""
    source = frames(spark, SIZES)
    there = B.convert_frames(source, fmt, "bt709")
    found = {r.frame_id: r for r in there.collect()}
    assert all(r.status == "ok" and r.fmt == fmt and len(r.data) == B.frame_size(fmt, r.width, r.height) for r in found.values())
    back = {r.frame_id: r for r in B.convert_frames(there, "rgb888", "bt709").collect()}
    table = spark.createDataFrame([p for r in source.collect() for p in pixels(r)], "frame_id long, x int, y int, r int, g int, b int")
    if fmt in B.WORDS:
        want = I.from_rgb565(I.to_rgb565(table))
    elif fmt in B.SHARED:
        yuv = B.share_chroma(I.to_yuv(table, "bt709"), *B.SHARED[fmt])
        want = I.from_yuv(yuv.withColumns({"u": yuv.u * 0 + 128, "v": yuv.v * 0 + 128}) if fmt == "y" else yuv, "bt709")
    else:
        want = table
    if fmt == "o_uyy_e_vyy":  # the last line of an odd height has no line of v
        want, back = want.filter("frame_id NOT IN (1, 2, 4)"), {k: r for k, r in back.items() if k not in (1, 2, 4)}
    wanted = sorted(map(tuple, want.select("frame_id", "x", "y", "r", "g", "b").collect()))
    assert sorted(p for r in back.values() for p in pixels(r)) == wanted


def test_every_pair_of_formats_goes_by_way_of_pixels():
    """Between two formats of one kind nothing is lost but what the target can't hold; views and packing agree for all pairs."""
    rng = np.random.default_rng(2)
    for a, b in itertools.product(B.FORMATS, B.FORMATS):
        data = rng.integers(0, 256, (3, B.frame_size(a, 4, 4)), dtype=np.uint8)
        once = B.convert_block(data, a, b, 4, 4, "bt601")
        assert once.shape == (3, B.frame_size(b, 4, 4))
        assert (B.convert_block(once, b, b, 4, 4, "bt601") == once).all()
        if a in B.SHARED and b in ("yuv_planar", "yuv_packet"):
            assert (B.convert_block(once, b, a, 4, 4, "bt601") == data).all()


@pytest.mark.parametrize(("fmt", "most"), [("yuv_packet", 3), ("rgb565_le", 7), ("bgr565_be", 7), ("bgr888", 0), ("argb888", 0)])
@pytest.mark.parametrize("standard", I.STANDARDS)
def test_error_of_a_round_trip(fmt, most, standard):
    step = np.arange(0, 256, 5, dtype=np.uint8)
    grid = np.array(np.meshgrid(step, step, step)).reshape(3, -1).T.reshape(1, -1)
    w = grid.shape[1] // 3
    back = B.convert_block(B.convert_block(np.ascontiguousarray(grid), "rgb888", fmt, w, 1, standard), fmt, "rgb888", w, 1, standard)
    assert np.abs(back.astype(int) - grid).max() <= most


def test_refusals_and_extra_columns(spark):
    good = bytes(range(12))
    rows = [(1, 2, 2, "rgb888", good), (2, 2, 2, "rgb888", good[:11]), (3, 2, 2, "jpeg", good), (4, 0, 2, "rgb888", good), (5, 2, 2, "rgb888", None), (6, None, 2, "rgb888", good), (7, 2, 2, "rgb888", good + b"more"), (8, 2, 2, None, good)]
    df = spark.createDataFrame([(*r, "kept", "old") for r in rows], SCHEMA + ", extra string, status string")
    got = {r.frame_id: r for r in B.convert_frames(df, "bgr888").collect()}
    assert [got[i].status for i in range(1, 9)] == ["ok", "data_lack", "not_supported", "bad_param", "data_lack", "bad_param", "ok", "not_supported"]
    assert all((r.data is None) == (r.status != "ok") and r.extra == "kept" for r in got.values())
    assert bytes(got[1].data) == bytes(got[7].data) == bytes([2, 1, 0, 5, 4, 3, 8, 7, 6, 11, 10, 9])
    assert B.convert_frames(df.limit(0), "y").collect() == []
    with pytest.raises(ValueError, match="unknown"):
        B.convert_frames(df, "jpeg")


def test_scaling_of_buffers_equals_that_of_pixels(spark):
    source = frames(spark, [(7, 5)] * 3)
    table = spark.createDataFrame([p for r in source.collect() for p in pixels(r)], "frame_id long, x int, y int, r int, g int, b int")
    for w, h in ((3, 4), (7, 5), (10, 9), (1, 1)):
        smooth = sorted(p for r in B.scale_bilinear_frames(source, w, h).collect() for p in pixels(r))
        assert smooth == sorted(map(tuple, B.scale_bilinear(table, 7, 5, w, h).select("frame_id", "x", "y", "r", "g", "b").collect()))
        assert smooth == sorted(p for r in I.scale_bilinear(source, w, h).collect() for p in pixels(r))
        picked = B.scale_down_frames(source, w, h).collect()
        if w > 7:
            assert {r.status for r in picked} == {"not_supported"}
        else:
            want = I.scale_down(table, 7, 5, w, h).select("frame_id", "x", "y", "r", "g", "b").collect()
            assert sorted(p for r in picked for p in pixels(r)) == sorted(map(tuple, want))


def test_scaling_in_other_formats(spark):
    """Chroma that pixels share is spread, scaled and shared again."""
    source = B.convert_frames(frames(spark, [(8, 8)]), "i420").drop("status")
    for fn in (B.scale_down_frames, B.scale_bilinear_frames):
        (r,) = fn(source, 4, 4).collect()
        assert r.fmt == "i420" and (r.width, r.height, len(r.data)) == (4, 4, 24)
    (same,), (was,) = B.scale_bilinear_frames(source, 8, 8).collect(), source.collect()
    assert bytes(same.data) == bytes(was.data)
