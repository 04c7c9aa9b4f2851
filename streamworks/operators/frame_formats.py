"""Frames as byte buffers in any pixel format (frame_id, width, height, fmt, data): conversion and scaling on strided views of whole Arrow batches.

Frames of one size and format in a batch are one block of bytes; their planes are views of it with strides, so no frame is copied before
it is computed on, and each step runs over all of them. Frames stay where they are: nothing is shuffled.

``status`` tells "ok", "data_lack" where a buffer is shorter than its size and format need, "not_supported" for a format that isn't known or a
scale that a method refuses, "bad_param" for sizes below 1; the data is null for all but "ok". Longer buffers are read as far as needed.

Layouts are those of the formats' published codes; chroma of a block is the rounded mean of its pixels' chroma, and is repeated on the way back **[choice]**.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .images import STANDARDS, back_weights

#: RGB formats in bytes: the place of r, g, b in a pixel, and its size.
BYTES = {"rgb888": (0, 1, 2, 3), "bgr888": (2, 1, 0, 3), "argb888": (0, 1, 2, 4), "abgr888": (2, 1, 0, 4)}
#: RGB formats in 16 bits: the shift of r and of b, and the byte order.
WORDS = {"rgb565_le": (11, 0, "<u2"), "bgr565_le": (0, 11, "<u2"), "rgb565_be": (11, 0, ">u2"), "bgr565_be": (0, 11, ">u2")}
#: YUV formats: pixels that share a chroma value across and down.
SHARED = {"y": (1, 1), "yuv_planar": (1, 1), "yuv_packet": (1, 1), "yuyv": (2, 1), "uyvy": (2, 1), "i420": (2, 2), "o_uyy_e_vyy": (2, 2)}
FORMATS = (*BYTES, *WORDS, *SHARED)


def frame_size(fmt: str, w: int, h: int) -> int:
    """Bytes of a frame. Shared chroma of an odd side counts as a whole value."""
    if fmt in BYTES:
        return BYTES[fmt][3] * w * h
    if fmt in WORDS:
        return 2 * w * h
    half = -(-w // 2)
    if fmt in ("yuyv", "uyvy"):
        return 4 * half * h
    if fmt == "i420":
        return w * h + 2 * half * -(-h // 2)
    if fmt == "o_uyy_e_vyy":
        return 3 * half * h
    return {"y": 1, "yuv_planar": 3, "yuv_packet": 3}[fmt] * w * h


def _unpack(data: np.ndarray, fmt: str, w: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three planes (frames, height, width) of a block of frames: r, g, b or y, u, v. Chroma planes may be smaller; they are views where the layout allows it."""
    n, half = len(data), -(-w // 2)
    if fmt in BYTES:
        *at, size = BYTES[fmt]
        pixels = data.reshape(n, h, w, size)
        return tuple(pixels[..., i] for i in at)
    if fmt in WORDS:
        red, blue, order = WORDS[fmt]
        v = data.view(order).reshape(n, h, w).astype(np.uint16)
        five = lambda x: (x << 3 | x >> 2).astype(np.uint8)
        green = v >> 5 & 63
        return five(v >> red & 31), (green << 2 | green >> 4).astype(np.uint8), five(v >> blue & 31)
    if fmt == "y":
        y = data.reshape(n, h, w)
        grey = np.broadcast_to(np.uint8(128), y.shape)
        return y, grey, grey
    if fmt == "yuv_planar":
        return tuple(data.reshape(n, 3, h, w).transpose(1, 0, 2, 3))
    if fmt == "yuv_packet":
        return tuple(data.reshape(n, h, w, 3).transpose(3, 0, 1, 2))
    if fmt in ("yuyv", "uyvy"):
        at = (0, 2, 1, 3) if fmt == "yuyv" else (1, 3, 0, 2)
        quads = data.reshape(n, h, half, 4)
        return quads[..., at[0] : at[1] + 1 : 2].reshape(n, h, 2 * half)[..., :w], quads[..., at[2]], quads[..., at[3]]
    if fmt == "i420":
        area, small = w * h, half * -(-h // 2)
        shape = (n, -(-h // 2), half)
        return data[:, :area].reshape(n, h, w), data[:, area : area + small].reshape(shape), data[:, area + small :].reshape(shape)
    rows = data.reshape(n, h, half, 3)
    v = rows[:, 1::2, :, 0]
    if h % 2:  # the last line has no line of v below it
        v = np.concatenate([v, np.full((n, 1, half), 128, np.uint8)], axis=1)
    return rows[..., 1:].reshape(n, h, 2 * half)[..., :w], rows[:, ::2, :, 0], v


def _pack(planes: tuple[np.ndarray, np.ndarray, np.ndarray], fmt: str) -> np.ndarray:
    """The bytes of each frame of three planes, which already share chroma as the format does."""
    a, b, c = planes
    n, h, w = a.shape
    half = -(-w // 2)
    if fmt in BYTES:
        *at, size = BYTES[fmt]
        out = np.full((n, h, w, size), 255, np.uint8)
        for i, plane in zip(at, planes, strict=True):
            out[..., i] = plane
        return out.reshape(n, -1)
    if fmt in WORDS:
        red, blue, order = WORDS[fmt]
        v = (a.astype(np.uint16) >> 3 << red) | (b.astype(np.uint16) >> 2 << 5) | (c.astype(np.uint16) >> 3 << blue)
        return np.ascontiguousarray(v.astype(order)).view(np.uint8).reshape(n, -1)
    if fmt == "y":
        return np.ascontiguousarray(a).reshape(n, -1)
    if fmt == "yuv_planar":
        return np.stack(planes, axis=1).reshape(n, -1)
    if fmt == "yuv_packet":
        return np.stack(planes, axis=-1).reshape(n, -1)
    if fmt == "i420":
        return np.concatenate([x.reshape(n, -1) for x in planes], axis=1)
    even = np.concatenate([a, a[..., -1:]], axis=2) if w % 2 else a  # an odd side repeats its last luma
    pairs = even.reshape(n, h, half, 2)
    if fmt in ("yuyv", "uyvy"):
        order = (pairs[..., 0], b, pairs[..., 1], c) if fmt == "yuyv" else (b, pairs[..., 0], c, pairs[..., 1])
        return np.stack(order, axis=-1).reshape(n, -1)
    chroma = np.empty((n, h, half), np.uint8)
    chroma[:, ::2], chroma[:, 1::2] = b, c[:, : h // 2]
    return np.concatenate([chroma[..., None], pairs], axis=-1).reshape(n, -1)


def _spread(plane: np.ndarray, across: int, down: int, w: int, h: int) -> np.ndarray:
    return plane.repeat(down, axis=1).repeat(across, axis=2)[:, :h, :w] if across > 1 or down > 1 else plane


def _share(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """The rounded mean of each block (half up); blocks at an odd side are smaller."""
    if across == down == 1:
        return plane
    add = lambda x, k, axis: np.add.reduceat(x, np.arange(0, x.shape[axis], k), axis=axis)
    total = add(add(plane.astype(np.int64), down, 1), across, 2)
    _, h, w = plane.shape
    count = np.outer(add(np.ones(h, int), down, 0), add(np.ones(w, int), across, 0))
    return ((2 * total + count) // (2 * count)).astype(np.uint8)


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _to_yuv(planes, standard: str):
    kr, kb = STANDARDS[standard]
    r, g, b = (p.astype(np.float64) for p in planes)
    luma = kr * r + (1 - kr - kb) * g + kb * b
    return _half_up(16 + luma * 219 / 255), _half_up(128 + (b - luma) / (1 - kb) / 2 * 224 / 255), _half_up(128 + (r - luma) / (1 - kr) / 2 * 224 / 255)


def _to_rgb(planes, standard: str):
    wy, rv, gu, gv, bu = back_weights(standard)
    y, u, v = (p.astype(np.int64) for p in planes)
    c, d, e = wy * (y - 16), u - 128, v - 128
    clamp = lambda x: np.clip((x + 128) >> 8, 0, 255).astype(np.uint8)
    return clamp(c + rv * e), clamp(c - gu * d - gv * e), clamp(c + bu * d)


def _full(data: np.ndarray, fmt: str, w: int, h: int):
    """Planes of full size."""
    a, b, c = _unpack(data, fmt, w, h)
    across, down = SHARED.get(fmt, (1, 1))
    return a, _spread(b, across, down, w, h), _spread(c, across, down, w, h)


def _shared(planes, fmt: str):
    a, b, c = planes
    return a, *(_share(x, *SHARED.get(fmt, (1, 1))) for x in (b, c))


def convert_block(data: np.ndarray, fmt: str, out: str, w: int, h: int, standard: str) -> np.ndarray:
    planes = _full(data, fmt, w, h)
    if (fmt in SHARED) != (out in SHARED):
        planes = _to_rgb(planes, standard) if fmt in SHARED else _to_yuv(planes, standard)
    return _pack(_shared(planes, out), out)


def _per_block(df: DataFrame, fn: Callable[[np.ndarray, str, int, int], tuple[np.ndarray, str, int, int] | None]) -> DataFrame:
    """``fn`` on the bytes (frames, bytes) of each run of frames of a batch that share size and format: new bytes, format, width and height, or None to refuse."""
    schema = T.StructType([*[f for f in df.schema if f.name != "status"], T.StructField("status", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("width", "height", "fmt", "data")}
            ws, hs, fmts = (col[c].to_pylist() for c in ("width", "height", "fmt"))
            raw = np.frombuffer(col["data"].buffers()[2] or b"", np.uint8)
            wide = pa.types.is_large_binary(col["data"].type)
            ends = np.frombuffer(col["data"].buffers()[1], np.int64 if wide else np.int32)[col["data"].offset : col["data"].offset + batch.num_rows + 1]
            known = col["data"].is_valid().to_numpy(zero_copy_only=False)
            status, out = ["ok"] * batch.num_rows, [None] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(ws, hs, fmts, strict=True)):
                w, h, fmt = key
                if w is None or h is None or w < 1 or h < 1:
                    status[i] = "bad_param"
                elif fmt not in FORMATS:
                    status[i] = "not_supported"
                elif not known[i] or ends[i + 1] - ends[i] < frame_size(fmt, w, h):
                    status[i] = "data_lack"
                else:
                    groups.setdefault(key, []).append(i)
            for (w, h, fmt), rows in groups.items():
                size = frame_size(fmt, w, h)
                starts = ends[rows].astype(np.int64)
                if len(rows) > 1 and (np.diff(starts) == size).all():
                    block = raw[starts[0] : starts[0] + size * len(rows)].reshape(len(rows), size)  # frames in a row: a view
                else:
                    block = np.stack([raw[s : s + size] for s in starts.tolist()])
                done = fn(block, fmt, w, h)
                for k, i in enumerate(rows):
                    if done is None:
                        status[i] = "not_supported"
                    else:
                        out[i], fmts[i], ws[i], hs[i] = done[0][k].tobytes(), *done[1:]
            new = {"width": ws, "height": hs, "fmt": fmts, "data": out, "status": status}
            kinds = {"width": pa.int32(), "height": pa.int32(), "fmt": pa.string(), "data": pa.binary(), "status": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kinds[c]) if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    fixed = df.withColumns({"width": F.col("width").cast("int"), "height": F.col("height").cast("int")})
    return fixed.mapInArrow(run, T.StructType([T.StructField(f.name, T.IntegerType() if f.name in ("width", "height") else f.dataType) for f in schema]))


def convert_frames(df: DataFrame, fmt: str, standard: str = "bt601") -> DataFrame:
    """I5 on buffers: every frame in ``fmt``, by the colour standard where it goes from RGB to YUV or back."""
    if fmt not in FORMATS or standard not in STANDARDS:
        raise ValueError(f"unknown format or standard: {fmt}, {standard}")
    return _per_block(df, lambda data, own, w, h: (convert_block(data, own, fmt, w, h, standard), fmt, w, h))


def scale_down_frames(df: DataFrame, w: int, h: int) -> DataFrame:
    """I3 on buffers of any format: target pixel x takes source pixel floor(x width / w). It doesn't enlarge; such frames are "not_supported"."""

    def pick(data: np.ndarray, fmt: str, width: int, height: int):
        if w < 1 or h < 1 or w > width or h > height:
            return None
        xs, ys = np.arange(w) * width // w, np.arange(h) * height // h
        planes = tuple(p[:, ys][:, :, xs] for p in _full(data, fmt, width, height))
        return _pack(_shared(planes, fmt), fmt), fmt, w, h

    return _per_block(df, pick)


def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of m targets over n pixels, sampled at pixel centres: both neighbours and the weight of the second."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def scale_bilinear_frames(df: DataFrame, w: int, h: int) -> DataFrame:
    """I4 on buffers of any format, up or down, plane by plane."""

    def weigh(data: np.ndarray, fmt: str, width: int, height: int):
        if w < 1 or h < 1:
            return None
        (x0, x1, fx), (y0, y1, fy) = axis(width, w), axis(height, h)
        out = []
        for p in _full(data, fmt, width, height):
            f = p.astype(np.float64)
            rows0, rows1 = f[:, y0], f[:, y1]
            top = rows0[:, :, x0] * (1 - fx) + rows0[:, :, x1] * fx
            low = rows1[:, :, x0] * (1 - fx) + rows1[:, :, x1] * fx
            out.append(np.rint(top * (1 - fy)[:, None] + low * fy[:, None]).astype(np.uint8))
        return _pack(_shared(tuple(out), fmt), fmt), fmt, w, h

    return _per_block(df, weigh)


def scale_bilinear(df: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """I4 on a pixel table whose frames are ``width`` x ``height``: each pixel goes to the targets that it is a neighbour of, by equi-joins with one row
    for each target column (or row) and side; four neighbours meet in one aggregation. Targets that miss a neighbour are left out."""
    spark = df.sparkSession

    def places(n: int, m: int, name: str) -> DataFrame:
        low, high, weight = axis(n, m)
        rows = [(int(s), k, side, float(weight[k])) for side, at in enumerate((low, high)) for k, s in enumerate(at)]
        return spark.createDataFrame(rows, f"{name} int, t{name} int, {name}_side int, f{name} double")

    met = df.join(places(width, w, "x"), "x").join(places(height, h, "y"), "y")
    corner = lambda c, x, y: F.max(F.when((F.col("x_side") == x) & (F.col("y_side") == y), F.col(c)))
    four = met.groupBy("frame_id", "tx", "ty").agg(
        F.first("fx").alias("fx"), F.first("fy").alias("fy"), *[corner(c, x, y).alias(f"{c}{y}{x}") for c in "rgb" for x in (0, 1) for y in (0, 1)]
    )
    fx, fy = F.col("fx"), F.col("fy")
    line = lambda c, y: F.col(f"{c}{y}0") * (1 - fx) + F.col(f"{c}{y}1") * fx
    value = lambda c: F.rint(line(c, 0) * (1 - fy) + line(c, 1) * fy).cast("int").alias(c)
    return four.select("frame_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *map(value, "rgb")).dropna()


def share_chroma(df: DataFrame, across: int, down: int) -> DataFrame:
    """I5 on a pixel table with u, v: the rounded mean of each block of pixels on all its pixels."""
    block = [F.floor(F.col("x") / across).alias("bx"), F.floor(F.col("y") / down).alias("by")]
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("int").alias(c)
    means = df.groupBy("frame_id", *block).agg(mean("u"), mean("v"))
    return df.drop("u", "v").withColumns({"bx": block[0], "by": block[1]}).join(means, ["frame_id", "bx", "by"]).drop("bx", "by")
