"""Image frames as pixel tables (frame_id, x, y, r, g, b) and as byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import rgb565_unpack, yuv_to_rgb

#: Luma weights (red, blue) of the colour standards.
STANDARDS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def crop(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle, moved to the origin."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return df.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def crop_errors(frames: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Frames (frame_id, width, height) that don't hold the rectangle."""
    return frames.filter((F.col("width") < x + w) | (F.col("height") < y + h) | F.lit(x < 0 or y < 0 or w <= 0 or h <= 0))


def rotate(df: DataFrame, degrees: int, width: int, height: int) -> DataFrame:
    """Clockwise by a right angle; 90 and 270 swap width and height."""
    x, y = F.col("x"), F.col("y")
    places = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    if degrees not in places:
        raise ValueError("right angles only")
    a, b = places[degrees]
    return df.withColumns({"x": a, "y": b})


def scale_down(df: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """Target pixel x takes source pixel floor(x width / w) **[choice]**, by filters on the picked rows and columns."""
    picked = lambda n, m: {k * n // m: k for k in range(m)}
    xs, ys = picked(width, w), picked(height, h)
    place = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    kept = df.filter(F.col("x").isin(list(xs)) & F.col("y").isin(list(ys)))
    return kept.withColumns({"x": F.element_at(place(xs), F.col("x")), "y": F.element_at(place(ys), F.col("y"))})


def max_channel_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greatest difference of each channel over all pixels."""
    both = a.join(b.select("frame_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgb"]), ["frame_id", "x", "y"])
    return both.agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}2"))).alias(f"max_{c}") for c in "rgb"])


def to_yuv(df: DataFrame, standard: str = "bt601") -> DataFrame:
    """Limited-range y, u, v of a pixel table."""
    kr, kb = STANDARDS[standard]
    luma = kr * F.col("r") + (1 - kr - kb) * F.col("g") + kb * F.col("b")
    clamp = lambda c: F.least(F.greatest(F.round(c), F.lit(0)), F.lit(255)).cast("int")
    return df.withColumns({
        "yy": clamp(16 + luma * 219 / 255), "u": clamp(128 + (F.col("b") - luma) / (1 - kb) / 2 * 224 / 255), "v": clamp(128 + (F.col("r") - luma) / (1 - kr) / 2 * 224 / 255),
    })


def back_weights(standard: str) -> tuple[int, int, int, int, int]:
    """Fixed-point weights (of 256) of luma, v in r, u in g, v in g, u in b, from the standard's luma weights."""
    kr, kb = STANDARDS[standard]
    kg, chroma = 1 - kr - kb, 256 * 255 / 224
    return round(256 * 255 / 219), round(2 * (1 - kr) * chroma), round(2 * (1 - kb) * kb / kg * chroma), round(2 * (1 - kr) * kr / kg * chroma), round(2 * (1 - kb) * chroma)


def from_yuv(df: DataFrame, standard: str = "bt601") -> DataFrame:
    """M12 on a table with yy, u, v."""
    c = yuv_to_rgb(F.col("yy"), F.col("u"), F.col("v"), back_weights(standard))
    return df.withColumn("_c", c).withColumns({k: F.col(f"_c.{k}").cast("int") for k in "rgb"}).drop("_c")


def to_rgb565(df: DataFrame) -> DataFrame:
    """``v565``, the packed value of each pixel."""
    return df.withColumn("v565", F.shiftleft(F.shiftright("r", 3), 11) + F.shiftleft(F.shiftright("g", 2), 5) + F.shiftright("b", 3))


def from_rgb565(df: DataFrame) -> DataFrame:
    """M11 on a table with v565."""
    return df.withColumn("_c", rgb565_unpack(F.col("v565"))).withColumns({k: F.col(f"_c.{k}") for k in "rgb"}).drop("_c")


def to_frames(df: DataFrame) -> DataFrame:
    """Pixel rows to rgb888 buffers (frame_id, width, height, fmt, data); only whole frames."""
    pixel = F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in "rgb"])
    listed = df.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", pixel.alias("p")))).alias("s"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    data = F.unhex(F.array_join(F.transform("s", lambda s: s["p"]), ""))
    return listed.filter(F.size("s") == F.col("width") * F.col("height")).select("frame_id", "width", "height", F.lit("rgb888").alias("fmt"), data.alias("data"))


def _on_frames(df: DataFrame, fn) -> DataFrame:
    """A numpy function on each frame's (height, width, 3) array; null (with its size) where it says None."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                out = fn(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3))
                r["data"] = None if out is None else np.ascontiguousarray(out).tobytes()
                if out is not None:
                    r["height"], r["width"] = out.shape[:2]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema).select(names)

    return df.mapInArrow(run, df.schema)


def crop_frames(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """I1 on buffers: data is null where the rectangle lies outside."""
    return _on_frames(df, lambda a: a[y : y + h, x : x + w] if min(x, y) >= 0 and x + w <= a.shape[1] and y + h <= a.shape[0] else None)


def rotate_frames(df: DataFrame, degrees: int) -> DataFrame:
    """I2 on buffers."""
    return _on_frames(df, lambda a: np.rot90(a, -degrees // 90 % 4))


def bilinear(a: np.ndarray, w: int, h: int) -> np.ndarray:
    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(a.shape[0], h)
    x0, x1, fx = axis(a.shape[1], w)
    f = a.astype(float)
    top = f[y0][:, x0] * (1 - fx)[None, :, None] + f[y0][:, x1] * fx[None, :, None]
    low = f[y1][:, x0] * (1 - fx)[None, :, None] + f[y1][:, x1] * fx[None, :, None]
    return np.rint(top * (1 - fy)[:, None, None] + low * fy[:, None, None]).astype(np.uint8)


def scale_bilinear(df: DataFrame, w: int, h: int) -> DataFrame:
    """I4: four-neighbour weights, sampled at pixel centres."""
    return _on_frames(df, lambda a: bilinear(a, w, h))
