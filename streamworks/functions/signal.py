"""Columns over samples, levels and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE = {8: 128, 16: (1 << 15) - 1, 24: (1 << 23) - 1, 32: (1 << 31) - 1}
LOWEST = {8: 0, 16: -(1 << 15), 24: -(1 << 23), 32: -(1 << 31)}
HIGHEST = {8: 255, 16: (1 << 15) - 1, 24: (1 << 23) - 1, 32: (1 << 31) - 1}


def normalize_sample(v: Column, bits: Column) -> Column:
    """M1: u8: (v - 128) / 128; else v over the greatest value of its width."""
    scale = F.when(bits == 8, (v - 128) / 128)
    for b in (16, 24, 32):
        scale = scale.when(bits == b, v / FULL_SCALE[b])
    return scale


def convert_bits(v: Column, src: int, dst: int) -> Column:
    """M2: widening shifts left, narrowing shifts right (arithmetic); u8 is biased by 128."""
    signed = v.cast("long") - 128 if src == 8 else v.cast("long")
    moved = F.shiftleft(signed, dst - src) if dst >= src else F.shiftright(signed, src - dst)
    return moved + 128 if dst == 8 else moved


def convert_channels(frame: Column, weights: list[list[float]] | None, n_in: int, n_out: int, clip: float | None = None) -> Column:
    """M3: each output channel is a weighted sum of the input channels; by default 1/n_in each; equal counts without weights pass."""
    if weights is None:
        if n_in == n_out:
            return frame
        weights = [[1 / n_in] * n_in] * n_out
    out = []
    for row in weights:
        total = None
        for s, w in enumerate(row):
            term = F.get(frame, F.lit(s)) * F.lit(float(w))
            total = term if total is None else total + term
        out.append(F.least(F.greatest(total, F.lit(-clip)), F.lit(clip)) if clip is not None else total)
    return F.array(*out)


#: Channels of each layout, in order.
LAYOUTS = {
    "mono": ("M",), "stereo": ("L", "R"), "quad": ("FL", "FR", "SL", "SR"), "5.1": ("FL", "FR", "C", "LFE", "BL", "BR"), "7.1": ("FL", "FR", "C", "LFE", "SL", "SR", "BL", "BR"),
}
#: By output and input layout, a sum for each output channel; "-" is silence.
MIXES = {
    "mono": {
        "mono": "M", "stereo": "L*0.707+R*0.707", "quad": "FL*0.5+FR*0.5+SL*0.5+SR*0.5", "5.1": "FL*0.447+FR*0.447+C*0.447+BL*0.447+BR*0.447",
        "7.1": "FL*0.378+FR*0.378+C*0.378+SL*0.378+SR*0.378+BL*0.378+BR*0.378",
    },
    "stereo": {
        "mono": "M*0.707 M*0.707", "stereo": "L R", "quad": "FL+SL*0.707 FR+SR*0.707", "5.1": "FL+C*0.707+BL*0.707 FR+C*0.707+BR*0.707",
        "7.1": "FL+C*0.707+SL*0.707+BL*0.596 FR+C*0.707+SR*0.707+BR*0.596",
    },
    "quad": {
        "mono": "M*0.707 M*0.707 - -", "stereo": "L R - -", "quad": "FL FR SL SR", "5.1": "FL+C*0.707 FR+C*0.707 BL BR",
        "7.1": "FL*0.965+FR*0.258+C*0.707+SL*0.707 FL*0.258+FR*0.965+C*0.707+SR*0.707 SL*0.707+BL*0.965+BR*0.258 SR*0.707+BL*0.258+BR*0.965",
    },
    "5.1": {
        "mono": "M*0.707 M*0.707 - - - -", "stereo": "L R - - - -", "quad": "FL*0.961 FR*0.961 - - FL*0.274+SL*0.960+SR*0.422 FR*0.274+SL*0.422+SR*0.960", "5.1": "FL FR C LFE BL BR",
        "7.1": "FL+SL*0.367 FR+SR*0.367 C LFE SL*0.930+BL*0.700+BR*0.460 SR*0.930+BL*0.460+BR*0.700",
    },
    "7.1": {
        "mono": "M*0.707 M*0.707 - - - - - -", "stereo": "L R - - - - - -", "quad": "FL*0.939 FR*0.939 - - FL*0.344+SL*0.344 FR*0.344+SR*0.344 SL*0.939 SR*0.939",
        "5.1": "FL FR C LFE BL*0.883 BR*0.883 BL*0.470 BR*0.470", "7.1": "FL FR C LFE SL SR BL BR",
    },
}


def downmix_matrix(layout_in: str, layout_out: str) -> list[list[float]]:
    """M4: the weights for M3, a row for each output channel."""
    channels, rows = LAYOUTS[layout_in], []
    for total in MIXES[layout_out][layout_in].split(" "):
        row = [0.0] * len(channels)
        for term in total.split("+") if total != "-" else []:
            name, _, weight = term.partition("*")
            row[channels.index(name)] = float(weight or 1)
        rows.append(row)
    return rows


def downmix_weights() -> list[tuple[str, str, int, int, float]]:
    """M4 as rows (layout_in, layout_out, ch, out_ch, weight), silent channels with one weight of 0."""
    return [
        (a, b, c, d, w)
        for b in MIXES for a in MIXES[b] for d, row in enumerate(downmix_matrix(a, b)) for c, w in enumerate(row) if w or (c == 0 and not any(row))
    ]


def downmix_rows() -> list[tuple[str, str, int, list[float | None]]]:
    """The same by output channel: (layout_in, layout_out, out_ch, weights), null where a channel has no weight."""
    rows: dict[tuple[str, str, int], list[float | None]] = {}
    for a, b, c, d, w in downmix_weights():
        rows.setdefault((a, b, d), [None] * len(LAYOUTS[a]))[c] = w
    return [(*k, w) for k, w in rows.items()]


def interleave(channels: Column) -> Column:
    """M5: array of equally long channels to one array L1, R1, L2, R2, ..."""
    n = F.size(F.get(channels, F.lit(0)))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(channels, lambda c: F.get(c, i))))


def deinterleave(samples: Column, n_channels: int) -> Column:
    """M5, back."""
    return F.array(*[_every(samples, n_channels, c) for c in range(n_channels)])


def _every(samples: Column, n: int, first: int) -> Column:
    return F.filter(samples, lambda x, i: i % n == first)


def apply_gain(x: Column, db: Column, bits: int) -> Column:
    """M6: x * 10^(db/20), saturated; above 63 dB it stays 63, below -64 it is silence."""
    gain = F.when(db < -64, 0.0).otherwise(F.pow(F.lit(10.0), F.least(db, F.lit(63.0)) / 20))
    return F.least(F.greatest(x * gain, F.lit(float(LOWEST[bits]))), F.lit(float(HIGHEST[bits])))


def curve_db(in_db: Column, points: list[tuple[float, float]], makeup: float = 0.0) -> Column:
    """M7: the piecewise linear curve through points of falling x, flat beyond its ends; make-up gain comes on top."""
    out = F.lit(float(points[0][1]))
    for (x1, y1), (x0, y0) in zip(points, points[1:], strict=False):
        on = F.lit(float(y0)) + (in_db - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))
        out = F.when(in_db < x1, on).otherwise(out)
        out = out if x0 != points[-1][0] else F.when(in_db <= x0, float(y0)).otherwise(out)
    return out + makeup


def db_to_linear(db: Column) -> Column:
    """M8"""
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column, floor: float = 1e-20) -> Column:
    """M8"""
    return 20 * F.log10(x + floor)


def fourcc_pack(text: Column) -> Column:
    """M9: four characters, the first in the lowest byte."""
    byte = lambda i: F.ascii(F.substring(text, i + 1, 1)).cast("long")
    return byte(0) + F.shiftleft(byte(1), 8) + F.shiftleft(byte(2), 16) + F.shiftleft(byte(3), 24)


def fourcc_unpack(code: Column) -> Column:
    """M9, back."""
    return F.concat(*[F.chr(F.shiftrightunsigned(code, 8 * i).bitwiseAND(255)) for i in range(4)])


#: Bytes for two pixels by format.
PIXEL_BYTES_X2 = {
    "yuv420": 3, "i420": 3, "nv12": 3, "nv21": 3, "o_uyy_e_vyy": 3, "rgb565_le": 4, "rgb565_be": 4, "bgr565_le": 4, "bgr565_be": 4, "yuyv": 4, "uyvy": 4, "yuv422": 4,
    "rgb888": 6, "bgr888": 6, "yuv444": 6,
}


def image_size(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of a frame; 0 for an unknown format."""
    known = F.create_map(*[F.lit(x) for pair in PIXEL_BYTES_X2.items() for x in pair])
    return F.floor(width.cast("long") * height * F.coalesce(F.try_element_at(known, fmt), F.lit(0)) / 2)


def rgb565_unpack(value: Column, big_endian: bool = False) -> Column:
    """struct(r, g, b) of 8 bits each; the top bits fill the low ones."""
    v = F.shiftleft(value.bitwiseAND(255), 8) + F.shiftright(value, 8).bitwiseAND(255) if big_endian else value
    r, g, b = F.shiftright(v, 11).bitwiseAND(31), F.shiftright(v, 5).bitwiseAND(63), v.bitwiseAND(31)
    wide5 = lambda c: F.shiftleft(c, 3) + F.shiftright(c, 2)
    return F.struct(wide5(r).alias("r"), (F.shiftleft(g, 2) + F.shiftright(g, 4)).alias("g"), wide5(b).alias("b"))


def yuv_to_rgb(y: Column, u: Column, v: Column, weights: tuple[int, int, int, int, int] = (298, 409, 100, 208, 516)) -> Column:
    """struct(r, g, b) by fixed-point weights (of 256: luma, v in r, u in g, v in g, u in b), clamped."""
    wy, rv, gu, gv, bu = weights
    c, d, e = wy * (y - 16), u - 128, v - 128
    clamp = lambda x: F.least(F.greatest(F.shiftright(x + 128, 8), F.lit(0)), F.lit(255))
    return F.struct(clamp(c + rv * e).alias("r"), clamp(c - gu * d - gv * e).alias("g"), clamp(c + bu * d).alias("b"))


def big_endian_int(data: Column, start: int, size: int) -> Column:
    """An unsigned integer of a binary column (start from 1)."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def syncsafe_int(data: Column, start: int) -> Column:
    """Four bytes of seven bits each."""
    byte = lambda i: big_endian_int(data, start + i, 1).bitwiseAND(127)
    return F.shiftleft(byte(0), 21) + F.shiftleft(byte(1), 14) + F.shiftleft(byte(2), 7) + byte(3)


def tempo_error(n_in: Column, n_out: Column, speed: Column) -> Column:
    """How far the output's length is from the input's over the speed, in percent; null for an empty input."""
    want = F.try_divide(n_in, speed)
    return F.try_divide(F.abs(n_out - want), want) * 100


def level_agg(x: Column) -> Column:
    """struct(rms, peak, dc) of a group; zeros when it is empty."""
    zero = F.lit(0.0)
    return F.struct(F.coalesce(F.sqrt(F.avg(x * x)), zero).alias("rms"), F.coalesce(F.max(F.abs(x)), zero).alias("peak"), F.coalesce(F.avg(x), zero).alias("dc"))
