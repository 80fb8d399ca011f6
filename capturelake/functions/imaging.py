"""Depth, colour, size and naming expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.policies import POINT_LIMIT


def java_round(v: Column) -> Column:
    """Half-up rounding, floor(x + 0.5), also for negatives."""
    return F.floor(v + F.lit(0.5))


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative operands."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("div", a, b)


def subsample_step(w: Column, h: Column, limit: int = POINT_LIMIT) -> Column:
    """I8: grid step keeping about ``limit`` pixels."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(w.cast("double") * h / F.lit(float(limit))))).cast("int")


def sampled_dim(n: Column, step: Column) -> Column:
    return int_div(n + step - 1, step).cast("int")


def scale_intrinsics(k: Column, w: Column, h: Column) -> Column:
    """Intrinsics (fx, fy, cx, cy, width, height) rescaled to another image size."""
    sx, sy = F.try_divide(w, k["width"]), F.try_divide(h, k["height"])
    return F.struct((k["fx"] * sx).alias("fx"), (k["fy"] * sy).alias("fy"),
                    (k["cx"] * sx).alias("cx"), (k["cy"] * sy).alias("cy"),
                    w.cast("int").alias("width"), h.cast("int").alias("height"))


def unproject(x: Column, y: Column, depth_mm: Column, k: Column) -> tuple[Column, Column, Column]:
    """Pixel and millimetres to camera-local metres, camera looking along −Z."""
    d = depth_mm / F.lit(1000.0)
    return F.try_divide(d * (x - k["cx"]), k["fx"]), F.try_divide(d * (k["cy"] - y), k["fy"]), -d


def norm_confidence(b: Column) -> Column:
    """Unsigned byte to 0..1."""
    return b.cast("int").bitwiseAND(F.lit(255)) / F.lit(255.0)


def color_coord(x: Column, y: Column, color_w: Column, depth_w: Column, depth_h: Column,
                min_y: Column, max_y: Column) -> tuple[Column, Column, Column, Column]:
    """Colour pixel and chroma pixel of a depth pixel."""
    lo, hi = java_round(min_y), java_round(max_y)
    cx = int_div(x * color_w, depth_w)
    cy = lo + int_div(y * (hi - lo), depth_h)
    two = F.lit(2)
    return cx, cy, int_div(cx, two), int_div(cy, two)


def _clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """YUV bytes to RGB 0..1 (fixed conversion coefficients)."""
    yf = y / F.lit(255.0)
    uf = u * F.lit(0.872) / F.lit(255.0) - F.lit(0.436)
    vf = v * F.lit(1.230) / F.lit(255.0) - F.lit(0.615)
    return (_clamp01(yf + F.lit(1.13983) * vf),
            _clamp01(yf - F.lit(0.39465) * uf - F.lit(0.58060) * vf),
            _clamp01(yf + F.lit(2.03211) * uf))


def to_byte(v: Column) -> Column:
    """0..1 to 0..255."""
    return java_round(_clamp01(v) * F.lit(255.0)).cast("smallint")


def pixel_count(w: Column, h: Column) -> Column:
    """I16."""
    return w.cast("long") * h.cast("long")


def is_four_by_three(w: Column, h: Column) -> Column:
    """I16: aspect within 0.04 of 4:3 in either orientation."""
    ratio = F.try_divide(F.greatest(w, h).cast("double"), F.least(w, h))
    return F.coalesce(F.abs(ratio - F.lit(4.0) / F.lit(3.0)) < F.lit(0.04), F.lit(False))


def megapixels(w: Column, h: Column) -> Column:
    """I23."""
    return pixel_count(w, h) / F.lit(1_000_000.0)


def jpeg_orientation(sensor: Column, display: Column) -> Column:
    """Degrees; an unknown sensor orientation counts as 90."""
    return F.pmod(F.coalesce(sensor, F.lit(90)) - display + F.lit(360), F.lit(360))


def frame_name(index: Column, ts: Column) -> Column:
    """Base name of one keyframe's files."""
    return F.format_string("frame_%06d_%d", index, ts)


def session_name(ts: Column) -> Column:
    """Session directory suffix from its wall-clock start."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")
