"""Camera, rotation and grid arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Camera(NamedTuple):
    fx: float
    fy: float
    cx: float
    cy: float
    baseline: float


# The mapping camera.
MAPPING = Camera(366.6111, 365.7001, 467.4125, 306.9927, 0.0624)


def depth(disparity: Column, camera: Camera = MAPPING, least: float = 1.0) -> Column:
    """Metres; null at or under the least disparity."""
    return F.when(disparity > least, camera.fx * camera.baseline / disparity)


def depth_clamped(disparity: Column, camera: Camera = MAPPING, least: float = 0.5) -> Column:
    """Metres, of a disparity that is at least `least`."""
    return camera.fx * camera.baseline / F.greatest(disparity, F.lit(least))


def rescaled(disparity: Column, made_at: int, width: int) -> Column:
    """A disparity of a picture that is `made_at` pixels wide, in pixels of one `width` wide."""
    return disparity * (width / made_at)


def millimetres(z: Column) -> Column:
    """Whole millimetres in 16 bits, cut off."""
    return F.least(F.lit(65535), F.greatest(F.lit(0), (z * 1000).cast("int")))


def lifted(u: Column, v: Column, z: Column, camera: Camera = MAPPING, least: float = 0.1) -> Column:
    """struct(x, y, z) of a pixel with depth; zeros where the depth is not over the least."""
    ok = z > least
    at = lambda x: F.when(ok, x).otherwise(F.lit(0.0))
    return F.struct(at((u - camera.cx) * z / camera.fx).alias("x"), at((v - camera.cy) * z / camera.fy).alias("y"), at(z).alias("z"))


def rotation(x: Column, y: Column, z: Column, w: Column) -> Column:
    """The nine numbers, by rows, of a quaternion's rotation; the quaternion is normalised."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def moved(r: Column, p: Sequence[Column], t: Sequence[Column]) -> Column:
    """struct(x, y, z) of r p + t."""
    return F.struct(*((r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i]).alias(c) for i, c in enumerate("xyz")))


def cell(value: Column, low: Column | float, size: float) -> Column:
    """Grid index, cut towards zero."""
    return ((value - low) / size).cast("int")


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def stereo_crop(width: Column) -> Column:
    """struct(left0, left1, right0, right1): where the two views lie in a joined frame."""
    half = F.call_function("div", width, F.lit(2)).cast("int")
    wide = F.struct(F.lit(160).alias("left0"), F.lit(2080).alias("left1"), F.lit(2080).alias("right0"), F.lit(4000).alias("right1"))
    return F.when(width == 4000, wide).otherwise(F.struct(F.lit(0).alias("left0"), half.alias("left1"), half.alias("right0"), width.cast("int").alias("right1")))


def letterbox(w: Column, h: Column, side: int) -> Column:
    """Scale that fits a picture into a square."""
    return F.least(side / w, side / h)
