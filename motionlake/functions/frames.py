"""Pictures, boxes and views: crops, scales and clamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Padding of boxes, and the least side of a hand's box.
AFFINE_PAD, HAND_PAD, BODY_PAD, LEAST_SIDE = 1.25, 0.25, 0.15, 10
BODY_ASPECT = 192.0 / 256.0


def finite(*names: str) -> Column:
    """Whether all of these columns are numbers other than NaN and infinity."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(F.abs(F.col(n)) < float("inf"), F.lit(False)) & ~F.isnan(n)
    return ok


def raster_index(value: Column, size: Column | int) -> Column:
    """The pixel of a coordinate, clamped to the raster."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.greatest(F.lit(0.0), F.least(value, (size - 1).cast("double"))).cast("int")


def frame_time(number: Column, fps: float) -> Column:
    """Seconds at which frame `number`, counted from 1, is taken."""
    return (number - 1) / fps


def touch_delta_cm(z: Column, plane: float) -> Column:
    """Centimetres behind the touch plane; 999 where there is no depth."""
    return F.when(z > 0.1, (z - plane) * 100.0).otherwise(F.lit(999.0))


def centred_letterbox(w: Column, h: Column, side: int) -> Column:
    """struct(scale, left, top): how a picture lies in the middle of a square."""
    scale = F.least(side / w, side / h)
    return F.struct(scale.alias("scale"), ((side - w * scale) / 2).alias("left"), ((side - h * scale) / 2).alias("top"))


def unletterboxed(value: Column, scale: Column, margin: Column | float = 0.0) -> Column:
    return (value - margin) / scale


def affine(x1: Column, y1: Column, x2: Column, y2: Column, out: int, pad: float = AFFINE_PAD) -> Column:
    """struct(scale, dx, dy): a box's padded square onto a square picture, p -> scale p + d, unturned."""
    size = F.greatest(x2 - x1, y2 - y1) * pad
    scale = out / size
    return F.struct(scale.alias("scale"), (out * 0.5 - scale * (x1 + x2) * 0.5).alias("dx"), (out * 0.5 - scale * (y1 + y2) * 0.5).alias("dy"))


def affine_back(x: Column, scale: Column, d: Column) -> Column:
    return (x - d) / scale


def _cut(cx: Column, cy: Column, bw: Column, bh: Column, width: int, height: int) -> Column:
    return F.struct(
        F.greatest(F.lit(0), (cx - bw * 0.5).cast("int")).alias("x1"), F.greatest(F.lit(0), (cy - bh * 0.5).cast("int")).alias("y1"),
        F.least(F.lit(width), (cx + bw * 0.5).cast("int")).alias("x2"), F.least(F.lit(height), (cy + bh * 0.5).cast("int")).alias("y2"),
    )


def hand_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """struct(x1, y1, x2, y2): the padded square around a hand's box, cut to the picture."""
    bw, bh = F.greatest(F.lit(LEAST_SIDE), x2 - x1), F.greatest(F.lit(LEAST_SIDE), y2 - y1)
    side = F.greatest(bw, bh) * (1 + HAND_PAD)
    return _cut(x1 + bw * 0.5, y1 + bh * 0.5, side, side, width, height)


def body_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """The padded box of a body, widened to the model's aspect, cut to the picture."""
    bw, bh = x2 - x1, y2 - y1
    pw, ph = bw * (1 + BODY_PAD), bh * (1 + BODY_PAD)
    wide = pw > ph * BODY_ASPECT
    return _cut(x1 + bw * 0.5, y1 + bh * 0.5, F.when(wide, pw).otherwise(ph * BODY_ASPECT), F.when(wide, pw / BODY_ASPECT).otherwise(ph), width, height)


def isometric(x: Column, y: Column, z: Column) -> Column:
    """struct(x, y): orthographic view along the diagonal."""
    angle = F.radians(F.lit(30.0))
    return F.struct(((x - y) * F.cos(angle)).alias("x"), ((x + y) * F.sin(angle) + z).alias("y"))


def near_camera_height(y: Column, camera_y: Column) -> Column:
    """Whether a point is in the slice of heights around the camera, ends left out; y points down."""
    return (y - camera_y > -0.75) & (y - camera_y < 0.25)


def obstacle_height(z: Column, body_z: Column) -> Column:
    """Whether a point can be run into by a body at body_z, ends included."""
    return (z - body_z).between(0.12, 1.45)
