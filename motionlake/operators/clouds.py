"""Point clouds of depth pictures: rasters taken apart, masked, lifted and moved to the world."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

MASKED = 128


def raster_cells(frames: DataFrame, rasters: Sequence[str], width: int, height: int, stride: int = 1) -> DataFrame:
    """frames with u, v and one value of each raster, for every stride-th pixel of every stride-th row.

    A raster is a flat array by rows; past its end the value is null.
    """
    columns = -(-width // stride)
    cells = columns * -(-height // stride)
    kept = [c for c in frames.columns if c not in rasters]
    f = frames.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    f = f.withColumns({"u": F.col("_i") % columns * stride, "v": F.expr(f"int(_i div {columns})") * stride})
    at = F.col("v") * width + F.col("u")
    return f.select(*kept, "u", "v", *(F.get(r, at).alias(r) for r in rasters))


def world_cloud(
    frames: DataFrame, width: int, height: int, stride: int = 4, near: float = 0.1, far: float = 5.0, camera: G.Camera = G.MAPPING,
) -> DataFrame:
    """Points (key, u, v, x, y, z) in the world, from frames with the arrays `disparity` and `mask` and a pose.

    The pose is r, nine numbers by rows, and tx, ty, tz; all other columns are the key. Pixels
    count where the mask is over 128 and the depth lies from `near` to `far`. Everything is
    done within a frame, so nothing is shuffled.
    """
    key = [c for c in frames.columns if c not in ("disparity", "mask", "r", "tx", "ty", "tz")]
    c = raster_cells(frames, ["disparity", "mask"], width, height, stride).filter(F.col("mask") > MASKED)
    c = c.withColumn("_z", G.depth(F.col("disparity"), camera)).filter(F.col("_z").between(near, far))
    p = G.lifted(F.col("u"), F.col("v"), F.col("_z"), camera, 0.0)
    c = c.withColumn("_p", p)
    world = G.moved(F.col("r"), [F.col(f"_p.{a}") for a in "xyz"], [F.col(f"t{a}") for a in "xyz"])
    return c.withColumn("_w", world).select(*key, "u", "v", "_w.*")
