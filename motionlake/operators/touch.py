"""Touching virtual buttons: which button a place lies in, and the events of a hand's index tip."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.pose import touching
from ..streaming import joints as N


class Button(NamedTuple):
    name: str
    x1: float
    y1: float
    x2: float
    y2: float


# The least trust in a tip that counts, and the least depth.
SURE, NEAREST = 0.25, 0.1


def first_hit(px: Column, py: Column, buttons: Sequence[Button]) -> Column:
    """The name of the first button that holds the place, borders included; null without one."""
    name = F.lit(None).cast("string")
    for b in reversed(buttons):
        name = F.when(px.between(b.x1, b.x2) & py.between(b.y1, b.y2), b.name).otherwise(name)
    return name


def tip_points(tips: DataFrame, camera: G.Camera = G.MAPPING) -> DataFrame:
    """tips (.., u, v, z, c) with x, y in space, for those that are sure and have a depth."""
    found = tips.filter((F.col("c") > SURE) & (F.col("z") > NEAREST))
    p = G.lifted(F.col("u"), F.col("v"), F.col("z"), camera)
    return found.withColumns({"x": p["x"], "y": p["y"]})


def touch_events(tips: DataFrame, buttons: Sequence[Button], key: str = "stream") -> DataFrame:
    """(key, frame, button, z) of frames whose tip lies on a button, at or before the touch plane.

    tips: (key, frame, det, t, track, u, v, z, c, px, py), z being the depth at the tip's pixel
    and (px, py) its place on the panel. Tips are smoothed in space along their track; of
    several hands in a frame the last one detected counts.
    """
    joint = F.array(F.struct("x", "y", "z", F.lit(1.0).alias("c")))
    rows = tip_points(tips).withColumn("k", joint)
    smooth = N.smoothed_joints(rows.select(key, "track", "frame", "t", "k"), N.fingertip, (key, "track"))
    smooth = smooth.select(key, "track", "frame", F.col("k")[0]["z"].alias("z"))
    placed = rows.select(key, "track", "frame", "det", "px", "py").join(smooth, [key, "track", "frame"])
    last = placed.groupBy(key, "frame").agg(F.max_by(F.struct("px", "py", "z"), "det").alias("tip"))
    hit = first_hit(F.col("tip.px"), F.col("tip.py"), buttons)
    return last.select(key, "frame", hit.alias("button"), "tip.z").filter(F.col("button").isNotNull() & touching(F.col("z")))
