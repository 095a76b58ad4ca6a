"""Colours of depths, heights and surfaces, as column expressions and windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selection import percentiles

# Direction of the light, and gain and offset of red, green and blue.
LIGHT = (0.5, 0.8, 0.3)
CHANNELS = (("r", 1.1, 40), ("g", 1.0, 30), ("b", 0.9, 20))
TINY = 1e-5


def light() -> list[float]:
    size = math.sqrt(sum(v * v for v in LIGHT))
    return [v / size for v in LIGHT]


def clipped(value: Column, low: float, high: float) -> Column:
    """value within the two ends; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def ramp_index(z: Column, near: float, far: float, steps: int = 256) -> Column:
    """Place in a colour table, cut off: the last at the near end and before, 0 at the far end and behind; null has none."""
    return (clipped((far - z) / (far - near), 0.0, 1.0) * (steps - 1)).cast("int")


def elevation(points: DataFrame, height: Column, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """points with `level`, the height between its two percentiles as 0 to 1."""
    a, b = percentiles(points, height, [low, high])
    if a is None:
        return points.withColumn("level", F.lit(None).cast("double"))
    return points.withColumn("level", clipped((height - F.lit(a)) / (F.lit(b) - F.lit(a) + TINY), 0.0, 1.0))


def shaded(points: DataFrame, gray: Column, key: Sequence[str] = ("frame",)) -> DataFrame:
    """points with r, g and b: the gray value under a light from LIGHT, where the change from
    point to point in the order of seq, ties by place, stands for the surface's direction."""
    w = Window.partitionBy(*key).orderBy("seq", "x", "y", "z")
    d = points.withColumn("_gray", gray)
    for c in "xyz":
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        one_sided = F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before)
        d = d.withColumn(f"_g{c}", F.abs(F.coalesce(one_sided, (after - before) / 2, F.lit(0.0))))
    size = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy") + F.col("_gz") * F.col("_gz")) + TINY
    x, y, z = (F.col(f"_g{c}") / size * v for c, v in zip("xyz", light()))
    d = d.withColumn("_d", clipped(x + y + z, 0.2, 1.0))
    d = d.withColumns({c: clipped(F.col("_gray") * F.col("_d") * gain + offset, 0.0, 255.0).cast("int") for c, gain, offset in CHANNELS})
    return d.drop("_gray", "_gx", "_gy", "_gz", "_d")
