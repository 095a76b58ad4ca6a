"""Pairs of left and right pictures in the order in which they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import has_long_key, scanned
from .timeseries import ordered


def stereo_pairs(
    lefts: DataFrame, rights: DataFrame, poses: DataFrame, pose_tolerance_us: int, pair_tolerance_us: int, key: Sequence[str] = ("bag",)
) -> DataFrame:
    """(key, left_id, right_id, pose_id) of pictures that are taken together at a known pose.

    A left is held if a pose is near enough, and belongs to the first such pose; any other
    left lets go of what is held. A right near enough to the held left makes a pair and
    ends the hold; one too far away changes nothing. So a left's partner is the first near
    right before the next left, which one window over both sides finds.
    """
    cell = F.floor(F.col("us") / pose_tolerance_us)
    near = poses.select(*key, F.col("us").alias("_pus"), F.col("id").alias("_pid"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    posed = lefts.select(*key, "us", "id", cell.alias("_cell")).join(near, [*key, "_cell"]).filter(F.abs(F.col("us") - F.col("_pus")) <= pose_tolerance_us)
    posed = posed.groupBy(*key, "id").agg(F.min_by("_pid", F.struct("_pus", "_pid")).alias("pose_id"))
    held = F.struct(F.col("id").alias("id"), F.col("us").alias("us"), "pose_id")
    a = lefts.select(*key, "us", "id").join(posed, [*key, "id"], "left").select(*key, "us", "id", F.lit(False).alias("_right"), held.alias("_held"))
    b = rights.select(*key, "us", "id", F.lit(True).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_held", F.last("_held", True).over(ordered(*key).rowsBetween(Window.unboundedPreceding, 0)))
    ok = both.filter(F.col("_right") & F.col("_held.pose_id").isNotNull() & (F.abs(F.col("us") - F.col("_held.us")) <= pair_tolerance_us))
    return ok.groupBy(*key, F.col("_held.id").alias("left_id"), F.col("_held.pose_id").alias("pose_id")).agg(F.min_by("id", F.struct("us", "id")).alias("right_id"))


def next_right(lefts: DataFrame, rights: DataFrame, positions: Sequence[int] | None = None, key: Sequence[str] = ("bag",), ranges: int | None = None) -> DataFrame:
    """(key, position, left_id, right_id): the first right that comes after each left.

    Lefts are counted from 1; with `positions` only those are paired. Lefts after the last
    right go. One right can serve several lefts. Long keys are cut into ranges of time,
    always where `ranges` tells how many.
    """
    a = lefts.select(*key, "us", "id", F.lit(False).alias("_right"))
    b = rights.select(*key, "us", "id", F.lit(True).alias("_right"))
    both, order = a.unionByName(b), ["us", "id", "_right"]
    right, left = F.when(F.col("_right"), F.col("id")), F.when(~F.col("_right"), 1)
    if ranges or has_long_key(both, key):
        both = scanned(both, key, order, after={"right_id": right}, sums={"position": left}, ranges=ranges)
    else:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({"right_id": F.last(right, True).over(back), "position": F.sum(left).over(w)})
    out = both.filter("NOT _right AND right_id IS NOT NULL")
    if positions is not None:
        out = out.filter(F.col("position").isin(*positions))
    return out.select(*key, F.col("position").cast("int").alias("position"), F.col("id").alias("left_id"), "right_id")
