"""Detections of a frame: suppression of those that overlap a better one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many of a frame's detections are looked at and kept.
LOOKED_AT, KEPT = 5000, 100
BOX = ("x1", "y1", "x2", "y2")


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share over the area of both; 0 for boxes without area."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    area = lambda p: F.greatest(F.lit(0.0), p["x2"] - p["x1"]) * F.greatest(F.lit(0.0), p["y2"] - p["y1"])
    shared = side("x1", "x2") * side("y1", "y2")
    both = area(a) + area(b) - shared
    return F.when(both > 0, shared / both).otherwise(F.lit(0.0))


def suppressed(
    detections: DataFrame, most: float = 0.5, least_score: float | None = None, key: Sequence[str] = ("frame",), looked_at: int = LOOKED_AT, kept: int = KEPT,
) -> DataFrame:
    """(key, det, x1, y1, x2, y2, score, rank): from the best score down, detections that overlap no kept one by more than `most`.

    At most `looked_at` of a frame are looked at and `kept` are kept, ties by det; ranks
    count from 1. Boxes or scores that are null don't take part. Frames are bounded, so one
    is a row of boxes that is folded without leaving the JVM.
    """
    whole = detections.dropna(subset=[*BOX, "score"])
    whole = whole if least_score is None else whole.filter(F.col("score") > least_score)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "det"))
    top = whole.select(*key, "det", *(F.col(c).cast("double").alias(c) for c in (*BOX, "score"))).withColumn("rank", rank).filter(F.col("rank") <= looked_at)
    boxes = F.array_sort(F.collect_list(F.struct("rank", "det", *BOX, "score")))
    frames = top.groupBy(*key).agg(boxes.alias("boxes"))

    def step(chosen: Column, box: Column) -> Column:
        hidden = F.exists(chosen, lambda c: overlap(c, box) > most)
        return F.when((F.size(chosen) >= kept) | hidden, chosen).otherwise(F.concat(chosen, F.array(box)))

    none = F.slice("boxes", 1, 0)
    found = frames.select(*key, F.posexplode(F.aggregate("boxes", none, step)).alias("place", "box"))
    return found.select(*key, "box.det", *(f"box.{c}" for c in (*BOX, "score")), (F.col("place") + 1).alias("rank"))
