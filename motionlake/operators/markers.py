"""Rows for viewers: spheres and strips of hands, and thinned paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The joints of each finger, from the wrist on.
CHAINS = ((0, 1, 2, 3, 4), (0, 5, 6, 7, 8), (0, 9, 10, 11, 12), (0, 13, 14, 15, 16), (0, 17, 18, 19, 20))


def _seen(joint: Column, depth: float, trust: float) -> Column:
    return (joint["z"] > depth) & (joint["c"] > trust)


def joint_markers(hands: DataFrame, joints: str = "k", depth: float = 0.1, trust: float = 0.25) -> DataFrame:
    """(frame, ns, id, type, points) from (frame, hand, joints of x, y, z, c).

    A joint that is seen is a sphere; a finger with two seen joints or more is a strip
    through them. Markers of a frame are numbered from 0: by hand, spheres before strips.
    """
    k = F.col(joints)
    spheres = F.filter(F.transform(k, lambda j, i: F.struct(F.lit(0).alias("rank"), i.cast("int").alias("at"), F.lit("SPHERE").alias("type"), F.filter(F.array(j), lambda p: _seen(p, depth, trust)).alias("points"))), lambda m: F.size(m["points"]) == 1)
    strips = F.filter(
        F.array(*(F.struct(F.lit(1).alias("rank"), F.lit(n).alias("at"), F.lit("LINE_STRIP").alias("type"), F.filter(F.array(*(k[i] for i in chain)), lambda p: _seen(p, depth, trust)).alias("points")) for n, chain in enumerate(CHAINS))),
        lambda m: F.size(m["points"]) >= 2,
    )
    rows = hands.select("frame", "hand", F.explode(F.concat(spheres, strips)).alias("m"))
    number = F.row_number().over(Window.partitionBy("frame").orderBy("hand", "m.rank", "m.at")) - 1
    ns = F.format_string("hand_%d_%s", F.col("hand"), F.when(F.col("m.rank") == 0, "joints").otherwise("bones"))
    return rows.select("frame", ns.alias("ns"), number.alias("id"), "m.type", "m.points")


def path_markers(poses: DataFrame, keep: int = 300, every: int = 5, key: Sequence[str] = ("bag",)) -> DataFrame:
    """Each step-th pose by seq, step = max(1, n div keep), and whether it has a marker: each `every`-th of those."""
    n = F.count("*").over(Window.partitionBy(*key))
    at = F.row_number().over(Window.partitionBy(*key).orderBy("seq")) - 1
    d = poses.withColumns({"_n": n, "at": at}).withColumn("_step", F.greatest(F.lit(1), F.call_function("div", F.col("_n"), F.lit(keep))))
    return d.filter(F.col("at") % F.col("_step") == 0).withColumn("marked", F.col("at") % (every * F.col("_step")) == 0).drop("_n", "_step")
