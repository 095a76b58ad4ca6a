"""Point clouds and grids: voxels, hit counts, rays, discs, layers and nearest points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell
from .neighbours import nearest_k


def voxel_first(points: DataFrame, size: float = 0.04) -> DataFrame:
    """The first point, in the order of seq, of each voxel."""
    at = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*at).agg(F.min_by(F.struct("seq", "x", "y", "z"), "seq").alias("p")).select("vx", "vy", "vz", "p.*")


def bounds(points: DataFrame, margin: float, size: float) -> DataFrame:
    """One row: the grid's corner and its width and height in cells."""
    b = points.agg(*(f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    return b.select(
        (F.col("x_min") - margin).alias("x0"), (F.col("y_min") - margin).alias("y0"),
        *((F.ceil((F.col(f"{c}_max") - F.col(f"{c}_min") + 2 * margin) / size)).cast("int").alias(n) for c, n in (("x", "width"), ("y", "height"))),
    )


def hits(points: DataFrame, size: float = 0.05, least: int = 2, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(gx, gy, hits) of cells with at least so many points."""
    g = points.groupBy(cell(F.col("x"), x0, size).alias("gx"), cell(F.col("y"), y0, size).alias("gy")).agg(F.count("*").alias("hits"))
    return g.filter(F.col("hits") >= least)


def ray_cells(rays: DataFrame) -> DataFrame:
    """Distinct (gx, gy) that rays (ax, ay) -> (bx, by) cross before their end; rays of one cell have none."""
    n = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    r = rays.withColumn("n", n).filter("n > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b: (F.col(a) + F.col("i") * (F.col(b) - F.col(a)) / F.greatest(F.lit(1), F.col("n"))).cast("int")
    return r.select(at("ax", "bx").alias("gx"), at("ay", "by").alias("gy")).distinct()


def line_cells(rays: DataFrame) -> DataFrame:
    """Distinct (gx, gy) of the unbroken lines (ax, ay) -> (bx, by), both ends included.

    Lines run from their left end; the short side moves by what has been gone of it,
    rounded, halves down.
    """
    back = F.col("bx") < F.col("ax")
    r = rays.select(
        F.least("ax", "bx").alias("x0"), F.when(back, F.col("by")).otherwise(F.col("ay")).alias("y0"), F.abs(F.col("bx") - F.col("ax")).alias("w"),
        F.when(back, F.col("ay") - F.col("by")).otherwise(F.col("by") - F.col("ay")).alias("rise"),
    ).withColumns({"h": F.abs("rise")}).withColumns({"n": F.greatest("w", "h"), "short": F.least("w", "h")})
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    moved = F.when(F.col("n") > 0, F.expr("(2L * i * short + n - 1) div (2L * n)")).otherwise(F.lit(0))
    steep = F.col("h") > F.col("w")
    return r.withColumn("m", moved).select(
        (F.col("x0") + F.when(steep, F.col("m")).otherwise(F.col("i"))).cast("int").alias("gx"),
        (F.col("y0") + F.signum("rise").cast("int") * F.when(steep, F.col("i")).otherwise(F.col("m"))).cast("int").alias("gy"),
    ).distinct()


def disc_cells(centres: DataFrame, radius: int) -> DataFrame:
    """Distinct cells within a whole-number radius of the centres (gx, gy)."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    d = centres.select("gx", "gy").distinct().withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    return d.filter(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius).select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).distinct()


def layered(*layers: tuple[DataFrame, str]) -> DataFrame:
    """(gx, gy, state): a cell has the state of the last layer that covers it."""
    out = None
    for rank, (cells, state) in enumerate(layers):
        part = cells.select("gx", "gy", F.lit(rank).alias("rank"), F.lit(state).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("gx", "gy").agg(F.max_by("state", "rank").alias("state"))


def _cells(df: DataFrame, axes: str, size: float, around: bool) -> DataFrame:
    at = {f"_{c}": F.floor(F.col(c) / size) for c in axes}
    df = df.withColumns(at)
    if around:
        for c in axes:
            df = df.withColumn(f"_{c}", F.explode(F.array(*(F.col(f"_{c}") + k for k in (-1, 0, 1)))))
    return df


def far_from(candidates: DataFrame, poses: DataFrame, least: float = 0.5, axes: str = "xy") -> DataFrame:
    """Candidates with no pose nearer than `least`, by an anti join on cells of that size."""
    p = _cells(poses.select(*axes).distinct(), axes, least, True).select(*(F.col(c).alias(f"_p{c}") for c in axes), *(f"_{c}" for c in axes))
    c = _cells(candidates, axes, least, False)
    near = sum((F.col(a) - F.col(f"_p{a}")) * (F.col(a) - F.col(f"_p{a}")) for a in axes) < least * least
    same = None
    for a in axes:
        eq = c[f"_{a}"] == p[f"_{a}"]
        same = eq if same is None else same & eq
    return c.join(p, same & near, "left_anti").drop(*(f"_{a}" for a in axes))


def nearest_distance(points: DataFrame, cloud: DataFrame, size: float, id_: str = "seq") -> DataFrame:
    """points with the distance to the cloud's nearest point, found by the cells of `nearest_k`.

    These follow the cloud, however crowded it is; `size` is the width of the grid that was
    searched before and changes nothing. Points without finite coordinates, and all points if
    the cloud has none, get null.
    """
    there = cloud.select("x", "y", "z").distinct().withColumn("_at", F.monotonically_increasing_id())
    found = nearest_k(points.select(id_, "x", "y", "z"), there, 1, id_, "_at").select(id_, "distance")
    return points.join(found, id_, "left")


def patch_depth(pixels: DataFrame, depth: DataFrame, near: float, far: float, reach: int = 2, key: Sequence[str] = ("frame",)) -> DataFrame:
    """pixels (key, u, v) with z, the median of the depths from `near` to `far` in the patch around; 0 where there are none.

    Depths are dealt to the pixels whose patch they are in, so the join is on equal pixels.
    """
    side = F.sequence(F.lit(-reach), F.lit(reach))
    there = depth.filter(F.col("z").between(near, far)).select(*key, "u", "v", "z")
    there = there.withColumn("_du", F.explode(side)).withColumn("_dv", F.explode(side))
    there = there.select(*key, (F.col("u") + F.col("_du")).alias("u"), (F.col("v") + F.col("_dv")).alias("v"), "z")
    asked = pixels.select(*key, "u", "v").distinct()
    found = there.join(asked, [*key, "u", "v"], "left_semi").groupBy(*key, "u", "v").agg(F.percentile("z", 0.5).alias("z"))
    return pixels.join(found, [*key, "u", "v"], "left").fillna(0.0, ["z"])
