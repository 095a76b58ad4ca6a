"""Queries on pictures, detections, peaks and percentiles, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proxies as P
from ..operators import detections as D
from ..operators import rasters as I
from ..operators import selection as S
from ..operators import trajectory as R
from .queries import query

SIDE = 8
NARROW, HIGH = 12, 5


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 values as pictures of 8 by 8."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return P.read(spark, sf_dir, "embeddings").select("vec_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), e.alias("pixels"))


def _values(df: DataFrame, width: int) -> DataFrame:
    """(vec_id, u, v, value) of all pixels."""
    each = df.select("vec_id", F.posexplode("pixels").alias("at", "value"))
    return each.select("vec_id", (F.col("at") % width).cast("int").alias("u"), F.expr(f"CAST(at DIV {width} AS INT)").alias("v"), F.round(F.col("value").cast("double"), 5).alias("value"))


def _bilinear(e: str) -> str:
    """A value between four pixels in SQL, from x and y that lie inside."""
    at = lambda a, b: f"{e}[CAST({b} * {SIDE} + {a} AS BIGINT) + 1]"
    x1, y1 = f"least(x0 + 1, {SIDE - 1})", f"least(y0 + 1, {SIDE - 1})"
    dx, dy = "(x - x0)", "(y - y0)"
    return f"(1 - {dx}) * (1 - {dy}) * {at('x0', 'y0')} + {dx} * (1 - {dy}) * {at(x1, 'y0')} + (1 - {dx}) * {dy} * {at('x0', y1)} + {dx} * {dy} * {at(x1, y1)}"


def _rounded(value: str) -> str:
    """A value as a float of five digits; no negative zero."""
    made = f"round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 5)"
    return f"CASE WHEN {made} = 0 THEN CAST(0 AS DOUBLE) ELSE {made} END"


def _resized_sql(width: int, height: int, factor: str = "1") -> str:
    centre = lambda c, n: f"greatest(CAST(0 AS DOUBLE), least(CAST({SIDE - 1} AS DOUBLE), ({c} + CAST(0.5 AS DOUBLE)) * (CAST({SIDE} AS DOUBLE) / {n}) - CAST(0.5 AS DOUBLE)))"
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, e, CAST(u AS INT) AS u, CAST(v AS INT) AS v, {centre('u', width)} AS x, {centre('v', height)} AS y FROM e, range({width}) a(u), range({height}) b(v)),
q AS (SELECT *, floor(x) AS x0, floor(y) AS y0 FROM p)
SELECT vec_id, u, v, {_rounded(f"({_bilinear('e')}) * {factor}")} AS value FROM q"""


@query(_resized_sql(NARROW, HIGH))
def rasters_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(I.resized(_rasters(spark, sf_dir), NARROW, HIGH), NARROW)


@query(_resized_sql(20, 20, "(CAST(20 AS DOUBLE) / 8)"))
def disparities_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(I.rescaled(_rasters(spark, sf_dir), 20, 20), 20)


@query(f"""WITH e AS (SELECT vec_id, list_transform(range(64), lambda i: CAST((vec_id * 7 + i * 13) % 256 AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, e, CAST(u AS INT) AS u, CAST(v AS INT) AS v, u * CAST(1.25 AS DOUBLE) - 1 + v * CAST(0.125 AS DOUBLE) AS x, v * CAST(0.75 AS DOUBLE) + u * CAST(0.25 AS DOUBLE) AS y
      FROM e, range(9) a(u), range(7) b(v)),
q AS (SELECT *, floor(x) AS x0, floor(y) AS y0 FROM p)
SELECT vec_id, u, v, CASE WHEN x >= 0 AND x < {SIDE - 1} AND y >= 0 AND y < {SIDE - 1} THEN trunc({_bilinear('e')}) ELSE 0 END AS value FROM q""")
def pictures_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures seen through a slanted map."""
    places = F.sequence(F.lit(0), F.lit(62))
    u, v = (lambda i: (i % 9).cast("double")), (lambda i: F.floor(i / 9).cast("double"))
    df = _rasters(spark, sf_dir).withColumns({
        "pixels": F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("vec_id") * 7 + i * 13) % 256).cast("double")),
        "map_x": F.transform(places, lambda i: u(i) * 1.25 - 1 + v(i) * 0.125), "map_y": F.transform(places, lambda i: v(i) * 0.75 + u(i) * 0.25),
    })
    return _values(I.remapped(df, 9, 7).select("vec_id", "pixels"), 9)


def _normal_sql() -> str:
    mean, deviation = (f"[{', '.join(f'CAST({x} AS DOUBLE)' for x in v)}]" for v in I.DETECTOR)
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, CAST(i % 5 AS INT) AS u, CAST(i // 5 AS INT) AS v,
  {_rounded(f"(e[(i % 20) * 3 + i // 20 + 1] - {mean}[i // 20 + 1]) / {deviation}[i // 20 + 1]")} AS value FROM e, range(60) r(i)"""


@query(_normal_sql())
def pictures_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 values as pictures of 5 by 4 in three channels, one plane below the other."""
    df = _rasters(spark, sf_dir).withColumns({"width": F.lit(5), "height": F.lit(4), "pixels": F.slice("pixels", 1, 60)})
    return _values(I.normalised(df, *I.DETECTOR), 5)


_SIDES = "greatest(CAST(0 AS DOUBLE), least(k.x2, b[1].x2) - greatest(k.x1, b[1].x1)) * greatest(CAST(0 AS DOUBLE), least(k.y2, b[1].y2) - greatest(k.y1, b[1].y1))"
_AREAS = "(k.x2 - k.x1) * (k.y2 - k.y1) + (b[1].x2 - b[1].x1) * (b[1].y2 - b[1].y1)"


@query(f"""WITH {P.HANDS_SQL},
d AS (SELECT frame // 20 AS frame, frame * 2 + hand AS det, k[1].x AS x1, k[1].y AS y1, k[1].x + 8 + abs(k[2].x) AS x2, k[1].y + 8 + abs(k[2].y) AS y2, score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS rank FROM d),
f AS (SELECT frame, list([{{'det': det, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY rank) AS boxes FROM r GROUP BY frame),
s AS (SELECT frame, list_reduce(boxes, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: ({_SIDES}) > CAST(0.5 AS DOUBLE) * ({_AREAS} - ({_SIDES})))) = 0 THEN kept || b ELSE kept END) AS kept FROM f)
SELECT frame, kept[i].det AS det, CAST(i AS INT) AS rank FROM (SELECT frame, kept, unnest(range(1, len(kept) + 1)) AS i FROM s)""")
def detections_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the boxes of twenty pictures those that no better one hides."""
    k = F.col("k")
    d = P.hands(spark, sf_dir).select(
        F.expr("frame div 20").alias("frame"), (F.col("frame") * 2 + F.col("hand")).alias("det"), k[0]["x"].alias("x1"), k[0]["y"].alias("y1"),
        (k[0]["x"] + 8 + F.abs(k[1]["x"])).alias("x2"), (k[0]["y"] + 8 + F.abs(k[1]["y"])).alias("y2"), "score",
    )
    return D.suppressed(d, 0.5).select("frame", "det", "rank")


@query("""SELECT p, quantile_cont(l_extendedprice, p) AS value FROM lineitem, (VALUES (0.0), (0.02), (0.25), (0.5), (0.98), (0.99), (1.0)) q(p) GROUP BY p""".replace(
    "quantile_cont(l_extendedprice, p)",
    "CASE CAST(p AS VARCHAR) " + " ".join(f"WHEN '{p:.2f}' THEN quantile_cont(l_extendedprice, {p})" for p in (0.0, 0.02, 0.25, 0.5, 0.98, 0.99, 1.0)) + " END",
).replace("SELECT p, ", "SELECT CAST(p AS DOUBLE) AS p, "))
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a whole table, found by narrowing histograms."""
    parts = [0.0, 0.02, 0.25, 0.5, 0.98, 0.99, 1.0]
    found = S.percentiles(P.read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), parts, few=64)
    return spark.createDataFrame(list(zip(parts, found)), "p double, value double")


@query()
def walk_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the height of each walk."""
    return R.peak_rows(P.poses(spark, sf_dir), "z", 0.1, 3)
