"""Named queries on boxes, pixels, views and long keys, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import frames as K
from ..functions import geometry as G
from ..operators import pairing as A
from ..operators import spatial as S
from ..operators import timeseries as T
from .queries import query, side

_BOX = "x AS x1, y AS y1, x + 1 + z * 10 AS x2, y + 1 + x / 2 AS y2"
_PIXEL = "CAST(trunc(abs(j.x)) AS INT) % 24 AS u, CAST(trunc(abs(j.y)) AS INT) % 16 AS v"


@query(f"""WITH {P.POINTS_SQL}, q AS (SELECT frame, seq, x / nullif(z, 0) AS x, y, z FROM pt)
SELECT frame, seq FROM q WHERE x IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z)""")
def finite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.points(spark, sf_dir).withColumn("x", F.when(F.col("z") != 0, F.col("x") / F.col("z")))
    return p.filter(K.finite("x", "y", "z")).select("frame", "seq")


@query(f"""WITH {P.POINTS_SQL}, b AS (SELECT frame, seq, z, {_BOX} FROM pt), s AS (SELECT *, 256 / (greatest(x2 - x1, y2 - y1) * 1.25e0) AS k FROM b)
SELECT frame, seq, round(k, 6) AS scale, round(128 - k * (x1 + x2) * 5e-1, 6) AS dx, round((100 - (128 - k * (x1 + x2) * 5e-1)) / k, 6) AS back_x,
  round(least(640 / (x2 * 100), 640 / (y2 * 100)), 6) AS fit, round((640 - x2 * 100 * least(640 / (x2 * 100), 640 / (y2 * 100))) / 2, 6) AS margin,
  round(CASE WHEN z > 1e-1 THEN (z - 35e-2) * 100 ELSE 999 END, 6) AS delta_cm, (frame - 1) / 30e0 AS t,
  CAST(trunc(greatest(0, least(x1 * 100 - 50, 399))) AS INT) AS ix FROM s""")
def box_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    b = P.points(spark, sf_dir).withColumns({"x1": x, "y1": y, "x2": x + 1 + z * 10, "y2": y + 1 + x / 2})
    b = b.withColumn("a", K.affine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 256))
    b = b.withColumn("l", K.centred_letterbox(F.col("x2") * 100, F.col("y2") * 100, 640))
    return b.select(
        "frame", "seq", F.round("a.scale", 6).alias("scale"), F.round("a.dx", 6).alias("dx"), F.round(K.affine_back(F.lit(100), F.col("a.scale"), F.col("a.dx")), 6).alias("back_x"),
        F.round("l.scale", 6).alias("fit"), F.round("l.left", 6).alias("margin"), F.round(K.touch_delta_cm(z, 0.35), 6).alias("delta_cm"),
        K.frame_time(F.col("frame"), 30.0).alias("t"), K.raster_index(F.col("x1") * 100 - 50, 400).alias("ix"),
    )


def _crop_sql(bw: str, bh: str) -> str:
    ends = [("x1", "greatest(0, CAST(trunc(cx - {w} * 5e-1) AS INT))"), ("y1", "greatest(0, CAST(trunc(cy - {h} * 5e-1) AS INT))")]
    ends += [("x2", "least(640, CAST(trunc(cx + {w} * 5e-1) AS INT))"), ("y2", "least(480, CAST(trunc(cy + {h} * 5e-1) AS INT))")]
    return ", ".join(f"{e.format(w=f'({bw})', h=f'({bh})')} AS {n}" for n, e in ends)


@query(f"""WITH {P.POINTS_SQL}, b AS (SELECT frame, seq, x * 100 AS x, y * 80 AS y, (x * 100 + z * 200) - x * 100 AS w, (y * 80 + x * 60) - y * 80 AS h FROM pt),
a AS (SELECT frame, seq, 'hand' AS kind, x + greatest(10, w) * 5e-1 AS cx, y + greatest(10, h) * 5e-1 AS cy, greatest(greatest(10, w), greatest(10, h)) * 125e-2 AS pw, greatest(greatest(10, w), greatest(10, h)) * 125e-2 AS ph FROM b
  UNION ALL SELECT frame, seq, 'body', x + w * 5e-1, y + h * 5e-1, w * 1.15e0, h * 1.15e0 FROM b),
c AS (SELECT frame, seq, kind, cx, cy, CASE WHEN kind = 'hand' OR pw > ph * 75e-2 THEN pw ELSE ph * 75e-2 END AS bw, CASE WHEN kind = 'body' AND pw > ph * 75e-2 THEN pw / 75e-2 ELSE ph END AS bh FROM a)
SELECT frame, seq, kind, {_crop_sql("bw", "bh")} FROM c""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = F.col("x") * 100, F.col("y") * 80, F.col("z") * 200, F.col("x") * 60
    p = P.points(spark, sf_dir).select("frame", "seq", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    box = (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    kinds = F.array(F.struct(F.lit("hand").alias("kind"), K.hand_crop(*box, 640, 480).alias("c")), F.struct(F.lit("body").alias("kind"), K.body_crop(*box, 640, 480).alias("c")))
    return p.select("frame", "seq", F.explode(kinds).alias("k")).select("frame", "seq", "k.kind", "k.c.*")


@query(f"WITH {P.POINTS_SQL} SELECT frame, seq, round((x - y) * cos(radians(30)), 9) AS ix, round((x + y) * sin(radians(30)) + z, 9) AS iy FROM pt")
def isometric_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.points(spark, sf_dir).withColumn("i", K.isometric(F.col("x"), F.col("y"), F.col("z")))
    return p.select("frame", "seq", F.round("i.x", 9).alias("ix"), F.round("i.y", 9).alias("iy"))


@query(f"""WITH {P.HANDS_SQL}, {P.POINTS_SQL}, k AS (SELECT frame, hand, i AS joint, {_PIXEL} FROM (SELECT frame, hand, unnest(range(21)) AS i, unnest(k) AS j FROM h)),
d AS (SELECT frame % 100 AS raster, u % 24 AS u, v % 16 AS v, z FROM pt WHERE z BETWEEN 1e-1 AND 15e-1)
SELECT k.frame, hand, CAST(joint AS INT) AS joint, k.u, k.v, round(coalesce(median(z), 0), 6) AS z FROM k
LEFT JOIN d ON k.frame % 100 = d.raster AND abs(k.u - d.u) <= 2 AND abs(k.v - d.v) <= 2 GROUP BY k.frame, hand, joint, k.u, k.v""")
def patch_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda c, n: F.abs(c).cast("int") % n
    k = P.hands(spark, sf_dir).select("frame", "hand", F.posexplode("k").alias("joint", "j"))
    k = k.select("frame", "hand", "joint", pixel(F.col("j.x"), 24).alias("u"), pixel(F.col("j.y"), 16).alias("v"), (F.col("frame") % 100).alias("raster"))
    d = P.points(spark, sf_dir).select((F.col("frame") % 100).alias("raster"), (F.col("u") % 24).alias("u"), (F.col("v") % 16).alias("v"), "z")
    return S.patch_depth(k, d, 0.1, 1.5, key=["raster"]).select("frame", "hand", "joint", "u", "v", F.round("z", 6).alias("z"))


@query(f"""WITH {P.POINTS_SQL}, c AS (SELECT frame, avg(y) AS cy, min(z) AS cz FROM pt GROUP BY frame)
SELECT frame, count(*) FILTER (y - cy > -75e-2 AND y - cy < 25e-2) AS around_camera, count(*) FILTER (z - cz BETWEEN 12e-2 AND 145e-2) AS obstacles FROM pt JOIN c USING (frame) GROUP BY frame""")
def height_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.points(spark, sf_dir)
    c = p.groupBy("frame").agg(F.avg("y").alias("cy"), F.min("z").alias("cz"))
    d = p.join(c, "frame")
    near, hit = K.near_camera_height(F.col("y"), F.col("cy")), K.obstacle_height(F.col("z"), F.col("cz"))
    return d.groupBy("frame").agg(F.count_if(near).alias("around_camera"), F.count_if(hit).alias("obstacles"))


@query(f"""WITH {P.HANDS_SQL} SELECT frame, hand, CAST(i AS INT) AS sample, k[i + 1].x AS acc_x, k[i + 1].y AS acc_y, k[i + 1].c AS acc_z FROM h, range(11) r(i)""")
def imu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eleven samples of each frame, one row each."""
    h = P.hands(spark, sf_dir).select("frame", "hand", F.posexplode(F.slice("k", 1, 11)).alias("sample", "s"))
    return h.select("frame", "hand", "sample", F.col("s.x").alias("acc_x"), F.col("s.y").alias("acc_y"), F.col("s.c").alias("acc_z"))


@query(f"""WITH {P.MESSAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY bag, topic, us // 7200000000 ORDER BY us, id) AS n FROM m) SELECT bag, topic, id, us FROM r WHERE n = 1""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rate_limited(P.messages(spark, sf_dir).select("bag", "topic", "id", "us"), 7_200_000_000)


@query("""SELECT CAST(o_custkey % 5 AS INT) AS kind, CASE o_custkey % 5 WHEN 0 THEN 160 WHEN 1 THEN 0 ELSE 0 END AS left0, CASE o_custkey % 5 WHEN 0 THEN 2080 WHEN 1 THEN 1920 ELSE CAST((640 + o_custkey % 5) // 2 AS INT) END AS left1,
  CASE o_custkey % 5 WHEN 0 THEN 2080 WHEN 1 THEN 1920 ELSE CAST((640 + o_custkey % 5) // 2 AS INT) END AS right0, CASE o_custkey % 5 WHEN 0 THEN 4000 WHEN 1 THEN 3840 ELSE CAST(640 + o_custkey % 5 AS INT) END AS right1, count(*) AS n
FROM orders GROUP BY ALL""")
def stereo_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("o_custkey") % 5).cast("int")
    width = F.when(kind == 0, 4000).when(kind == 1, 3840).otherwise(640 + kind)
    o = P.read(spark, sf_dir, "orders").select(kind.alias("kind"), G.stereo_crop(width).alias("c")).select("kind", "c.*")
    return o.groupBy("kind", "left0", "left1", "right0", "right1").agg(F.count("*").alias("n"))


# -- long keys: one recording for each topic ---------------------------------------------------

def _long(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    return side(spark, sf_dir, topic).withColumn("bag", F.lit(0).cast("long"))


def _ranges(spark: SparkSession) -> int:
    """A whole topic is one key here, so it is cut even where it is short."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query(f"""WITH {P.MESSAGES_SQL}, a AS (SELECT id, us FROM m WHERE topic = '{P.LEFT}'), b AS (SELECT DISTINCT us FROM m WHERE topic = '{P.RIGHT}')
SELECT a.id, x.us AS before_us, y.us AS after_us FROM (SELECT * FROM a ASOF LEFT JOIN b x ON a.us >= x.us) a(id, us, before_us)
  LEFT JOIN b x ON x.us = a.before_us ASOF LEFT JOIN b y ON a.us < y.us""")
def asof_long_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.neighbours(_long(spark, sf_dir, P.LEFT), _long(spark, sf_dir, P.RIGHT), ranges=_ranges(spark)).select("id", "before_us", "after_us")


@query(f"""WITH {P.MESSAGES_SQL}, a AS (SELECT id, us FROM m WHERE topic = '{P.LEFT}'), b AS (SELECT us, id FROM m WHERE topic = '{P.RIGHT}'),
u AS (SELECT us, id, 1 AS l, NULL AS r FROM a UNION ALL SELECT us, id, 0, id FROM b),
w AS (SELECT id, l, first_value(r IGNORE NULLS) OVER (ORDER BY us, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS right_id FROM u)
SELECT id AS left_id, right_id FROM w WHERE l = 1 AND right_id IS NOT NULL""")
def next_right_long_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.next_right(_long(spark, sf_dir, P.LEFT), _long(spark, sf_dir, P.RIGHT), ranges=_ranges(spark)).select("left_id", "right_id")
