"""Named queries of picture pairs, lines on grids, colours, markers and smoothed joints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import colours as K
from ..functions import geometry as G
from ..operators import markers as M
from ..operators import pairing as A
from ..operators import spatial as S
from ..streaming import joints as N
from .queries import TOLERANCE_US, _rays, clips, query, side


def _exact(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


_SIDES = f"WITH {P.MESSAGES_SQL}, l AS (SELECT * FROM m WHERE topic = 'view'), r AS (SELECT * FROM m WHERE topic = 'click'), q AS (SELECT * FROM m WHERE topic = 'error')"


@query(_SIDES + f""", a AS (SELECT l.bag, l.id, l.us, arg_min(q.id, (q.us, q.id)) FILTER (q.id IS NOT NULL) AS pose_id FROM l LEFT JOIN q ON q.bag = l.bag AND abs(q.us - l.us) <= {TOLERANCE_US} GROUP BY l.bag, l.id, l.us),
h AS (SELECT r.bag, r.id AS right_id, r.us AS right_us, arg_max(a.id, (a.us, a.id)) AS left_id FROM r JOIN a ON a.bag = r.bag AND (a.us < r.us OR (a.us = r.us AND a.id < r.id)) GROUP BY r.bag, r.id, r.us),
p AS (SELECT h.*, pose_id, row_number() OVER (PARTITION BY h.bag, left_id ORDER BY right_us, right_id) AS k FROM h JOIN a ON a.bag = h.bag AND a.id = h.left_id WHERE pose_id IS NOT NULL AND right_us - a.us <= {TOLERANCE_US})
SELECT bag, left_id, right_id, pose_id FROM p WHERE k = 1""")
def stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stereo_pairs(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.RIGHT), side(spark, sf_dir, P.IMU), TOLERANCE_US, TOLERANCE_US)


@query(_SIDES + """, n AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY us, id) AS position FROM l)
SELECT n.bag, CAST(position AS INT) AS position, n.id AS left_id, arg_min(r.id, (r.us, r.id)) AS right_id FROM n JOIN r ON r.bag = n.bag AND (r.us > n.us OR (r.us = n.us AND r.id > n.id)) GROUP BY n.bag, position, n.id""")
def next_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.next_right(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.RIGHT))


@query(f"""WITH {P.POINTS_SQL}, y AS (SELECT DISTINCT CAST(frame % 40 AS INT) AS ax, CAST(frame % 31 AS INT) AS ay, CAST(trunc(x / 0.05) AS INT) AS bx, CAST(trunc(y / 0.05) AS INT) AS by_ FROM pt),
s AS (SELECT least(ax, bx) AS x0, CASE WHEN bx < ax THEN by_ ELSE ay END AS y0, abs(bx - ax) AS w, CASE WHEN bx < ax THEN ay - by_ ELSE by_ - ay END AS rise FROM y),
i AS (SELECT *, greatest(w, abs(rise)) AS n, unnest(range(greatest(w, abs(rise)) + 1)) AS i FROM s),
o AS (SELECT *, CASE WHEN n > 0 THEN (2 * i * least(w, abs(rise)) + n - 1) // (2 * n) ELSE 0 END AS o FROM i)
SELECT DISTINCT CAST(x0 + CASE WHEN abs(rise) > w THEN o ELSE i END AS INT) AS gx, CAST(y0 + sign(rise) * CASE WHEN abs(rise) > w THEN i ELSE o END AS INT) AS gy FROM o""")
def line_free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_cells(_rays(spark, sf_dir)[1])


@query(f"""WITH {P.POINTS_SQL}, b AS (SELECT quantile_cont(-y, 0.02) AS low, quantile_cont(-y, 0.98) AS high FROM pt)
SELECT frame, seq, round(least(1.0, greatest(0.0, (-y - low) / (high - low + 1e-5))), 6) AS level, CAST(trunc(least(1.0, greatest(0.0, (5.0 - z) / 4.5)) * 255) AS INT) AS colour FROM pt, b""")
def elevation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.elevation(P.points(spark, sf_dir), -F.col("y"))
    return p.select("frame", "seq", F.round("level", 6).alias("level"), K.ramp_index(F.col("z"), 0.5, 5.0).alias("colour"))


def _shade(c: str) -> str:
    return f"abs(CASE WHEN lag({c}) OVER w IS NULL THEN coalesce(lead({c}) OVER w - {c}, 0.0) WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END) AS g{c}"


_LIT = " + ".join(f"g{c} / l * {_exact(v)}" for c, v in zip("xyz", K.light()))
_MIX = ", ".join(f"CAST(trunc(least(255.0, greatest(0.0, gray * d * {_exact(gain)} + {offset}))) AS INT) AS {c}" for c, gain, offset in K.CHANNELS)


@query(f"""WITH {P.POINTS_SQL}, g AS (SELECT frame, seq, CAST(u % 256 AS DOUBLE) AS gray, {", ".join(map(_shade, "xyz"))} FROM pt WINDOW w AS (PARTITION BY frame ORDER BY seq, x, y, z)),
s AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) + 1e-5 AS l FROM g), t AS (SELECT *, least(CAST(1 AS DOUBLE), greatest({_exact(0.2)}, {_LIT})) AS d FROM s) SELECT frame, seq, {_MIX} FROM t""")
def surface_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.shaded(P.points(spark, sf_dir), (F.col("u") % 256).cast("double")).select("frame", "seq", "r", "g", "b")


@query(f"""WITH {P.POSES_SQL}, n AS (SELECT bag, seq, greatest(1, count(*) OVER (PARTITION BY bag) // 30) AS step FROM p)
SELECT bag, seq, seq % (5 * step) = 0 AS marked FROM n WHERE seq % step = 0""")
def path_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.path_markers(P.poses(spark, sf_dir), keep=30).select("bag", "seq", "marked")


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands whose joints have a depth about one metre away."""
    k = F.transform("k", lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y"), (1 + j["x"] / 100).alias("z"), j["c"].alias("c")))
    return P.hands(spark, sf_dir).withColumn("k", k)


_CHAINS_SQL = ", ".join(str([j + 1 for j in chain]) for chain in M.CHAINS)


@query(f"""WITH {P.HANDS_SQL}, j AS (SELECT frame, hand, list_transform(k, lambda j: 1 + j.x / 100 > 0.1 AND j.c > 0.25) AS s FROM h),
e AS (SELECT frame, hand, 0 AS rank, i AS place, 1 AS n FROM (SELECT frame, hand, s, unnest(range(21)) AS i FROM j) WHERE s[i + 1]
  UNION ALL SELECT frame, hand, 1, i, n FROM (SELECT frame, hand, i, len(list_filter([{_CHAINS_SQL}][i + 1], lambda x: s[x])) AS n FROM (SELECT frame, hand, s, unnest(range(5)) AS i FROM j)) WHERE n >= 2)
SELECT frame, 'hand_' || hand || CASE rank WHEN 0 THEN '_joints' ELSE '_bones' END AS ns, CAST(row_number() OVER (PARTITION BY frame ORDER BY hand, rank, place) - 1 AS INT) AS id, CASE rank WHEN 0 THEN 'SPHERE' ELSE 'LINE_STRIP' END AS type, CAST(n AS INT) AS points FROM e""")
def joint_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.joint_markers(_deep(spark, sf_dir)).withColumn("points", F.size("points"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir).select(*clips(F.col("frame")), F.col("hand").alias("track"), "k")


@query()
def hand_joints_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.smoothed_joints(_tracks(spark, sf_dir))


@query()
def body_joints_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.smoothed_joints(_tracks(spark, sf_dir).withColumn("k", F.slice("k", 1, 17)), N.body)


@query(f"""WITH {P.POINTS_SQL} SELECT seq, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, (CAST(u % 256 AS INT) << 16) | (CAST(v % 256 AS INT) << 8) | CAST(u % 7 AS INT) AS rgb FROM pt""")
def packed_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.points(spark, sf_dir)
    return p.select("seq", *(F.col(c).cast("float").alias(c) for c in "xyz"), G.packed_rgb(F.col("u") % 256, F.col("v") % 256, F.col("u") % 7).alias("rgb"))
