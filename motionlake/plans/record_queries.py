"""Named queries of depth rasters, touch, exported records and associations, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import geometry as G
from ..functions import pose as J
from ..operators import clouds as C
from ..operators import timeseries as T
from ..operators import touch as H
from ..operators import trajectory as R
from ..sources import datasets as D
from ..sources import recordings as B
from ..streaming import poses as L
from .queries import TOLERANCE_US, clips, detections, query, side

_C = G.MAPPING
SIDE, STRIDE = 8, 2
BUTTONS = (H.Button("record", 0, 0, 20, 40), H.Button("snapshot", 15, 30, 40, 60), H.Button("stop", 30, 0, 50, 35))


# -- depth rasters ----------------------------------------------------------------------------

def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 by 8 disparities with a mask, at the pose of the message that has their number."""
    e = P.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: 1 + F.abs(x.cast("double")) * 20).alias("disparity"),
    )
    mask = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: i * 37 % 256)
    pose = P.poses(spark, sf_dir).withColumn("r", G.rotation(F.lit(0.0), F.lit(0.0), F.col("qz"), F.col("qw")))
    pose = pose.select("id", "r", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    return e.join(pose, "id").withColumn("mask", mask)


@query(f"""WITH {P.POSES_SQL}, i AS (SELECT unnest(range({SIDE * SIDE})) AS i), g AS (SELECT i, i % {SIDE} AS u, i // {SIDE} AS v FROM i),
d AS (SELECT vec_id AS id, u, v, 1 + abs(CAST(embedding[i + 1] AS DOUBLE)) * 20 AS d FROM embeddings, g
  WHERE u % {STRIDE} = 0 AND v % {STRIDE} = 0 AND i * 37 % 256 > 128),
z AS (SELECT *, {_C.fx} * {_C.baseline} / d AS z FROM d WHERE d > 1),
l AS (SELECT *, (u - {_C.cx}) * z / {_C.fx} AS lx, (v - {_C.cy}) * z / {_C.fy} AS ly FROM z WHERE z BETWEEN 1e-1 AND 2e1),
q AS (SELECT id, x, y, z AS pz, qz / sqrt(qz * qz + qw * qw) AS a, qw / sqrt(qz * qz + qw * qw) AS b FROM p)
SELECT id, CAST(u AS INT) AS u, CAST(v AS INT) AS v, round((1 - 2 * a * a) * lx - 2 * a * b * ly + x, 5) AS x,
  round(2 * a * b * lx + (1 - 2 * a * a) * ly + y, 5) AS y, round(z + pz, 5) AS z FROM l JOIN q USING (id)""")
def raster_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.world_cloud(_frames(spark, sf_dir), SIDE, SIDE, STRIDE, 0.1, 20.0)
    return c.select("id", "u", "v", *(F.round(a, 5).alias(a) for a in "xyz"))


# -- bones and buttons ------------------------------------------------------------------------

def _case(rules: list[str], other: str) -> str:
    return "CASE " + " ".join(rules) + f" ELSE '{other}' END"


_HAND = _case([f"WHEN a BETWEEN {x} AND {y} AND (b = 0 OR b BETWEEN {x} AND {y}) THEN '{n}'" for n, (x, y) in J.HAND_PARTS.items()], "palm")
_BODY = _case([f"WHEN a IN {j} AND b IN {j} THEN '{n}'" for n, j in J.BODY_PARTS.items()], "r_leg")


@query(f"""WITH e AS (SELECT o_orderkey, o_custkey % 21 AS a, o_orderkey % 21 AS b FROM orders)
SELECT o_orderkey, {_HAND} AS hand, {_BODY} AS body FROM e""")
def bone_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_custkey") % 21, F.col("o_orderkey") % 21
    return P.read(spark, sf_dir, "orders").select("o_orderkey", J.hand_part(a, b).alias("hand"), J.body_part(a, b).alias("body"))


_BUTTONS_SQL = ", ".join(f"({n}, '{b.name}', {b.x1}, {b.y1}, {b.x2}, {b.y2})" for n, b in enumerate(BUTTONS))


@query(f"""WITH {P.POINTS_SQL}, b(n, name, x1, y1, x2, y2) AS (VALUES {_BUTTONS_SQL}),
h AS (SELECT frame, seq, z, (SELECT arg_min(name, n) FROM b WHERE pt.x * 10 BETWEEN x1 AND x2 AND pt.y * 10 BETWEEN y1 AND y2) AS button FROM pt)
SELECT frame, seq, button, z > 1e-1 AND z <= 35e-2 AS touched FROM h WHERE button IS NOT NULL""")
def button_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = H.first_hit(F.col("x") * 10, F.col("y") * 10, BUTTONS)
    return P.points(spark, sf_dir).select("frame", "seq", hit.alias("button"), J.touching(F.col("z")).alias("touched")).filter("button IS NOT NULL")


@query()
def touch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")[8]
    tips = P.hands(spark, sf_dir).select(
        *clips(F.col("frame")), F.col("hand").alias("det"), F.col("hand").alias("track"), (F.abs(k["x"]) * 4).alias("u"), (F.abs(k["y"]) * 4).alias("v"),
        (0.1 + F.abs(k["x"]) / 100).alias("z"), k["c"].alias("c"), F.abs(k["x"]).alias("px"), F.abs(k["y"]).alias("py"),
    )
    return H.touch_events(tips, BUTTONS)


@query()
def hand_pose_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hand_poses(detections(spark, sf_dir))


@query()
def body_pose_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_poses(detections(spark, sf_dir).withColumn("k", F.slice("k", 1, 17)))


# -- records ----------------------------------------------------------------------------------

@query(f"""WITH {P.HANDS_SQL}, j AS (SELECT frame, hand, i, k[i + 1] AS j FROM h, range(21) r(i)),
s AS (SELECT DISTINCT frame, hand, i FROM (SELECT DISTINCT frame FROM h), range(2) a(hand), range(21) b(i))
SELECT s.frame, CAST(s.hand AS INT) AS hand, CAST(s.i AS INT) AS joint, coalesce(j.x, 0) AS x, coalesce(j.y, 0) AS y, coalesce(j.c, 0) AS c
FROM s LEFT JOIN j ON j.frame = s.frame AND j.hand = s.hand AND j.i = s.i""")
def tensor_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by two hands by 21 joints, zeros where a hand is missing."""
    hands = P.hands(spark, sf_dir).filter("hand < 2").groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("hand", "k"))).alias("m"))
    h = hands.select("frame", "m", F.explode(F.array(F.lit(0), F.lit(1))).alias("hand")).select("frame", "hand", F.try_element_at("m", F.col("hand")).alias("k"))
    j = h.select("frame", "hand", "k", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint"))
    at = F.get("k", F.col("joint"))
    return j.select("frame", "hand", "joint", *(F.coalesce(at[c], F.lit(0.0)).alias(c) for c in "xyc"))


@query(f"""WITH {P.HANDS_SQL}, d AS (SELECT frame, hand, score, k, 1 + k[5].x / 100 AS a, 1 + k[9].x / 100 AS b FROM h)
SELECT frame, hand, round(score, 6) AS score, round(k[1].x, 6) AS wrist_x, len(k) AS joints,
  round(CASE WHEN a > 1e-1 AND b > 1e-1 THEN sqrt((k[5].x - k[9].x) * (k[5].x - k[9].x) + (k[5].y - k[9].y) * (k[5].y - k[9].y) + (a - b) * (a - b)) * 100
    ELSE -1 END, 6) AS gap_cm FROM d""")
def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON record of each frame, read again."""
    k = F.transform("k", lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y"), (1 + j["x"] / 100).alias("z"), j["c"].alias("c")))
    box = {n: F.lit(v) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 9.0), ("y2", 9.0))}
    written = D.frame_records(P.hands(spark, sf_dir).withColumns({"k": k} | box))
    read = written.select("frame", F.explode(F.from_json("value", D.RECORD)["hands"]).alias("r"))
    return read.select(
        "frame", F.col("r.hand_index").alias("hand"), F.round("r.det_score", 6).alias("score"), F.round(F.col("r.wrist_3d_m")[0], 6).alias("wrist_x"),
        F.size("r.keypoints_3d_xyz_conf").cast("long").alias("joints"), F.round("r.pinch_gap_cm", 6).alias("gap_cm"),
    )


_TOPIC = "'  - topic_metadata:\n      name: ''' || topic || '''\n      type: ''raw''\n      serialization_format: ''cdr''\n      offered_qos_profiles: ''''\n    message_count: '"


@query(f"""WITH {P.MESSAGES_SQL}, t AS (SELECT DISTINCT topic FROM m), b AS (SELECT bag, count(*) AS n, min(us) * 1000 AS a, (max(us) - min(us)) * 1000 AS l FROM m GROUP BY bag),
c AS (SELECT bag, topic, count(*) AS n FROM m GROUP BY bag, topic),
s AS (SELECT b.bag, string_agg({_TOPIC} || coalesce(c.n, 0) || '\n', '' ORDER BY topic) AS s FROM b CROSS JOIN t LEFT JOIN c USING (bag, topic) GROUP BY b.bag)
SELECT bag, 'rosbag2_bagfile_information:\n  version: 5\n  storage_identifier: sqlite3\n  duration:\n    nanoseconds: ' || l
  || '\n  starting_time:\n    nanoseconds_since_epoch: ' || a || '\n  message_count: ' || n || '\n  topics_with_message_count:\n' || s
  || '  compression_format: ''''\n  compression_mode: ''''\n  relative_file_paths:\n  - ''' || bag || '.db3''\n  files:\n  - path: ''' || bag
  || '.db3''\n    starting_time:\n      nanoseconds_since_epoch: ' || a || '\n    duration:\n      nanoseconds: ' || l || '\n    message_count: ' || n || '\n' AS value
FROM b JOIN s USING (bag)""")
def bag_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.messages(spark, sf_dir)
    topics = m.select("topic").distinct().select("topic", F.lit("raw").alias("type"), F.lit("cdr").alias("format"), F.lit("").alias("qos"))
    return B.metadata(m, topics)


@query(f"""WITH {P.POINTS_SQL} SELECT frame, count(*) AS messages, count(*) FILTER (u <> v) AS changed, CAST(sum(u) AS BIGINT) AS steps FROM pt GROUP BY frame""")
def step_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a width and another row length, mended and read again."""
    number = lambda c: F.concat(*(F.substring(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), 4 - i, 1) for i in range(4)))
    name = F.concat(F.unhex(F.lit("06000000")), F.lit("mono8").cast("binary"), F.unhex(F.lit("000000")))
    data = F.concat(F.unhex(F.lit("0001000058020000")), number(F.col("u")), name, number(F.col("v")))
    m = P.points(spark, sf_dir).select("frame", F.lit("left").alias("topic"), data.alias("data"))
    d = B.patched(m, ["left"]).withColumn("step", B.little_endian(F.col("data"), 24))
    return d.groupBy("frame").agg(F.count("*").alias("messages"), F.count_if("changed").alias("changed"), F.sum("step").alias("steps"))


@query(f"""WITH {P.POSES_SQL} SELECT bag, count(*) AS n, round(CASE WHEN max(us) > min(us) THEN (count(*) - 1) / ((max(us) - min(us)) / 1e6) END, 9) AS rate_hz,
round(avg(sqrt(x * x + y * y + z * z)), 6) AS gravity FROM p GROUP BY bag""")
def imu_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.imu_rest(P.poses(spark, sf_dir)).withColumns({"rate_hz": F.round("rate_hz", 9), "gravity": F.round("gravity", 6)})


@query(f"""WITH {P.MESSAGES_SQL}, d AS (SELECT bag * 100000 + us // 86400000000 AS run, topic FROM m), a AS (SELECT * FROM d WHERE topic = '{P.LEFT}'),
t AS (SELECT * FROM a UNION ALL SELECT * FROM d WHERE topic = '{P.RIGHT}' AND run NOT IN (SELECT run FROM a)),
s AS (SELECT run, count(*) AS events FROM d WHERE topic = '{P.IMU}' GROUP BY run)
SELECT run, topic, n, events FROM (SELECT run, topic, count(*) AS n FROM t GROUP BY run, topic) LEFT JOIN s USING (run)""")
def run_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better trajectory of each recording's day, else the other one, with a summary where there is one."""
    d = P.messages(spark, sf_dir).select((F.col("bag") * 100000 + F.expr("us div 86400000000")).alias("run"), "topic")
    best = D.preferred(d.filter(F.col("topic") == P.LEFT), d.filter(F.col("topic") == P.RIGHT), "run")
    summary = d.filter(F.col("topic") == P.IMU).groupBy("run").agg(F.count("*").alias("events"))
    return best.groupBy("run", "topic").agg(F.count("*").alias("n")).join(summary, "run", "left")


# -- associations -----------------------------------------------------------------------------

@query(f"""WITH {P.MESSAGES_SQL}, a AS (SELECT bag, us FROM m WHERE topic = '{P.LEFT}'), b AS (SELECT bag, us FROM m WHERE topic = '{P.IMU}'),
n AS (SELECT bag, coalesce(x.n, 0) >= coalesce(y.n, 0) AS second FROM (SELECT bag, count(*) AS n FROM a GROUP BY bag) x
  FULL JOIN (SELECT bag, count(*) AS n FROM b GROUP BY bag) y USING (bag)),
s AS (SELECT bag, us, second FROM a JOIN n USING (bag) WHERE NOT second UNION ALL SELECT bag, us, second FROM b JOIN n USING (bag) WHERE second),
l AS (SELECT bag, us FROM a JOIN n USING (bag) WHERE second UNION ALL SELECT bag, us FROM b JOIN n USING (bag) WHERE NOT second),
x AS (SELECT s.*, l.us AS low FROM s ASOF LEFT JOIN l ON s.bag = l.bag AND s.us >= l.us),
y AS (SELECT x.*, l.us AS high FROM x ASOF LEFT JOIN l ON x.bag = l.bag AND x.us < l.us),
k AS (SELECT bag, us, second, CASE WHEN low IS NULL OR high - us < us - low THEN high ELSE low END AS near FROM y)
SELECT bag, CASE WHEN second THEN near ELSE us END AS first_us, CASE WHEN second THEN us ELSE near END AS second_us FROM k WHERE abs(near - us) <= {TOLERANCE_US}""")
def association_by_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.associated(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.IMU), TOLERANCE_US)


@query(f"""WITH {P.MESSAGES_SQL} SELECT l.bag, l.id AS left_id, r.id AS right_id FROM m l JOIN m r ON l.bag = r.bag
WHERE l.topic = '{P.LEFT}' AND r.topic = '{P.RIGHT}' AND abs(l.us - r.us) <= 3600000000""")
def time_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = lambda t: side(spark, sf_dir, t).select("bag", "id", F.timestamp_micros("us").alias("ts"))
    return T.time_synced(timed(P.LEFT), timed(P.RIGHT), "1 hour", "1 day").select("bag", "left_id", "right_id")


def turned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against itself a little disturbed, with the rotations of both."""
    p = P.poses(spark, sf_dir)
    zero, off = F.lit(0.0), (F.col("seq") % 3).cast("double") / 100
    return p.select(
        "bag", "seq", *(F.col(c).alias(f"p{c}") for c in "xyz"), G.rotation(zero, zero, F.col("qz"), F.col("qw")).alias("pr"),
        (F.col("x") + off).alias("qx"), F.col("y").alias("qy"), (F.col("z") - off).alias("qz"), G.rotation(zero, off, F.col("qz"), F.col("qw")).alias("qr"),
    )


@query()
def relative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relative_errors(turned_pairs(spark, sf_dir), 2.0)


@query()
def turn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turn_errors(turned_pairs(spark, sf_dir)).select("bag", "seq", "angle")
