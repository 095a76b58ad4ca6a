"""Queries that write recordings and whole files and read them back, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import shutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import geometry as G
from ..functions import pose as J
from ..operators import neighbours as N
from ..operators import spatial as S
from ..operators import timeseries as T
from ..operators import trajectory as R
from ..sources import bags as B
from ..sources import datasets as D
from ..sources import files, recordings, whole
from ..storage import cut, shared_path
from .queries import _NEAR, _STEP, query, r6, side

EMPTY = "never"


def _there_and_back(spark: SparkSession, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` makes of a new folder of its own, kept; the folder goes."""
    folder = shared_path(spark, name)
    try:
        return cut(read(folder))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _name() -> Column:
    """The recording's number, from the path of its file."""
    return B.stem(F.col("bag")).cast("long")


def _written(spark: SparkSession, sf_dir: str, folder: str) -> None:
    m = P.messages(spark, sf_dir)
    topics = m.select("topic").distinct().unionByName(spark.createDataFrame([(EMPTY,)], "topic string"))
    kinds = topics.withColumns({"type": F.concat(F.lit("kind/"), "topic"), "qos": F.concat(F.lit("depth: "), F.length("topic"))})
    bags = m.select("bag").distinct()
    B.write_recordings(m, folder, topics=bags.crossJoin(F.broadcast(kinds)), schema=bags.select("bag", F.lit(3).alias("schema_version"), F.lit("none").alias("distro")))


@query(f"""WITH {P.MESSAGES_SQL}, e AS (SELECT min(us) AS a, max(us) AS b FROM m)
SELECT bag, topic, 'kind/' || topic AS type, us, CAST(strlen(data) AS INT) AS bytes FROM m, e WHERE topic IN ('view', 'click') AND us >= a + (b - a) // 4 AND us < a + (b - a) // 2""")
def recording_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of all messages, read through filters on topic and time."""
    a, b = P.messages(spark, sf_dir).agg(F.min("us"), F.max("us")).first()
    a, b = a or 0, b or 0

    def read(folder: str) -> DataFrame:
        _written(spark, sf_dir, folder)
        rows = spark.read.format("recording").load(folder).filter(F.col("topic").isin("view", "click") & (F.col("us") >= a + (b - a) // 4) & (F.col("us") < a + (b - a) // 2))
        return rows.select(_name().alias("bag"), "topic", "type", "us", F.length("data").alias("bytes"))

    return _there_and_back(spark, "recordings", read)


@query(f"""WITH {P.MESSAGES_SQL}, t AS (SELECT DISTINCT topic FROM m UNION ALL SELECT '{EMPTY}'), b AS (SELECT bag, count(*) AS messages, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY bag)
SELECT bag, topic, 'kind/' || topic AS type, 'cdr' AS format, 'depth: ' || length(topic) AS qos, CAST(3 AS BIGINT) AS schema_version, messages, first_us, last_us FROM b, t""")
def recording_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of recordings, also those without messages, with the schema's version and the range of each file."""

    def read(folder: str) -> DataFrame:
        _written(spark, sf_dir, folder)
        table = lambda name: spark.read.format("recording").option("table", name).load(folder)
        own = table("topics").drop("id").join(table("schema").select("bag", "schema_version"), "bag").join(table("files").drop("path"), "bag")
        return own.withColumn("bag", _name()).select("bag", "topic", "type", "format", "qos", "schema_version", "messages", "first_us", "last_us")

    return _there_and_back(spark, "recordings", read)


@query(f"""WITH {P.POINTS_SQL} SELECT frame // 500 AS bag, seq AS us, CAST(u AS BIGINT) AS step, count(*) AS n FROM pt GROUP BY ALL""")
def recording_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of pictures whose row lengths are wrong, mended in place."""
    number = lambda c: F.concat(*(F.substring(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), 4 - i, 1) for i in range(4)))
    name = F.concat(F.unhex(F.lit("06000000")), F.lit("mono8").cast("binary"), F.unhex(F.lit("000000")))
    data = F.concat(F.unhex(F.lit("0001000058020000")), number(F.col("u")), name, number(F.col("v")))
    p = P.points(spark, sf_dir).select(F.expr("frame div 500").alias("bag"), F.col("seq").alias("id"), F.lit("left").alias("topic"), F.col("seq").alias("us"), data.alias("data"))

    def read(folder: str) -> DataFrame:
        B.write_recordings(p, folder)
        recordings.patch_recordings(spark, folder, ["left"])
        rows = spark.read.format("recording").load(folder)
        return rows.select(_name().alias("bag"), "us", recordings.little_endian(F.col("data"), 24).alias("step")).groupBy("bag", "us", "step").agg(F.count("*").alias("n"))

    return _there_and_back(spark, "recordings", read)


_ORDER = ["seq", "x", "y", "z", "red", "green"]


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.points(spark, sf_dir)
    return p.select("seq", "x", "y", "z", (F.col("u") % 256).alias("red"), (F.col("v") % 256).alias("green"), F.lit(7).alias("blue"), F.lit(0.5).alias("nx"), F.col("z").alias("ny"), F.lit(0.0).alias("nz"), F.lit(None).cast("double").alias("curvature"))


def _cloud_sql(number: str) -> str:
    return f"""WITH {P.POINTS_SQL}, c AS (SELECT seq, x, y, z, CAST(u % 256 AS INT) AS red, CAST(v % 256 AS INT) AS green FROM pt)
SELECT row_number() OVER (ORDER BY seq, x, y, z, red, green) - 1 AS seq, {', '.join(f"{number.format(c)} AS {c}" for c in "xyz")}, red, green, CAST(7 AS INT) AS blue FROM c"""


@query(_cloud_sql("CAST(CAST({} AS FLOAT) AS DOUBLE)"))
def cloud_file_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud with normals in one little-endian file."""

    def read(folder: str) -> DataFrame:
        whole.write_ply(_cloud(spark, sf_dir), f"{folder}/c.ply", _ORDER, binary=True)
        return files.read_ply(spark, f"{folder}/c.ply").drop("path")

    return _there_and_back(spark, "cloud", read)


@query(_cloud_sql("floor({} * 1000) / 1000"))
def cloud_file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud, cut to whole thousandths, in one file of lines."""

    def read(folder: str) -> DataFrame:
        cloud = _cloud(spark, sf_dir).drop("nx")
        whole.write_ply(cloud.withColumns({f"_{c}": F.col(c) for c in "xyz"} | {c: F.floor(F.col(c) * 1000) / 1000 for c in "xyz"}), f"{folder}/c.ply", [f"_{c}" if c in "xyz" else c for c in _ORDER])
        return files.read_ply(spark, f"{folder}/c.ply").drop("path")

    return _there_and_back(spark, "cloud", read)


@query(f"""WITH {P.POINTS_SQL}, c AS (SELECT CAST(u % 64 AS INT) AS gx, CAST(v % 48 AS INT) AS gy, count(*) AS n FROM pt GROUP BY ALL)
SELECT gx, gy, CASE WHEN n % 2 = 0 THEN 'OCCUPIED' ELSE 'FREE' END AS state, round((gx + 5e-1) * 5e-2 - 1, 6) AS x, round((gy + 5e-1) * 5e-2 + 25e-1, 6) AS y FROM c""")
def map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid as picture and description, with the cells' places in the world."""
    c = P.points(spark, sf_dir).groupBy((F.col("u") % 64).alias("gx"), (F.col("v") % 48).alias("gy")).agg(F.count("*").alias("n"))
    cells = c.select("gx", "gy", F.when(F.col("n") % 2 == 0, "OCCUPIED").otherwise("FREE").alias("state"))

    def read(folder: str) -> DataFrame:
        whole.write_map(cells, f"{folder}/m", 64, 48, 0.05, (-1.0, 2.5))
        return whole.read_map(spark, f"{folder}/m.yaml").drop("path").withColumns(r6("x", "y"))

    return _there_and_back(spark, "map", read)


@query(f"""WITH {P.HANDS_SQL}, s AS (SELECT frame, hand, unnest(k) AS j, unnest(range(21)) AS i FROM h),
a AS (SELECT frame, hand, i, unnest([j.x, j.y, j.c]) AS value, unnest(range(3)) AS axis FROM s)
SELECT row_number() OVER (ORDER BY frame, hand, i, axis) - 1 AS at, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM a""".replace(" AS at,", ' AS "at",'))
def tensor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All joints as one array file of frames by 2 by 21 by 3."""
    j = P.hands(spark, sf_dir).select("frame", "hand", F.posexplode("k").alias("joint", "j")).select("frame", "hand", "joint", "j.x", "j.y", "j.c")

    def read(folder: str) -> DataFrame:
        whole.write_npy(j, f"{folder}/t.npy", ["frame", "hand", "joint"], ["x", "y", "c"], (2, 21, 3))
        return files.read_npy(spark, f"{folder}/t.npy", 1 << 16).withColumn("value", F.round("value", 4))

    return _there_and_back(spark, "tensor", read)


@query(f"""WITH {P.HANDS_SQL} SELECT frame, hand, round(score, 6) AS score, round(k[1].x, 6) AS wrist_x, len(k) AS joints, 'hands' AS dataset_name, CAST(960 AS BIGINT) AS width FROM h""")
def dataset_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set as one document with its head, read again."""
    k = F.transform("k", lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y"), (1 + j["x"] / 100).alias("z"), j["c"].alias("c")))
    box = {n: F.lit(v) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 9.0), ("y2", 9.0))}
    head = whole.document_head("hands", "2026-01-01 00:00:00", G.MAPPING, 960, 600, "optical", "21 joints")

    def read(folder: str) -> DataFrame:
        whole.write_document(D.frame_records(P.hands(spark, sf_dir).withColumns({"k": k} | box)), f"{folder}/d.json", head)
        schema = f"dataset_name string, camera_intrinsics struct<resolution: array<long>>, frames array<struct<{D.RECORD.replace('frame_index long', 'frame_index: long').replace('hands array', 'hands: array')}>>"
        d = spark.read.json(f"{folder}/d.json", schema, multiLine=True).select("dataset_name", F.col("camera_intrinsics.resolution")[0].alias("width"), F.explode("frames").alias("f"))
        d = d.select("dataset_name", "width", F.col("f.frame_index").alias("frame"), F.explode("f.hands").alias("r"))
        return d.select(
            "frame", F.col("r.hand_index").alias("hand"), F.round("r.det_score", 6).alias("score"), F.round(F.col("r.wrist_3d_m")[0], 6).alias("wrist_x"),
            F.size("r.keypoints_3d_xyz_conf").alias("joints"), "dataset_name", "width",
        )

    return _there_and_back(spark, "document", read)


# -- bones, axes and second forms ------------------------------------------------------------

_BONES_SQL = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(J.HAND_BONES))


@query(f"""WITH {P.HANDS_SQL}, b(bone, a, b) AS (VALUES {_BONES_SQL})
SELECT frame, hand, bone, CASE WHEN a BETWEEN 1 AND 4 AND (b BETWEEN 1 AND 4 OR b = 0) THEN 'thumb' WHEN a BETWEEN 5 AND 8 AND (b BETWEEN 5 AND 8 OR b = 0) THEN 'index'
  WHEN a BETWEEN 9 AND 12 AND (b BETWEEN 9 AND 12 OR b = 0) THEN 'middle' WHEN a BETWEEN 13 AND 16 AND (b BETWEEN 13 AND 16 OR b = 0) THEN 'ring'
  WHEN a BETWEEN 17 AND 20 AND (b BETWEEN 17 AND 20 OR b = 0) THEN 'pinky' ELSE 'palm' END AS part, k[a + 1].x AS ax, k[a + 1].y AS ay, k[b + 1].x AS bx, k[b + 1].y AS by_
FROM h, b WHERE k[a + 1].c > 25e-2 AND k[b + 1].c > 25e-2""")
def hand_bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.bone_segments(P.hands(spark, sf_dir), J.bone_table(spark), ["frame", "hand"]).withColumnRenamed("by", "by_")


@query(f"""WITH {P.HANDS_SQL}, b(bone, a, b) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(J.BODY_BONES))})
SELECT frame, hand, count(*) AS bones, round(sum(sqrt((k[a + 1].x - k[b + 1].x) ** 2 + (k[a + 1].y - k[b + 1].y) ** 2)), 6) AS length
FROM h, b WHERE k[a + 1].c > 25e-2 AND k[b + 1].c > 25e-2 GROUP BY frame, hand""")
def body_bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = J.bone_segments(P.hands(spark, sf_dir), J.bone_table(spark, J.BODY_BONES, J.body_part), ["frame", "hand"])
    length = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return s.groupBy("frame", "hand").agg(F.count("*").alias("bones"), F.round(F.sum(length), 6).alias("length"))


@query(f"""WITH {P.POSES_SQL}, w AS (SELECT bag, var_samp(x) AS va, covar_samp(x, y) AS vb, var_samp(y) AS vc FROM p GROUP BY bag HAVING count(*) > 1),
q AS (SELECT p.bag, seq, x * cos(5e-1 * atan2(2 * vb, va - vc)) + y * sin(5e-1 * atan2(2 * vb, va - vc)) AS along FROM p JOIN w USING (bag)),
e AS (SELECT bag, arg_max(along, seq) < arg_min(along, seq) AS back FROM q GROUP BY bag)
SELECT bag, seq, round(CASE WHEN back THEN -along ELSE along END, 5) + 0 AS along FROM q JOIN e USING (bag)""")
def axis_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.along_axis(P.poses(spark, sf_dir)).select("bag", "seq", F.round("along", 5).alias("along"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, e[1:32] AS a, e[33:64] AS b FROM e)
SELECT vec_id, round(10 + (list_position(a, list_max(a)) - 1) / CAST(32 AS DOUBLE) * 64, 6) AS u, round(20 + (list_position(b, list_max(b)) - 1) / CAST(32 AS DOUBLE) * 48, 6) AS v,
  round(list_max(a) * list_max(b), 6) AS c, round(CAST(366.6111 AS DOUBLE) * CAST(0.0624 AS DOUBLE) / greatest(list_max(a) * 4, CAST(0.5 AS DOUBLE)), 6) AS z FROM s""")
def simcc_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of two axes as places in a crop, with the product of both as trust; depth of a disparity that is held up."""
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = F.slice("e", 1, 32), F.slice("e", 33, 32)
    found = J.simcc_in_crop(a, b, F.lit(10), F.lit(20), F.lit(64), F.lit(48))
    d = e.select("vec_id", found.alias("j"), G.depth_clamped(F.array_max(a) * 4).alias("z"))
    return d.select("vec_id", F.round("j.u", 6).alias("u"), F.round("j.v", 6).alias("v"), F.round("j.c", 6).alias("c"), F.round("z", 6).alias("z"))


@query(f"""WITH {P.POSES_SQL}, t AS (SELECT p.*, topic FROM p JOIN m USING (id)), k AS (SELECT * FROM t WHERE topic = '{P.LEFT}'), a AS (SELECT * FROM t WHERE topic <> '{P.LEFT}'),
d AS (SELECT a.id, k.id AS other, (a.x - k.x) * (a.x - k.x) + (a.y - k.y) * (a.y - k.y) + (a.z - k.z) * (a.z - k.z) AS d2 FROM a, k),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM d)
SELECT id, CAST(rank AS INT) AS rank, other, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 3""")
def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest poses of one topic for each pose of the others."""
    p = P.poses(spark, sf_dir).join(P.messages(spark, sf_dir).select("id", "topic"), "id")
    found = N.nearest_k(p.filter(F.col("topic") != P.LEFT), p.filter(F.col("topic") == P.LEFT), 3)
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH {P.POINTS_SQL}, {P.POSES_SQL}, q AS (SELECT DISTINCT x, y FROM p), f AS (SELECT frame, seq, x * 40 - 60 AS x, y * 40 - 60 AS y FROM pt)
SELECT frame, seq FROM f WHERE NOT EXISTS (SELECT 1 FROM q WHERE (f.x - q.x) * (f.x - q.x) + (f.y - q.y) * (f.y - q.y) < 0.25)""")
def far_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a wide cloud that no pose is near."""
    wide = P.points(spark, sf_dir).withColumns({c: F.col(c) * 40 - 60 for c in "xy"})
    return S.far_from(wide, P.poses(spark, sf_dir)).select("frame", "seq")


@query(_NEAR + """ SELECT bag, count(*) AS n, round(avg(near_us - us), 3) AS mean_us, min(near_us - us) AS least_us, max(near_us - us) AS most_us,
  arg_max(near_us - us, (us, id)) - arg_min(near_us - us, (us, id)) AS drift_us FROM k WHERE near_us IS NOT NULL GROUP BY bag""")
def sync_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest message of another topic is, on average, at the ends, and how that drifts."""
    near = T.nearest(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.IMU))
    o, at = F.col("offset_us"), F.struct("us", "id")
    return near.groupBy("bag").agg(
        F.count("*").alias("n"), F.round(F.avg(o), 3).alias("mean_us"), F.min(o).alias("least_us"), F.max(o).alias("most_us"), (F.max_by(o, at) - F.min_by(o, at)).alias("drift_us"),
    )


@query(f"""WITH {P.MESSAGES_SQL}, d AS (SELECT bag, topic, us, id, us - lag(us) OVER (PARTITION BY bag, topic ORDER BY us, id) AS dt FROM m),
r AS (SELECT *, avg(dt) OVER (PARTITION BY bag, topic ORDER BY us, id ROWS 29 PRECEDING) AS mean30 FROM d)
SELECT bag, topic, count(dt) AS n, round(avg(dt), 2) AS mean_us, min(dt) AS least_us, max(dt) AS most_us, round(arg_max(mean30, (us, id)), 2) AS last30_us FROM r GROUP BY bag, topic""")
def interval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times between messages: mean, least, greatest, and the mean of the last thirty."""
    w = T.ordered("bag", "topic")
    d = P.messages(spark, sf_dir).withColumn("dt", F.col("us") - F.lag("us").over(w))
    d = d.withColumn("mean30", F.avg("dt").over(w.rowsBetween(-29, 0)))
    dt = F.col("dt")
    return d.groupBy("bag", "topic").agg(
        F.count(dt).alias("n"), F.round(F.avg(dt), 2).alias("mean_us"), F.min(dt).alias("least_us"), F.max(dt).alias("most_us"), F.round(F.max_by("mean30", F.struct("us", "id")), 2).alias("last30_us"),
    )


@query(_STEP + """ SELECT bag, round_even(coalesce(sum(step), 0.0), 3) AS length_m, round_even(max(ts) - min(ts), 2) AS duration_s, round_even(max(x) - min(x), 2) AS range_x, round_even(max(y) - min(y), 2) AS range_y,
  round_even(max(z) - min(z), 2) AS range_z FROM s GROUP BY bag""")
def run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, duration and extent of each run, halves rounded to even digits."""
    s = R.steps(P.poses(spark, sf_dir))
    size = lambda c: F.bround(F.max(c) - F.min(c), 2)
    return s.groupBy("bag").agg(
        F.bround(F.coalesce(F.sum("step"), F.lit(0.0)), 3).alias("length_m"), size("ts").alias("duration_s"), *(size(c).alias(f"range_{c}") for c in "xyz"),
    )
