"""Named queries on the proxy tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import geometry as G
from ..functions import pose as J
from ..operators import spatial as S
from ..operators import timeseries as T
from ..operators import trajectory as R
from ..streaming import filters as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOLERANCE_US = 6 * 3600 * 1_000_000
HOUR_US = 3600 * 1_000_000


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str, digits: int = 6) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


def side(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    return P.messages(spark, sf_dir).filter(F.col("topic") == topic)


# -- messages -----------------------------------------------------------------------------

@query(f"""WITH {P.MESSAGES_SQL},
d AS (SELECT *, (us - lag(us) OVER (PARTITION BY bag, topic ORDER BY us, id)) / 1e6 AS dt FROM m),
a AS (SELECT *, avg(dt) OVER (PARTITION BY bag, topic) AS mdt FROM d),
s AS (SELECT bag, topic, count(*) AS n, (max(us) - min(us)) / 1e6 AS span_s, avg(dt) AS mean_dt, min(dt) AS min_dt, max(dt) AS max_dt, stddev_pop(dt) AS std_dt,
  median(dt) AS median_dt, quantile_cont(dt, 0.99) AS p99_dt, count(*) FILTER (dt <= 0) AS non_monotonic, count(*) FILTER (dt > 2.5 * mdt) AS drops FROM a GROUP BY bag, topic)
SELECT bag, topic, n, round(span_s, 4) AS span_s, round(mean_dt, 4) AS mean_dt, round(min_dt, 8) AS min_dt, round(max_dt, 8) AS max_dt, round(std_dt, 4) AS std_dt, round(median_dt, 8) AS median_dt,
  round(p99_dt, 8) AS p99_dt, non_monotonic, drops, round(CASE WHEN span_s > 0 THEN n / span_s END, 8) AS rate_hz, round(CASE WHEN span_s > 0 THEN (n - 1) / span_s END, 8) AS step_rate_hz FROM s""")
def bag_topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.interval_stats(P.messages(spark, sf_dir))
    return out.withColumns(r6("span_s", "mean_dt", "std_dt", digits=4) | r6("min_dt", "max_dt", "median_dt", "p99_dt", "rate_hz", "step_rate_hz", digits=8))


@query(f"WITH {P.MESSAGES_SQL}, b AS (SELECT min(us) AS a, max(us) AS b FROM m) SELECT m.* FROM m, b WHERE us BETWEEN a + (b - a) // 4 AND a + (b - a) // 2 AND topic IN ('view', 'click')")
def bag_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.messages(spark, sf_dir)
    low, high = m.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return m
    return m.filter(F.col("us").between(low + (high - low) // 4, low + (high - low) // 2) & F.col("topic").isin("view", "click"))


@query(f"""WITH {P.MESSAGES_SQL}, b AS (SELECT bag, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY bag), t AS (SELECT DISTINCT topic FROM m), c AS (SELECT bag, topic, count(*) AS n FROM m GROUP BY bag, topic)
SELECT b.bag, first_us, last_us, t.topic, coalesce(n, 0) AS n FROM b CROSS JOIN t LEFT JOIN c ON c.bag = b.bag AND c.topic = t.topic""")
def bag_topic_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.topic_counts(P.messages(spark, sf_dir))


_NEAR = f"""WITH {P.MESSAGES_SQL}, l AS (SELECT * FROM m WHERE topic = 'view'), i AS (SELECT * FROM m WHERE topic = 'error'),
b AS (SELECT l.*, i.us AS before_us FROM l ASOF LEFT JOIN i ON l.bag = i.bag AND l.us >= i.us),
n AS (SELECT b.*, i.us AS after_us FROM b ASOF LEFT JOIN i ON b.bag = i.bag AND b.us < i.us),
k AS (SELECT bag, us, id, CASE WHEN before_us IS NULL OR after_us - us < us - before_us THEN after_us ELSE before_us END AS near_us FROM n)"""


@query(_NEAR + " SELECT bag, id, us, near_us, near_us - us AS offset_us FROM k WHERE near_us IS NOT NULL")
def asof_nearest_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.nearest(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.IMU))
    return near.select("bag", "id", "us", "near_us", "offset_us")


@query(_NEAR + """, e AS (SELECT bag, us, id, near_us - us AS o, abs(near_us - us) / 1000.0 AS ms FROM k WHERE near_us IS NOT NULL)
SELECT bag, round(median(ms), 5) AS median_ms, round(quantile_cont(ms, 0.99), 5) AS p99_ms, round(max(ms), 5) AS max_ms, arg_max(o, (us, id)) - arg_min(o, (us, id)) AS drift_us,
  CASE WHEN max(ms) < 1 THEN 'hardware' WHEN quantile_cont(ms, 0.99) < 15 THEN 'software' ELSE 'unsynchronised' END AS verdict FROM e GROUP BY bag""")
def asof_nearest_abs_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.nearest(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.IMU)).withColumn("ms", F.abs("offset_us") / 1000.0)
    when = F.struct("us", "id")
    out = near.groupBy("bag").agg(
        F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.99).alias("p99_ms"), F.max("ms").alias("max_ms"),
        (F.max_by("offset_us", when) - F.min_by("offset_us", when)).alias("drift_us"),
    ).withColumn("verdict", T.sync_verdict(F.col("max_ms"), F.col("p99_ms")))
    return out.withColumns(r6("median_ms", "p99_ms", "max_ms", digits=5))


@query(f"""WITH {P.MESSAGES_SQL}, l AS (SELECT * FROM m WHERE topic = 'view'), i AS (SELECT * FROM m WHERE topic = 'error'),
a AS (SELECT bag, min(us) AS a0, max(us) AS a1 FROM l GROUP BY bag), b AS (SELECT bag, min(us) AS b0, max(us) AS b1 FROM i GROUP BY bag),
r AS (SELECT l.bag, l.id, CAST(floor(b0 + (us - a0) / greatest(100000.0, a1 - a0) * (b1 - b0)) AS BIGINT) AS us FROM l JOIN a ON a.bag = l.bag JOIN b ON b.bag = l.bag)
SELECT r.bag, r.id, r.us, i.us AS after_us FROM r ASOF JOIN i ON r.bag = i.bag AND r.us <= i.us""")
def asof_forward_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = side(spark, sf_dir, P.IMU)
    return T.forward(T.remapped(side(spark, sf_dir, P.LEFT), right), right).select("bag", "id", "us", "after_us")


def _tolerance_sql(order: str) -> str:
    return f"""WITH {P.MESSAGES_SQL}, l0 AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY us, id) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n FROM m WHERE topic = 'view'),
t AS (SELECT bag, id AS target, us AS t_us FROM l0 WHERE i % greatest(1, n // 8) = 0), r AS (SELECT * FROM m WHERE topic = 'click'),
g AS (SELECT t.bag, target, t_us, r.id, r.us, abs(r.us - t_us) AS gap FROM t JOIN r ON r.bag = t.bag AND abs(r.us - t_us) < {TOLERANCE_US}),
o AS (SELECT *, row_number() OVER (PARTITION BY bag, id ORDER BY {order}t_us, target) AS k FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY bag, target ORDER BY gap, us, id) AS q FROM o WHERE k = 1)
SELECT bag, target, t_us, id, gap AS gap_us FROM b WHERE q = 1"""


@query(_tolerance_sql(""))
def tolerance_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = T.decimated(side(spark, sf_dir, P.LEFT), 8)
    return T.tolerance_match(targets, side(spark, sf_dir, P.RIGHT), TOLERANCE_US, first=True)


@query(_tolerance_sql("gap, "))
def tolerance_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = T.decimated(side(spark, sf_dir, P.LEFT), 8)
    return T.tolerance_match(targets, side(spark, sf_dir, P.RIGHT), TOLERANCE_US)


@query(_NEAR + f" SELECT bag, id, near_us - us AS offset_us FROM k WHERE abs(near_us - us) <= {TOLERANCE_US}")
def association_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.nearest(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.IMU))
    return near.filter(F.abs("offset_us") <= TOLERANCE_US).select("bag", "id", "offset_us")


@query(f"""WITH {P.MESSAGES_SQL}, a AS (SELECT bag, id AS left_id, row_number() OVER (PARTITION BY bag ORDER BY us, id) - 1 AS pos FROM m WHERE topic = 'view'),
b AS (SELECT bag, id AS right_id, row_number() OVER (PARTITION BY bag ORDER BY us, id) - 1 AS pos FROM m WHERE topic = 'click') SELECT bag, CAST(pos AS INT) AS pos, left_id, right_id FROM a JOIN b USING (bag, pos)""")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.zipped(side(spark, sf_dir, P.LEFT), side(spark, sf_dir, P.RIGHT))


@query(f"""WITH {P.MESSAGES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY us, id) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n, us - min(us) OVER (PARTITION BY bag) AS rel_us FROM m)
SELECT bag, id, rel_us FROM w WHERE i % greatest(1, n // 20) = 0""")
def zero_base_time_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.messages(spark, sf_dir).withColumn("rel_us", F.col("us") - F.min("us").over(Window.partitionBy("bag")))
    return T.decimated(m, 20).select("bag", "id", "rel_us")


@query(f"WITH {P.MESSAGES_SQL} SELECT id, bag, us FROM m ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 1000")
def sample_hash_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hashed_sample(P.messages(spark, sf_dir).select("id", "bag", "us"), 1000)


@query(f"""WITH {P.MESSAGES_SQL}, w AS (SELECT bag, id, us, us - lag(us) OVER (PARTITION BY bag ORDER BY id) AS s, row_number() OVER (PARTITION BY bag ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n FROM m),
g AS (SELECT bag, arg_min(us, id) AS a, arg_max(us, id) AS b, bool_or(coalesce(s <= 0, false)) AS bad FROM w GROUP BY bag)
SELECT bag, id, CAST(floor(CASE WHEN bad THEN i * (b - a) / greatest(1, n - 1) ELSE us - a END) AS BIGINT) AS repaired_us FROM w JOIN g USING (bag)""")
def time_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.repaired(P.messages(spark, sf_dir)).select("bag", "id", F.floor("repaired_us").alias("repaired_us"))


@query(f"""WITH {P.MESSAGES_SQL}, w AS (SELECT bag, id, value, topic, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER a AS l, count(*) OVER a AS n, max(CASE WHEN topic = 'error' THEN 1 ELSE 0 END) OVER a AS e,
 avg(value) OVER (PARTITION BY bag ORDER BY us, id ROWS 29 PRECEDING) AS mean30, count(*) OVER (PARTITION BY bag ORDER BY us, id ROWS 59 PRECEDING) AS history
 FROM m WINDOW a AS (PARTITION BY bag ORDER BY us, id ROWS 14 PRECEDING))
SELECT bag, id, CASE WHEN 2 * l >= n THEN 'Left' ELSE 'Right' END AS side, e = 1 AS active, round(mean30, 6) AS mean30, history FROM w""")
def rolling_votes_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.messages(spark, sf_dir)
    d = T.active15(T.majority15(m, F.col("value") > 20), F.col("topic") == "error")
    w = T.ordered("bag")
    return d.select("bag", "id", "side", "active", F.round(F.avg("value").over(w.rowsBetween(-29, 0)), 6).alias("mean30"), F.size(F.collect_list("value").over(w.rowsBetween(-59, 0))).cast("long").alias("history"))


@query(f"""WITH {P.MESSAGES_SQL} SELECT topic, time_bucket(INTERVAL 1 HOUR, make_timestamp(us)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY 1, 2""")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.windowed(P.messages(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")))
    return w.select("topic", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH {P.MESSAGES_SQL}, s AS (SELECT *, make_timestamp((us // {HOUR_US // 2} - k) * {HOUR_US // 2}) AS start FROM m, range(2) r(k)) SELECT topic, start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.windowed(P.messages(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")), slide="30 minutes")
    return w.select("topic", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH {P.MESSAGES_SQL}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY bag ORDER BY us, id) < {HOUR_US // 2} THEN 0 ELSE 1 END AS f FROM m),
s AS (SELECT *, sum(f) OVER (PARTITION BY bag ORDER BY us, id) AS k FROM g) SELECT bag, make_timestamp(min(us)) AS start, count(*) AS n FROM s GROUP BY bag, k""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.sessions(P.messages(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")))
    return w.select("bag", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH RECURSIVE {P.MESSAGES_SQL},
d AS (SELECT bag, id, us / 1e6 AS t, value AS x, row_number() OVER (PARTITION BY bag ORDER BY us / 1e6, id) AS n FROM m),
f AS (
  SELECT bag, id, n, t, x, x AS smooth, CAST(0 AS DOUBLE) AS dx FROM d WHERE n = 1
  UNION ALL
  SELECT bag, id, n, t, x, r / (r + 1) * x + (1 - r / (r + 1)) * px, dx FROM (
    SELECT *, 2 * pi() * (1 + 7e-3 * abs(dx)) * te AS r FROM (
      SELECT *, a * (x - px) / te + (1 - a) * pdx AS dx FROM (
        SELECT *, 2 * pi() * te / (2 * pi() * te + 1) AS a FROM (
          SELECT d.*, f.smooth AS px, f.dx AS pdx, CASE WHEN d.t > f.t THEN d.t - f.t ELSE CAST(1 AS DOUBLE) / 30 END AS te
          FROM f JOIN d ON d.bag = f.bag AND d.n = f.n + 1)))))
SELECT bag, id, t, x, round(smooth, 6) AS smooth FROM f""")
def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.messages(spark, sf_dir).select("bag", "id", (F.col("us") / 1e6).alias("t"), F.col("value").alias("x"))
    return L.one_euro(d, "bag").withColumn("smooth", F.round("smooth", 6))


# -- trajectories ---------------------------------------------------------------------------

_STEP = f"""WITH {P.POSES_SQL},
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step, ts - lag(ts) OVER w AS dt FROM p WINDOW w AS (PARTITION BY bag ORDER BY seq)),
t AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY bag ORDER BY seq ROWS UNBOUNDED PRECEDING) AS distance FROM s)"""


@query(_STEP + """, f AS (SELECT *, atan2(2 * qw * qz, 1 - 2 * qz * qz) AS yaw FROM s),
g AS (SELECT bag, count(*) AS n, coalesce(sum(step), 0.0) AS length_m, max(ts) - min(ts) AS duration_s, sqrt(avg(step * step)) AS step_rmse, avg(step) AS step_mean, stddev_pop(step) AS step_std, max(step) AS step_max,
  quantile_cont(CASE WHEN dt > 1e-4 THEN step / dt END, 0.99) AS sp, min(z) AS z_min, max(z) AS z_max,
  arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_min(z, seq) AS az, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_, arg_max(z, seq) AS bz, abs(arg_max(yaw, seq) - arg_min(yaw, seq)) AS turn FROM f GROUP BY bag),
h AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS net_m, CASE WHEN duration_s > 0 THEN length_m / duration_s ELSE 0.0 END AS mean_speed FROM g)
SELECT bag, n, round(length_m, 6) AS length_m, round(duration_s, 4) AS duration_s, round(step_rmse, 6) AS step_rmse, round(step_mean, 6) AS step_mean, round(step_std, 6) AS step_std, round(step_max, 6) AS step_max,
  round(z_min, 6) AS z_min, round(z_max, 6) AS z_max, round(net_m, 6) AS net_m, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), 6) AS xy_error_m, round(bz - az, 6) AS z_drift_m,
  round(degrees(abs((turn + pi()) % (2 * pi()) - pi())), 6) AS yaw_drift_deg, round(net_m / greatest(length_m, 1e-3) * 100, 4) AS drift_percent, round(mean_speed, 8) AS mean_speed, round(coalesce(sp, mean_speed), 6) AS max_speed,
  n < 10 AS rejected, z_max - z_min > 2.5 OR coalesce(step_max, 0) > 1.5 OR n < 50 AS flying FROM h""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.summary(P.poses(spark, sf_dir))
    return out.withColumns(r6("length_m", "step_rmse", "step_mean", "step_std", "step_max", "z_min", "z_max", "net_m", "xy_error_m", "z_drift_m", "yaw_drift_deg", "max_speed") | r6("duration_s", "drift_percent", digits=4) | r6("mean_speed", digits=8))


@query(_STEP + " SELECT bag, seq, round(distance, 6) AS distance FROM t")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.travelled(P.poses(spark, sf_dir)).select("bag", "seq", F.round("distance", 6).alias("distance"))


@query(f"""WITH {P.POSES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY bag) AS n FROM p),
j AS (SELECT a.bag, a.seq, a.x AS own, a.n, avg(b.x) AS mean FROM n a CROSS JOIN range(-3, 4) r(o) JOIN p b ON b.bag = a.bag AND b.seq = least(a.n - 1, greatest(0, a.seq + o)) GROUP BY a.bag, a.seq, a.x, a.n)
SELECT bag, seq, round(CASE WHEN n < 7 OR seq = 0 OR seq = n - 1 THEN own ELSE mean END, 6) AS smooth FROM j""")
def smooth7_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.smoothed7(P.poses(spark, sf_dir), "x").select("bag", "seq", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {P.POSES_SQL}, l AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a FROM p WINDOW w AS (PARTITION BY bag ORDER BY seq))
SELECT bag, seq, round(CASE WHEN b IS NULL THEN a - y WHEN a IS NULL THEN y - b ELSE (a - b) / 2 END, 6) AS gradient FROM l""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gradient(P.poses(spark, sf_dir), "y").select("bag", "seq", F.round("gradient", 6).alias("gradient"))


@query(_STEP + """, g AS (SELECT bag, regr_slope(z, distance) AS s, regr_intercept(z, distance) AS i FROM t GROUP BY bag) SELECT bag, round(s, 6) AS slope, round(i, 6) AS intercept, round(degrees(asin(least(abs(s), 1.0))), 4) AS pitch_deg FROM g""")
def z_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slope(P.poses(spark, sf_dir)).withColumns(r6("slope", "intercept") | r6("pitch_deg", digits=4))


@query(f"""WITH {P.POSES_SQL}, e AS (SELECT bag, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p GROUP BY bag)
SELECT bag, round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 6) AS eigenvalue, round(0.5 * atan2(2 * b, a - c), 6) AS angle FROM e WHERE a IS NOT NULL""")
def pca_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.principal_axis(P.poses(spark, sf_dir)).withColumns(r6("eigenvalue", "angle"))


@query(_STEP + """, n AS (SELECT *, count(*) OVER (PARTITION BY bag) AS n FROM t),
e AS (SELECT bag, arg_min(seq, (x, seq)) FILTER (seq < greatest(1, n // 2)) AS a, arg_min(seq, (-x, seq)) AS b FROM n GROUP BY bag),
q AS (SELECT t.bag, CASE WHEN seq < a THEN 'excitation' WHEN seq <= b THEN 'walk' ELSE 'stop' END AS phase, distance FROM t JOIN e ON e.bag = t.bag)
SELECT bag, phase, count(*) AS n, round(max(distance) - min(distance), 6) AS distance FROM q GROUP BY bag, phase""")
def phase_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.phases(P.poses(spark, sf_dir))
    return d.groupBy("bag", "phase").agg(F.count("*").alias("n"), F.round(F.max("distance") - F.min("distance"), 6).alias("distance"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run held against itself turned by a quarter and shifted, with a known disturbance."""
    p = P.poses(spark, sf_dir)
    off = (F.col("seq") % 3).cast("double") / 100
    return p.select("bag", "seq", *(F.col(c).alias(f"p{c}") for c in "xyz"), (-F.col("y") + 1 + off).alias("qx"), (F.col("x") + 2).alias("qy"), (F.col("z") + 3 - off).alias("qz"))


@query()
def umeyama_ate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.error_stats(R.aligned(_pairs(spark, sf_dir)))


@query()
def find_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trips(P.poses(spark, sf_dir))


# -- space ----------------------------------------------------------------------------------

_C = G.MAPPING


@query(f"""WITH {P.POINTS_SQL}, d AS (SELECT frame, seq, u, v, CASE WHEN d > 1 THEN {_C.fx} * {_C.baseline} / d END AS z FROM pt)
SELECT frame, seq, round(CASE WHEN z > 0.1 THEN (u - {_C.cx}) * z / {_C.fx} ELSE 0 END, 6) AS x, round(CASE WHEN z > 0.1 THEN (v - {_C.cy}) * z / {_C.fy} ELSE 0 END, 6) AS y, round(CASE WHEN z > 0.1 THEN z ELSE 0 END, 6) AS z,
  least(65535, greatest(0, CAST(trunc(z * 1000) AS INT))) AS mm, CASE WHEN z > 2 THEN 'GREEN' WHEN z > 1 THEN 'YELLOW' WHEN z > 0.1 THEN 'RED' ELSE 'UNKNOWN' END AS zone FROM d WHERE z BETWEEN 0.15 AND 5""")
def depth_backproject_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.points(spark, sf_dir).withColumn("depth", G.depth(F.col("d"))).filter(F.col("depth").between(0.15, 5.0))
    d = d.withColumn("p", G.lifted(F.col("u"), F.col("v"), F.col("depth")))
    return d.select("frame", "seq", *(F.round(F.col(f"p.{c}"), 6).alias(c) for c in "xyz"), G.millimetres(F.col("depth")).alias("mm"), J.zone(F.col("depth")).alias("zone"))


@query(f"""WITH {P.POSES_SQL} SELECT bag, seq, round((1 - 2 * qz * qz) * 1.0 - 2 * qz * qw * 2.0 + x, 6) AS wx, round(2 * qz * qw * 1.0 + (1 - 2 * qz * qz) * 2.0 + y, 6) AS wy, round(3.0 + z, 6) AS wz FROM p""")
def se3_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    p = P.poses(spark, sf_dir).withColumn("r", G.rotation(zero, zero, F.col("qz"), F.col("qw")))
    p = p.withColumn("w", G.moved(F.col("r"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.col("x"), F.col("y"), F.col("z")]))
    return p.select("bag", "seq", *(F.round(F.col(f"w.{c}"), 6).alias(f"w{c}") for c in "xyz"))


@query(f"""WITH {P.POINTS_SQL} SELECT CAST(floor(x / 0.04) AS BIGINT) AS vx, CAST(floor(y / 0.04) AS BIGINT) AS vy, CAST(floor(z / 0.04) AS BIGINT) AS vz, min(seq) AS seq, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(z, seq) AS z
FROM pt WHERE z BETWEEN 0.2 AND 1.5 GROUP BY 1, 2, 3""")
def voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voxel_first(P.points(spark, sf_dir).filter(F.col("z").between(0.20, 1.50)))


@query(f"""WITH {P.POINTS_SQL} SELECT CAST(trunc(x / 0.05) AS INT) AS gx, CAST(trunc(y / 0.05) AS INT) AS gy, count(*) AS hits FROM pt GROUP BY 1, 2 HAVING count(*) >= 2""")
def grid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits(P.points(spark, sf_dir))


@query(f"""WITH {P.POINTS_SQL} SELECT min(x) - 1.0 AS x0, min(y) - 1.0 AS y0, CAST(ceil((max(x) - min(x) + 2.0) / 0.05) AS INT) AS width, CAST(ceil((max(y) - min(y) + 2.0) / 0.05) AS INT) AS height FROM pt""")
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bounds(P.points(spark, sf_dir), 1.0, 0.05)


_LAYERS = f"""WITH {P.POINTS_SQL}, y AS (SELECT DISTINCT CAST(frame % 40 AS INT) AS ax, CAST(frame % 31 AS INT) AS ay, CAST(trunc(x / 0.05) AS INT) AS bx, CAST(trunc(y / 0.05) AS INT) AS by_ FROM pt),
n AS (SELECT *, greatest(abs(bx - ax), abs(by_ - ay)) AS n FROM y),
r AS (SELECT DISTINCT CAST(trunc(ax + i * CAST(bx - ax AS DOUBLE) / n) AS INT) AS gx, CAST(trunc(ay + i * CAST(by_ - ay AS DOUBLE) / n) AS INT) AS gy FROM (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 1)),
c AS (SELECT DISTINCT ax, ay FROM y), k AS (SELECT DISTINCT CAST(ax + a AS INT) AS gx, CAST(ay + b AS INT) AS gy FROM c, range(-3, 4) p(a), range(-3, 4) q(b) WHERE a * a + b * b <= 9),
o AS (SELECT CAST(trunc(x / 0.05) AS INT) AS gx, CAST(trunc(y / 0.05) AS INT) AS gy FROM pt GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _rays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = P.points(spark, sf_dir)
    rays = p.select((F.col("frame") % 40).cast("int").alias("ax"), (F.col("frame") % 31).cast("int").alias("ay"), G.cell(F.col("x"), 0.0, 0.05).alias("bx"), G.cell(F.col("y"), 0.0, 0.05).alias("by")).distinct()
    return p, rays


@query(_LAYERS + " SELECT * FROM r")
def ray_free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ray_cells(_rays(spark, sf_dir)[1])


@query(_LAYERS + """, e AS (SELECT *, 0 AS rank, 'FREE' AS state FROM r UNION ALL SELECT *, 1, 'FREE' FROM k UNION ALL SELECT *, 2, 'OCCUPIED' FROM o) SELECT gx, gy, arg_max(state, rank) AS state FROM e GROUP BY gx, gy""")
def occupancy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, rays = _rays(spark, sf_dir)
    discs = S.disc_cells(rays.select(F.col("ax").alias("gx"), F.col("ay").alias("gy")), 3)
    return S.layered((S.ray_cells(rays), "FREE"), (discs, "FREE"), (S.hits(p), "OCCUPIED"))


@query(f"""WITH {P.POINTS_SQL}, {P.POSES_SQL}, q AS (SELECT DISTINCT x, y FROM p)
SELECT frame, seq FROM pt WHERE NOT EXISTS (SELECT 1 FROM q WHERE (pt.x - q.x) ** 2 + (pt.y - q.y) ** 2 < 0.25)""")
def anti_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.far_from(P.points(spark, sf_dir), P.poses(spark, sf_dir)).select("frame", "seq")


@query(f"""WITH {P.POSES_SQL}, t AS (SELECT p.*, topic FROM p JOIN m USING (id)), k AS (SELECT DISTINCT x, y, z FROM t WHERE topic = '{P.LEFT}'), a AS (SELECT * FROM t WHERE topic <> '{P.LEFT}')
SELECT id, round(sqrt(min((a.x - k.x) ** 2 + (a.y - k.y) ** 2 + (a.z - k.z) ** 2)), 6) AS distance FROM a, k GROUP BY id""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.poses(spark, sf_dir).join(P.messages(spark, sf_dir).select("id", "topic"), "id")
    d = S.nearest_distance(p.filter(F.col("topic") != P.LEFT), p.filter(F.col("topic") == P.LEFT), 4.0, id_="id")
    return d.select("id", F.round("distance", 6).alias("distance"))


for _whole in ("anti_proximity", "nearest_point"):  # their names so far
    QUERIES[f"{_whole}_all"], ORACLE_SQL[f"{_whole}_all"] = QUERIES[_whole], ORACLE_SQL[_whole]


# -- poses ----------------------------------------------------------------------------------

def _turn(a: int, b: int, c: int, d: int) -> str:
    return f"((k[{a}].x - k[{b}].x) * (k[{c}].y - k[{d}].y) - (k[{a}].y - k[{b}].y) * (k[{c}].x - k[{d}].x))"


def _apart(a: int, b: int) -> str:
    return f"sqrt((k[{a}].x - k[{b}].x) ** 2 + (k[{a}].y - k[{b}].y) ** 2)"


_FLAGS = ", ".join(f"{_apart(t + 1, 1)} > 1.15 * {_apart(m + 1, 1)}" for t, m in (J.THUMB, *J.FINGERS))


@query(f"""WITH {P.HANDS_SQL}, f AS (SELECT *, [{_FLAGS}] AS f, {_apart(5, 9)} * 0.1 AS gap FROM h), n AS (SELECT *, len(list_filter(f, lambda x: x)) AS n FROM f)
SELECT frame, hand, CASE WHEN least(k[1].c, k[5].c, k[6].c, k[10].c, k[18].c) < 0.2 THEN 'Unknown' WHEN ({_turn(6, 18, 10, 1)} > 0) = ({_turn(10, 1, 5, 6)} > 0) THEN 'Left' ELSE 'Right' END AS chirality,
  CASE WHEN (k[5].x - k[1].x < 0 AND {_turn(18, 6, 10, 1)} > 0) OR (k[5].x - k[1].x > 0 AND NOT {_turn(18, 6, 10, 1)} > 0) THEN 'Right Hand' ELSE 'Left Hand' END AS handedness, round(gap, 6) AS gap_cm, f AS fingers,
  CASE WHEN gap > 0 AND gap < 3.5 THEN 'PINCHING' WHEN n = 5 THEN 'OPEN PALM' WHEN n = 0 OR (n = 1 AND f[1]) THEN 'FIST' WHEN f[2] AND NOT f[3] AND NOT f[4] AND NOT f[5] THEN 'POINTING'
  WHEN f[2] AND f[3] AND NOT f[4] AND NOT f[5] THEN 'VICTORY / V' ELSE 'MANIPULATING' END AS gesture FROM n""")
def hand_gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    h = P.hands(spark, sf_dir).withColumns({"fingers": J.extended(k), "gap_cm": J.apart(k[4], k[8]) * 0.1})
    return h.select("frame", "hand", J.chirality(k).alias("chirality"), J.handedness(k).alias("handedness"), F.round("gap_cm", 6).alias("gap_cm"), "fingers", J.gesture(F.col("fingers"), F.col("gap_cm")).alias("gesture"))


@query(f"""WITH {P.HANDS_SQL}, t AS (SELECT frame, hand, k, [k[6], k[7], k[12], k[13]] AS b FROM h),
m AS (SELECT frame, hand, k, CASE WHEN k[6].c > 0.3 AND k[7].c > 0.3 THEN [(k[6].x + k[7].x) / 2, (k[6].y + k[7].y) / 2, (k[6].c + k[7].c) / 2] ELSE [k[1].x, k[1].y, k[1].c] END AS s FROM t),
n AS (SELECT *, CASE WHEN k[12].c > 0.3 AND k[13].c > 0.3 THEN [(k[12].x + k[13].x) / 2, (k[12].y + k[13].y) / 2, (k[12].c + k[13].c) / 2] ELSE [s[1], s[2] + 0.4, s[3]] END AS q FROM m),
v AS (SELECT *, sqrt((s[1] - q[1]) ** 2 + (s[2] - q[2]) ** 2 + (s[3] - q[3]) ** 2) AS l FROM n), a AS (SELECT *, CASE WHEN l > 1e-4 THEN degrees(acos(greatest(-1.0, least(1.0, -(s[2] - q[2]) / l)))) ELSE 0 END AS angle FROM v)
SELECT frame, hand, round(angle, 4) AS spine_deg, CASE WHEN angle > 40 THEN 'WARNING' WHEN angle > 20 THEN 'NORMAL' ELSE 'GOOD' END AS posture,
  (k[10].c > 0.3 AND k[6].c > 0.3 AND k[10].y < k[6].y) OR (k[11].c > 0.3 AND k[7].c > 0.3 AND k[11].y < k[7].y) AS raised FROM a""")
def spine_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.hands(spark, sf_dir)
    k = F.col("k")
    h = h.withColumn("k3", F.transform("k", lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y"), j["c"].alias("z"))))
    shoulders, hips = J.torso(k, F.col("k3"))
    h = h.withColumn("s", shoulders).withColumn("q", hips).withColumn("angle", J.spine_angle(F.col("s"), F.col("q")))
    return h.select("frame", "hand", F.round("angle", 4).alias("spine_deg"), J.posture(F.col("angle")).alias("posture"), J.hands_raised(k).alias("raised"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS peak, (list_position(e, list_max(e)) - 1) / 2.0 AS u, round(greatest(0.0, list_max(e)), 6) AS score, round(list_median(e), 6) AS median FROM e""")
def simcc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", J.peak(F.col("e")).alias("peak"), (J.peak(F.col("e")) / 2.0).alias("u"), F.round(F.greatest(F.lit(0.0), F.array_max("e")), 6).alias("score"), F.round(J.median(F.col("e")), 6).alias("median"))


@query(f"""WITH {P.HANDS_SQL}, d AS (SELECT frame // 20 AS frame, frame AS det, hand, score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det, hand) AS rank FROM d)
SELECT frame, det, hand, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""")
def detections_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.hands(spark, sf_dir).select(F.expr("frame div 20").alias("frame"), F.col("frame").alias("det"), "hand", "score")
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), "det", "hand"))
    return h.withColumn("rank", rank).filter("rank <= 8").select("frame", "det", "hand", "rank")


@query(f"""WITH {P.HANDS_SQL}, j AS (SELECT frame, hand, unnest(range(21)) AS joint, unnest(k) AS q FROM h) SELECT frame, hand, CAST(joint AS INT) AS joint, q.x AS x, q.y AS y FROM j WHERE q.c > 0.25""")
def explode_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.hands(spark, sf_dir).select("frame", "hand", F.posexplode("k").alias("joint", "q"))
    return h.filter(F.col("q.c") > 0.25).select("frame", "hand", "joint", "q.x", "q.y")


@query(f"""WITH {P.HANDS_SQL}, d AS (SELECT DISTINCT frame, s FROM h, range(2) r(s)) SELECT d.frame, CAST(s AS INT) AS hand, coalesce(list_sum(list_transform(k, lambda j: j.x)) IS NOT NULL, false) AS present, CAST(coalesce(len(k), 21) AS INT) AS joints FROM d LEFT JOIN h ON h.frame = d.frame AND h.hand = d.s""")
def tensor_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.hands(spark, sf_dir)
    spine = h.select("frame").distinct().withColumn("hand", F.explode(F.array(F.lit(0), F.lit(1))))
    zero = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda _: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c")))
    d = spine.join(h, ["frame", "hand"], "left").withColumns({"present": F.col("k").isNotNull(), "k": F.coalesce("k", zero)})
    return d.select("frame", "hand", "present", F.size("k").alias("joints"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, (CAST(event_id % 256 AS INT) << 16) | (CAST(event_id % 200 AS INT) << 8) | CAST(event_id % 100 AS INT) AS rgb, 0.1 < value / 100 AND value / 100 <= 0.35 AS touch FROM events""")
def json_rgb_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.read(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), G.packed_rgb(i % 256, i % 200, i % 100).alias("rgb"), J.touching(F.col("value") / 100).alias("touch"))


def clips(frame: Column, length: int = 100) -> list[Column]:
    """(stream, frame, t): recordings of `length` frames each, so that there are more of them the longer the table is."""
    return [F.call_function("div", frame, F.lit(length)).alias("stream"), (frame % length).alias("frame"), (frame / 30.0).alias("t")]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, frame, det, t, x, y, side, k) of all hands."""
    k = F.col("k")
    return P.hands(spark, sf_dir).select(
        *clips(F.col("frame")), F.col("hand").alias("det"), (k[0]["x"] * 10).alias("x"), (k[0]["y"] * 10).alias("y"), J.chirality(k).alias("side"), "k",
    )


@query()
def hand_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hand_tracks(detections(spark, sf_dir))


@query()
def body_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_tracks(detections(spark, sf_dir))


# -- relational coverage on the driver's tables ----------------------------------------------

@query("""SELECT n_name, coalesce(r_name, 'all') AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: P.read(spark, sf_dir, n)
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = t("orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    return o.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("n_name", F.coalesce("r_name", F.lit("all")).alias("region"), "orders", "total")
