"""Queries against their SQL on the smallest tables, golden values, streams against batch, files there and back."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake import proxies as P
from motionlake.operators import timeseries as T
from motionlake.operators import trajectory as R
from motionlake.plans.queries import ORACLE_SQL, QUERIES
from motionlake.sources import files, recordings
from motionlake.streaming import filters as L

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in "region nation customer orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    plain = lambda r: tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)
    assert sorted(map(plain, (tuple(r[c] for c in columns) for r in got.collect())), key=repr) == sorted(map(plain, want.fetchall()), key=repr)


def test_one_euro_golden_and_stream(spark, tmp_path):
    x, t = [0.0, 1.0, 1.0, 3.0, 2.0], [0.0, 0.1, 0.2, 0.2, 0.4]
    want = [0, 0.392204, 0.631428, 1.079321, 1.606942]
    f = L.OneEuro()
    assert np.allclose([f(a, b) for a, b in zip(x, t)], want, atol=1e-5)
    df = spark.createDataFrame([(1, i, b, a) for i, (a, b) in enumerate(zip(x, t))], "bag long, id long, t double, x double")
    assert np.allclose([r.smooth for r in L.one_euro(df, "bag").orderBy("id").collect()], want, atol=1e-5)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.one_euro_stream(stream).writeStream.format("memory").queryName("euro").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert np.allclose([r.smooth for r in spark.table("euro").orderBy("id").collect()], want, atol=1e-5)


def test_smoothing_and_gradient_golden(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 7, 0, 0, 0, 0, 0, 14])], "bag long, seq long, v double")
    assert [r.smooth for r in R.smoothed7(df, "v").orderBy("seq").collect()] == [0, 1, 1, 1, 3, 4, 6, 14]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 4, 7])], "bag long, seq long, v double")
    assert [r.gradient for r in R.gradient(df, "v").orderBy("seq").collect()] == [1, 1.5, 2.5, 3]


def test_alignment_golden(spark):
    p = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3)]
    df = spark.createDataFrame([(1, *map(float, a), float(-a[1] + 1), float(a[0] + 2), float(a[2] + 3)) for a in p], "bag long, px double, py double, pz double, qx double, qy double, qz double")
    r = R.alignment(df).first()
    assert np.allclose(np.reshape(r.r, (3, 3)), [[0, -1, 0], [1, 0, 0], [0, 0, 1]]) and np.allclose(r.t, [1, 2, 3])


def test_nearest_ties_go_before(spark):
    m = "bag long, us long, id long"
    near = T.nearest(spark.createDataFrame([(1, 10, 1)], m), spark.createDataFrame([(1, 8, 2), (1, 12, 3)], m)).first()
    assert near.near_us == 8


def test_peaks():
    v = np.concatenate([np.linspace(0, 2, 60), np.linspace(2, 0, 60), np.linspace(0, 0.3, 60), np.linspace(0.3, 0, 60)])
    assert len(R.peaks(v, 0.5, 50)) == 1


def test_trackers():
    t = L.HandTracker()
    assert t.frame(0.0, [(0, 0, "Left"), (900, 0, "Right")]) == [(0, "Left"), (1, "Right")]
    assert [i for i, _ in t.frame(0.03, [(890, 0, "Right"), (5, 0, "Left")])] == [1, 0]
    for k in range(9):
        t.frame(0.1 + k, [])
    assert t.frame(2.0, [(0, 0, "Left")])[0][0] == 2
    b = L.BodyTracker()
    assert b.frame([(0, 0), (1000, 0)]) == [0, 1] and b.frame([(1010, 0)]) == [1] and b.frame([(0, 0)]) == [0]


def test_recording_there_and_back(spark, tmp_path):
    recordings.register(spark)
    stamp = bytes(4) + (5).to_bytes(4, "little") + (500).to_bytes(4, "little")
    m = spark.createDataFrame([(1, i, "a" if i % 2 else "b", 1000 * i, stamp) for i in range(10)], "bag long, id long, topic string, us long, data binary")
    made = recordings.write_recordings(m, str(tmp_path)).collect()
    assert made[0].messages == 10
    back = spark.read.format("recording").option("paths", made[0].path).option("from_us", 2000).option("to_us", 5000).load()
    assert back.count() == 4 and back.groupBy("topic").count().count() == 2
    image = bytes(20) + (600).to_bytes(4, "little") + (960).to_bytes(4, "little") + (6).to_bytes(4, "little") + b"mono8\0"
    size = spark.createDataFrame([(image,), (b"none",)], "data binary").select(recordings.image_size(F.col("data")).alias("s")).collect()
    assert (size[0].s.width, size[0].s.height) == (960, 600) and size[1].s is None
    assert abs(back.select(recordings.stamp(F.col("data"))).first()[0] - 5.0000005) < 1e-12


def test_files_there_and_back(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n\n1 2 3 4 0 0 0 1\n1 2 x 4 0 0 0 1\n1 2 3\n")
    assert files.read_tum(spark, str(tmp_path / "t.txt")).count() == 1
    (tmp_path / "c.csv").write_text("1700000000000000000,1,2,3,1,0,0,0,\nts,x\n")
    r = files.read_estimator_csv(spark, str(tmp_path / "c.csv")).first()
    assert r.ts == 1.7e9 and r.qw == 1
    head = "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    (tmp_path / "p.ply").write_text(head + "1 2 3 4 5 6\n")
    p = files.read_ply(spark, str(tmp_path / "p.ply"))
    assert files.ply_lines(p).first().value == "1.0000 2.0000 3.0000 4 5 6"
    cells = spark.createDataFrame([(0, 0, "OCCUPIED"), (1, 1, "FREE")], "gx int, gy int, state string")
    body = b"".join(bytes(r.pixels) for r in files.pgm_rows(cells, 2, 2).orderBy("row").collect())
    (tmp_path / "m.pgm").write_bytes(b"P5\n2 2\n255\n" + body)
    assert {tuple(r)[1:] for r in files.read_pgm(spark, str(tmp_path / "m.pgm")).collect()} == {(0, 0, "OCCUPIED"), (1, 1, "FREE")}


def test_all_poses_and_points_count(spark):
    p = P.poses(spark, SF).join(P.messages(spark, SF).select("id", "topic"), "id").toPandas()
    pt = P.points(spark, SF).toPandas()
    near = ((pt[["x", "y"]].to_numpy()[:, None] - p[["x", "y"]].drop_duplicates().to_numpy()) ** 2).sum(axis=2).min(axis=1) < 0.25
    far = {(r.frame, r.seq) for r in QUERIES["anti_proximity_all"](spark, SF).collect()}
    assert far == set(zip(pt.frame[~near].tolist(), pt.seq[~near].tolist()))
    assert len(far) < QUERIES["anti_proximity"](spark, SF).count()
    left = p.topic == P.LEFT
    d = np.sqrt(((p[["x", "y", "z"]].to_numpy()[~left, None] - p[["x", "y", "z"]].to_numpy()[left]) ** 2).sum(axis=2).min(axis=1))
    got = {r.id: r.distance for r in QUERIES["nearest_point_all"](spark, SF).collect()}
    assert set(got) == set(p.id[~left].tolist()) and np.allclose([got[i] for i in p.id[~left]], d, atol=1e-5)
