"""Queries on rasters, touch and records against their SQL; trackers, payloads and files against plain Python."""

import json
import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions import geometry as G
from motionlake.operators import timeseries as T
from motionlake.operators import touch as H
from motionlake.operators import trajectory as R
from motionlake.plans import record_queries as Q
from motionlake.plans.queries import ORACLE_SQL, QUERIES
from motionlake.sources import datasets as D
from motionlake.sources import recordings as B
from motionlake.streaming import poses as L
from motionlake.streaming.filters import OneEuro

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == Q.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_record_query(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in "orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)


def test_payload_numbers_and_pixels(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 1.5, -9.81, 5e-324, 1.7e308, -math.inf, *(rng.uniform(-1e3, 1e3) * 10.0 ** rng.randrange(-200, 200) for _ in range(50))]
    rows = [(i, bytes(232) + struct.pack("<ddd", x, -x, 2.0)) for i, x in enumerate(numbers)] + [(-1, bytes(240)), (-2, None)]
    df = spark.createDataFrame(rows, "i long, data binary").select("i", B.acceleration(F.col("data")).alias("a"))
    got = {r.i: r.a for r in df.collect()}
    assert all((got[i].x, got[i].y, got[i].z) == (x, -x, 2.0) for i, x in enumerate(numbers))
    assert (got[-1].x, got[-1].y, got[-1].z) == (0.0, None, None) and got[-2].x is None
    head = bytes(16) + b"mono8\0\0\0"
    rows = [(1, head + bytes(range(6))), (2, head + b"ab"), (3, b"x" * 40)]
    df = spark.createDataFrame(rows, "i long, data binary").select("i", B.raw_pixels(F.col("data"), sizes=((4, 3), (2, 2))).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert (got[1].width, bytes(got[1].pixels)) == (4, (head + bytes(range(6)))[-12:]) and (got[2].width, got[3]) == (2, None)


def test_row_lengths_are_mended_on_tables_and_streams(spark, tmp_path):
    image = lambda w, step: bytes(4) + struct.pack("<II", 600, w) + struct.pack("<I", 6) + b"mono8\0\0\0" + struct.pack("<I", step) + b"pixels"
    rows = [(1, "left", image(960, 2880)), (2, "left", image(960, 960)), (3, "imu", image(960, 1)), (4, "left", b"short mono8"), (5, "left", None)]
    df = spark.createDataFrame(rows, "id long, topic string, data binary")
    want = {1: (True, image(960, 960)), 2: (False, image(960, 960)), 3: (False, image(960, 1)), 4: (False, b"short mono8"), 5: (False, None)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = B.patched(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["left"])
    q = stream.writeStream.format("memory").queryName("mended").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    for out in (B.patched(df, ["left"]), spark.table("mended")):
        assert {r.id: (r.changed, r.data and bytes(r.data)) for r in out.collect()} == want


def test_hidden_joints_stay_near_where_they_were(spark):
    rng = random.Random(5)
    frames = [(0, f, 0, f / 30, 100.0 + 3 * f, 50.0, "Left", [(rng.random() * 90, rng.random() * 90, rng.choice([0.01, 0.1, 0.22, 0.9])) for _ in range(21)]) for f in range(30)]
    schema = "stream long, frame long, det int, t double, x double, y double, side string, k array<struct<x:double,y:double,c:double>>"
    got = {r.frame: r.k for r in L.hand_poses(spark.createDataFrame(frames, schema)).collect()}
    filters = [[OneEuro(0.8, 0.005), OneEuro(0.8, 0.005)] for _ in range(21)]
    last = [(x, y) for x, y, _ in frames[0][-1]]
    vx, before = 0.0, None
    for _, f, _, t, x, _, _, k in frames:
        vx = 0.7 * vx + 0.3 * (0.0 if before is None else (x - before[0]) / max(1e-3, t - before[1]))
        before = (x, t)
        for n, (a, b, c) in enumerate(k):
            sure = c >= 0.22
            raw = (a, b) if sure else (last[n][0] + vx * 0.01, last[n][1])
            at = tuple(g(v, t) for g, v in zip(filters[n], raw))
            last[n] = at if sure else last[n]
            assert np.allclose(tuple(got[f][n]), (*at, c if sure else max(0.05, c)), atol=1e-9)


def test_bodies_pass_joints_that_are_not_sure(spark):
    k = lambda x, c: [(x, 0.0, c)] * 17
    rows = [(0, 0, 0, 0.0, 5.0, 5.0, k(1.0, 0.9)), (0, 1, 0, 0.1, 5.0, 5.0, k(7.0, 0.1)), (0, 2, 0, 0.2, 5.0, 5.0, k(3.0, 0.9))]
    df = spark.createDataFrame(rows, "stream long, frame long, det int, t double, x double, y double, k array<struct<x:double,y:double,c:double>>")
    assert [(r.person, r.k[0].x) for r in L.body_poses(df).orderBy("frame").collect()] == [(0, 1.0), (0, 7.0), (0, 3.0)]


def test_first_button_wins_and_last_hand_counts(spark):
    buttons = [H.Button("a", 0, 0, 10, 10), H.Button("b", 10, 0, 20, 10)]
    rows = [(0, f, d, f / 30, d, 470.0, 300.0, z, c, x, 5.0) for f, d, z, c, x in [
        (0, 0, 0.3, 0.9, 10.0), (1, 0, 0.3, 0.9, 10.0), (1, 1, 0.3, 0.9, 15.0), (2, 0, 0.3, 0.9, 21.0), (3, 0, 0.3, 0.1, 5.0), (4, 1, 0.0, 0.9, 5.0), (5, 2, 0.5, 0.9, 5.0)]]
    tips = spark.createDataFrame(rows, "stream long, frame long, det int, t double, track int, u double, v double, z double, c double, px double, py double")
    assert {(r.frame, r.button) for r in H.touch_events(tips, buttons).collect()} == {(0, "a"), (1, "b")}


def test_relative_errors_against_plain_python(spark):
    pairs = Q.turned_pairs(spark, SF).filter("bag < 4").cache()
    got = {(r.bag, r.seq): r for r in R.relative_errors(pairs, 2.0).collect()}
    seen = 0
    for bag, d in pairs.toPandas().groupby("bag"):
        d = d.sort_values("seq").reset_index(drop=True)
        p, q = d[["px", "py", "pz"]].to_numpy(), d[["qx", "qy", "qz"]].to_numpy()
        turns = [[np.array(r).reshape(3, 3) for r in d[c]] for c in ("pr", "qr")]
        marks, gone = [], 0.0
        for i in range(len(d)):
            gone += np.linalg.norm(p[i] - p[i - 1]) if i else 0.0
            if gone >= 2.0:
                marks.append(i)
                gone = 0.0
        for i, j in zip(marks, marks[1:]):
            r = got[bag, d.seq[i]]
            a, b = (t[i].T @ (x[j] - x[i]) for t, x in zip(turns, (p, q)))
            e = (turns[1][i].T @ turns[1][j]).T @ (turns[0][i].T @ turns[0][j])
            assert r.next_seq == d.seq[j] and abs(r.error - np.linalg.norm(a - b)) < 1e-9
            assert abs(r.angle - np.degrees(np.arccos(np.clip((np.trace(e) - 1) / 2, -1, 1)))) < 1e-5
            seen += 1
    assert seen == len(got) > 5


def test_turn_errors_of_turned_runs(spark):
    pairs = Q.turned_pairs(spark, SF).withColumn("qr", F.col("pr")).withColumns({f"q{c}": F.col(f"p{c}") for c in "xyz"})
    assert R.turn_errors(pairs).agg(F.max("angle")).first()[0] < 1e-3


def test_time_sync_of_streams(spark, tmp_path):
    schema = "bag long, id long, ts timestamp"
    sides = []
    for name, step in (("l", 0), ("r", 4000)):
        df = spark.range(20).select(F.lit(1).cast("long").alias("bag"), "id", F.timestamp_micros(F.col("id") * 50_000 + step + 1_700_000_000_000_000).alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
    q = T.time_synced(*sides, "10 milliseconds").writeStream.format("memory").queryName("synced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.left_id, r.right_id) for r in spark.table("synced").collect()) == [(i, i) for i in range(20)]


def test_disparity_in_wider_pixels(spark):
    assert spark.range(1).select(G.rescaled(F.lit(3.0), 480, 960)).first()[0] == 6.0


def test_association_of_empty_sides(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 3)], "bag long, us long, id long")
    b = spark.createDataFrame([(1, 12, 4), (3, 7, 5)], "bag long, us long, id long")
    assert [tuple(r) for r in T.associated(a, b, 5).collect()] == [(1, 10, 12)]
    assert T.associated(a, b.limit(0), 5).count() == 0


def test_dataset_files(spark, tmp_path):
    for path in ("a/x.db3", "a/y.db3", "b/z.db3", "b/n.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text("x")
    found = D.find_files(spark, [str(tmp_path), str(tmp_path / "a")])
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(found) == ["x.db3", "y.db3", "z.db3"]
    assert names(D.first_in_folder(found).orderBy("path")) == ["x.db3", "z.db3"]
    assert D.latest_folder(found).count() == 1 and D.latest_folder(found.limit(0)).count() == 0
    (tmp_path / "c.yaml").write_text(
        "cam0:\n  distortion_coeffs: [0.1, -2e-3]\n  intrinsics: [1.5, 2, 3, 4]\n  resolution: [960, 600]\n"
        "cam1:\n  T_cn_cnm1:\n  - [1.0, 0, 0, -0.06]\n  - [0, 1, 0, 0]\n  - [0, 0, 1, 0]\n  - [0, 0, 0, 1]\n  intrinsics: [5, 6, 7, 8]\n  resolution: [960, 600]\n")
    c = {r.camera: r for r in D.read_stereo_calibration(spark, str(tmp_path / "c.yaml")).collect()}
    assert c["cam0"].intrinsics == [1.5, 2, 3, 4] and c["cam0"].distortion == [0.1, -0.002] and c["cam0"].width == 960 and c["cam0"].to_previous == []
    assert len(c["cam1"].to_previous) == 16 and c["cam1"].to_previous[3] == -0.06
    (tmp_path / "k.yaml").write_text("%YAML:1.0\n---\nimage_width: 960\nimage_height: 600\nprojection_parameters:\n   k2: 0.01\n   mu: 220.5\n   v0: 306\n")
    k = D.read_camera(spark, str(tmp_path / "k.yaml")).first()
    assert (k.width, k.height, k.fx, k.cy, k.k2, k.fy) == (960, 600, 220.5, 306, 0.01, None)
    (tmp_path / "m.txt").write_text("# head\n1 2 3\n\n4 5e1 x # end\n")
    assert [r.numbers for r in D.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("line").collect()] == [[1, 2, 3], [4, 50, None]]


def test_written_records(spark, tmp_path):
    runs = spark.createDataFrame([(1, 2.123456, 7, None), (2, None, None, "x")], "bag long, total double, n long, note string")
    D.write_lines(D.summary_json(runs), str(tmp_path / "s"))
    assert sorted(json.loads(r.value)["bag"] for r in spark.read.text(str(tmp_path / "s")).collect()) == [1, 2]
    texts = [json.loads(r.value) for r in D.summary_json(runs).orderBy("bag").collect()]
    assert texts == [{"bag": 1, "total": 2.1235, "n": 7, "note": None}, {"bag": 2, "total": None, "n": None, "note": "x"}]
    (tmp_path / "one.json").write_text(json.dumps(texts[0], indent=2))
    assert D.read_summaries(spark, str(tmp_path / "one.json"), "bag long, total double").select("bag", "total").first() == (1, 2.1235)
    assert D.summary_text(runs).orderBy("bag").first().value == "=== run summary: 1 ===\n  total: 2.123456\n  n: 7\n  note: -\n"
    samples = spark.createDataFrame([(1, 10, 20, [(i, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(11)])], "frame_idx long, exp_start_us long, exp_end_us long, samples array<struct<imu_time_us:long,acc_x:double,acc_y:double,acc_z:double,gyro_x:double,gyro_y:double,gyro_z:double>>")
    D.write_imu_csv(samples, str(tmp_path / "imu"))
    back = spark.read.csv(str(tmp_path / "imu"), header=True)
    assert ",".join(back.columns) == "frame_idx,exp_start_us,exp_end_us,sample_idx,imu_time_us,acc_x,acc_y,acc_z,gyro_x,gyro_y,gyro_z" and back.count() == 11


def test_metadata_is_yaml(spark):
    yaml = pytest.importorskip("yaml")
    m = spark.createDataFrame([(7, "b", 5), (7, "b", 9)], "bag long, topic string, us long")
    topics = spark.createDataFrame([("b", "T", "cdr", "it's"), ("a", "T", "cdr", "")], "topic string, type string, format string, qos string")
    got = yaml.safe_load(B.metadata(m, topics).first().value)["rosbag2_bagfile_information"]
    assert got["duration"] == {"nanoseconds": 4000} and got["files"][0]["path"] == "7.db3" and got["message_count"] == 2
    assert [(t["topic_metadata"]["name"], t["topic_metadata"]["offered_qos_profiles"], t["message_count"]) for t in got["topics_with_message_count"]] == [("a", "", 0), ("b", "it's", 2)]


def test_turn_errors_against_plain_python(spark):
    pairs = Q.turned_pairs(spark, SF).filter("bag = 1")
    d = pairs.toPandas().sort_values("seq")
    p, q = d[["px", "py", "pz"]].to_numpy(), d[["qx", "qy", "qz"]].to_numpy()
    u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    got = {x.seq: x.angle for x in R.turn_errors(pairs).collect()}
    for seq, a, b in zip(d.seq, d.pr, d.qr):
        trace = np.trace((r @ np.array(a).reshape(3, 3)).T @ np.array(b).reshape(3, 3))
        assert abs(got[seq] - np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))) < 1e-4
    assert len(got) == len(d) > 5
