"""Whole files that many tasks write: read back, and byte for byte against small golden files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions.geometry import MAPPING
from motionlake.sources import datasets as D
from motionlake.sources import files, whole

POINTS = "seq long, x double, y double, z double, red int, green int, blue int"


def cloud(n):
    return [(i, i / 7, -i / 3, 1.5 * i, i % 256, 255 - i % 256, 7) for i in range(n)]


def test_ascii_cloud_golden(spark, tmp_path):
    path = str(tmp_path / "c.ply")
    assert whole.write_ply(spark.createDataFrame(cloud(2), POINTS).repartition(3), path) == 2
    head = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    assert open(path).read() == head + "0.0000 0.0000 0.0000 0 255 7\n0.1429 -0.3333 1.5000 1 254 7\n"


@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("normals", [False, True])
def test_clouds_come_back_in_order(spark, tmp_path, binary, normals):
    df = spark.createDataFrame(cloud(1000), POINTS).repartition(7)
    if normals:
        df = df.withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0), "nz": F.col("x"), "curvature": F.lit(None).cast("double")})
    path = str(tmp_path / "c.ply")
    whole.write_ply(df, path, binary=binary)
    assert os.listdir(tmp_path) == ["c.ply"]
    got = files.read_ply(spark, path).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1000)) and [(r.red, r.green, r.blue) for r in got] == [c[4:] for c in cloud(1000)]
    assert np.allclose([(r.x, r.y, r.z) for r in got], [c[1:4] for c in cloud(1000)], atol=1e-4)
    if binary:
        kind = np.dtype([(n, k) for n, _, k in whole.PLACE + whole.COLOUR + (whole.NORMAL if normals else [])])
        body = open(path, "rb").read().partition(b"end_header\n")[2]
        assert len(body) == 1000 * kind.itemsize and np.allclose(np.frombuffer(body, kind)["z"], [c[3] for c in cloud(1000)])


def test_empty_cloud_and_ties(spark, tmp_path):
    path = str(tmp_path / "deep" / "e.ply")
    assert whole.write_ply(spark.createDataFrame([], POINTS), path) == 0
    assert files.read_ply(spark, path).count() == 0 and b"element vertex 0\n" in open(path, "rb").read()
    same = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 300, -5, None)] * 50, POINTS)
    assert whole.write_ply(same, path, binary=True) == 50
    assert {(r.x, r.red, r.green, r.blue) for r in files.read_ply(spark, path).collect()} == {(1.0, 255, 0, 0)}


def test_map_with_description(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, "OCCUPIED"), (1, 1, "FREE"), (2, 0, "FREE"), (9, 9, "FREE")], "gx int, gy int, state string")
    whole.write_map(cells, str(tmp_path / "m"), 3, 2, 0.05, (-1.0, 2.5), mode="trinary")
    assert open(tmp_path / "m.pgm", "rb").read() == b"P5\n3 2\n255\n" + bytes([205, 254, 205, 0, 205, 254])
    assert open(tmp_path / "m.yaml").read() == "image: m.pgm\nresolution: 0.05\norigin: [-1.0, 2.5, 0.0]\nnegate: 0\noccupied_thresh: 0.65\nfree_thresh: 0.25\nmode: trinary\n"
    got = whole.read_map(spark, str(tmp_path / "m.yaml")).collect()
    assert {(r.gx, r.gy, r.state) for r in got} == {(0, 0, "OCCUPIED"), (1, 1, "FREE"), (2, 0, "FREE")}
    assert {(r.gx, round(r.x, 6), round(r.y, 6)) for r in got} == {(0, -0.975, 2.525), (1, -0.925, 2.575), (2, -0.875, 2.525)}
    assert sorted(os.listdir(tmp_path)) == ["m.pgm", "m.yaml"]


def test_descriptions_of_other_makers(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("image: 'a.pgm'   # picture\r\nresolution: 0.0300\norigin:\n- -6.9592\n- -11.5\n- 0.1\nnegate: 1\noccupied_thresh: 0.6\n")
    (tmp_path / "b.yaml").write_text('resolution: 1\norigin: [ 1, 2.5 ]\nimage: "/maps/b.pgm"\nfree_thresh: 0.196\n')
    got = {os.path.basename(r.path): r for r in whole.read_map_yaml(spark, str(tmp_path)).collect()}
    a, b = got["a.yaml"], got["b.yaml"]
    assert (a.image.rsplit("/", 1)[1], a.resolution, a.x, a.y, a.turn, a.negate, a.occupied, a.free, a.mode) == ("a.pgm", 0.03, -6.9592, -11.5, 0.1, 1, 0.6, 0.25, "trinary")
    assert (b.image, b.resolution, b.x, b.y, b.turn, b.negate, b.free) == ("/maps/b.pgm", 1.0, 1.0, 2.5, 0.0, 0, 0.196)
    (tmp_path / "a.pgm").write_bytes(b"P5\n# c\n2 1\n255\n" + bytes([254, 0]))
    assert {(r.gx, r.state) for r in whole.read_map(spark, str(tmp_path / "a.yaml")).collect()} == {(0, "OCCUPIED"), (1, "FREE")}


def test_tensor_file(spark, tmp_path):
    want = np.arange(5 * 2 * 21 * 3, dtype="<f4").reshape(5, 2, 21, 3)
    rows = [(f, h, j, *map(float, want[f, h, j])) for f in range(5) for h in range(2) for j in range(21)]
    df = spark.createDataFrame(rows, "frame int, hand int, joint int, x double, y double, z double").repartition(9)
    path = str(tmp_path / "t.npy")
    assert whole.write_npy(df, path, ["frame", "hand", "joint"], ["x", "y", "z"], (2, 21, 3)) == 210
    assert np.array_equal(np.load(path), want) and np.load(path).dtype == np.dtype("<f4")
    np.save(str(tmp_path / "golden.npy"), want)
    assert open(path, "rb").read() == open(tmp_path / "golden.npy", "rb").read()
    with pytest.raises(ValueError, match="whole number of places"):
        whole.write_npy(df.filter("joint < 20"), path, ["frame", "hand", "joint"], ["x", "y", "z"], (2, 21, 3))
    assert sorted(os.listdir(tmp_path)) == ["golden.npy", "t.npy"]


def test_document_of_all_frames(spark, tmp_path):
    head = whole.document_head("hands", "2026-01-02 03:04:05", MAPPING, 960, 600, "optical", "21 joints")
    hands = spark.createDataFrame([(f, h, 1.0, 2.0, 3.0, 4.0, 0.5, [(0.1 * j, 0.2, 1.0, 0.9) for j in range(21)]) for f in range(30) for h in range(2)], "frame long, hand int, x1 double, y1 double, x2 double, y2 double, score double, k array<struct<x:double,y:double,z:double,c:double>>")
    path = str(tmp_path / "d.json")
    assert whole.write_document(D.frame_records(hands).repartition(5), path, head) == 30
    got = json.load(open(path))
    assert {k: v for k, v in got.items() if k != "frames"} == head and got["camera_intrinsics"]["resolution"] == [960, 600]
    assert [f["frame_index"] for f in got["frames"]] == list(range(30)) and all(len(f["hands"]) == 2 for f in got["frames"])
    assert whole.write_document(D.frame_records(hands.limit(0)), path, {}) == 0 and json.load(open(path)) == {"frames": []}


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    bad = F.udf(lambda i: b"x" * (1 // (i - 50)), "binary")
    with pytest.raises(Exception, match="ZeroDivision"):
        whole.write_whole(spark.range(100).select("id", bad("id").alias("body")), ["id"], str(tmp_path / "f"))
    assert os.listdir(tmp_path) == []


def test_clouds_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """No task holds a file, whatever its kind; numbers of points go on over ranges."""
    monkeypatch.setattr(files, "RANGE", 1000)
    df = spark.createDataFrame(cloud(2000), POINTS).repartition(3)
    for binary in (False, True):
        path = str(tmp_path / f"{binary}.ply")
        whole.write_ply(df, path, binary=binary)
        got = files.read_ply(spark, path).withColumn("task", F.spark_partition_id())
        assert max(r["count"] for r in got.groupBy("task").count().collect()) < 2000
    got = files.read_ply(spark, str(tmp_path)).collect()
    for name in ("False", "True"):
        own = sorted((r for r in got if r.path.endswith(f"/{name}.ply")), key=lambda r: r.seq)
        assert [(r.seq, r.red, r.green, r.blue) for r in own] == [(i, *c[4:]) for i, c in enumerate(cloud(2000))]
        assert np.allclose([(r.x, r.y, r.z) for r in own], [c[1:4] for c in cloud(2000)], atol=1e-4)


def test_odd_lines_over_ranges(spark, tmp_path, monkeypatch):
    """Blank lines, other spaces and ends of lines, more on a line than is named, lines behind the last point."""
    head = "ply\r\nformat ascii 1.0\r\nelement vertex {}\r\nproperty float z\nproperty double y\nproperty float x\nend_header\r\n"
    lines = [("1 2 3", "", " 4\t5  6 \r", "7 8 9 more", "1e3 nan -inf", "\r", "0.1 2.5 3")[i % 7] for i in range(300)]
    want = [line.split()[:3] for line in lines[:250] if line.strip()]
    (tmp_path / "o d.ply").write_text(head.format(250) + "\n".join(lines), newline="")
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(files, "RANGE", size)
        got = files.read_ply(spark, str(tmp_path)).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(len(want)))
        assert np.array_equal([(r.z, r.y, r.x) for r in got], np.array(want, float), equal_nan=True)
    (tmp_path / "o d.ply").write_bytes(head.format(2).replace("ascii", "binary_little_endian").encode() + bytes(31))
    with pytest.raises(Exception, match="2 points of 16 bytes are announced"):
        files.read_ply(spark, str(tmp_path)).count()


def test_a_cloud_that_only_spark_can_open(spark, tmp_path):
    df = spark.createDataFrame(cloud(20), POINTS)
    spark.conf.set("fs.viewfs.mounttable.elsewhere.link./in", f"file://{tmp_path}")
    for binary in (False, True):
        whole.write_ply(df, str(tmp_path / "c.ply"), binary=binary)
        got = files.read_ply(spark, "viewfs://elsewhere/in/c.ply").orderBy("seq").collect()
        assert [(r.seq, r.red, r.green) for r in got] == [(i, c[4], c[5]) for i, c in enumerate(cloud(20))]


def test_bodies_are_made_once_in_order(spark, tmp_path):
    """Not once more for the cuts of the order, which read all rows."""
    made = spark.sparkContext.accumulator(0)

    def pack(batch):
        made.add(batch.num_rows)
        return b"".join(i.to_bytes(2, "big") for i in batch.column("id").to_pylist())

    assert whole.write_whole(spark.range(999, -1, -1, 5), ["id"], str(tmp_path / "f"), columns=["id"], pack=pack, between=b"") == 1000
    assert (tmp_path / "f").read_bytes() == b"".join(i.to_bytes(2, "big") for i in range(1000)) and made.value == 1000
