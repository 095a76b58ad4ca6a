"""Bones from tables, places on an axis, peaks in a crop, held-up depths, array files."""

import numpy as np
from pyspark.sql import functions as F

from motionlake.functions import geometry as G
from motionlake.functions import pose as J
from motionlake.operators import trajectory as R
from motionlake.sources import files


def test_bone_tables_and_parts(spark):
    hand = J.bone_table(spark).collect()
    assert len(hand) == 23 and [r.part for r in hand].count("palm") == 8 and len({(r.a, r.b) for r in hand}) == 23
    body = J.bone_table(spark, J.BODY_BONES, J.body_part).collect()
    assert len(body) == 16 and {r.part for r in body} == {"head", "l_arm", "r_arm", "torso", "l_leg", "r_leg"}
    joints = [(float(i), -float(i), 0.9 if i != 6 else 0.25) for i in range(21)]
    df = spark.createDataFrame([(1, joints), (2, joints[:6]), (3, None)], "frame long, k array<struct<x:double,y:double,c:double>>")
    got = J.bone_segments(df, J.bone_table(spark), ["frame"]).collect()
    assert sum(r.frame == 1 for r in got) == 21 and sum(r.frame == 2 for r in got) == 5 and all(r.frame != 3 for r in got)
    assert {(r.ax, r.bx, r.by) for r in got if r.frame == 1 and r.bone == 0} == {(0.0, 1.0, -1.0)}


def test_places_on_the_axis_do_not_go_back(spark):
    rows = [(b, i, s * i + 0.01 * (i % 3), s * 0.5 * i) for b, s in ((1, 1.0), (2, -1.0)) for i in range(20)]
    df = R.along_axis(spark.createDataFrame(rows, "bag long, seq long, x double, y double"))
    for b in (1, 2):
        at = [r.along for r in df.filter(F.col("bag") == b).orderBy("seq").collect()]
        xy = np.array([r[2:] for r in rows if r[0] == b])
        values, vectors = np.linalg.eigh(np.cov(xy.T))
        want = xy @ vectors[:, np.argmax(values)]
        want = -want if want[-1] < want[0] else want
        assert np.allclose(at, want) and at[-1] > at[0]


def test_peaks_in_a_crop_and_held_up_depth(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.2, 0.9], [0.5, 0.4], 0.2), ([1.0], [0.3, 0.3], 50.0)], "x array<double>, y array<double>, d double")
    found = J.simcc_in_crop(F.col("x"), F.col("y"), F.lit(100), F.lit(10), F.lit(40), F.lit(20))
    got = df.select(found.alias("j"), G.depth_clamped(F.col("d")).alias("z")).collect()
    assert [tuple(r.j) for r in got] == [(110.0, 10.0, 0.45), (100.0, 10.0, 0.3)]
    assert np.allclose([r.z for r in got], [366.6111 * 0.0624 / 0.5, 366.6111 * 0.0624 / 50])


def test_array_files_of_any_shape(spark, tmp_path):
    for shape in ((5,), (3, 4, 2), (0, 3)):
        path, want = str(tmp_path / f"a{len(shape)}.npy"), np.arange(int(np.prod(shape)), dtype="<f4").reshape(shape)
        np.save(path, want)
        got = files.read_npy(spark, path, 7).orderBy("at").collect()
        assert [(r["at"], r.value) for r in got] == list(enumerate(want.ravel().tolist()))
