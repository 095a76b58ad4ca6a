"""Queries on frames and long keys against their SQL; folds over many batches; loose readers."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake import proxies as P
from motionlake.operators import spatial as S
from motionlake.operators import timeseries as T
from motionlake.plans import frame_queries
from motionlake.plans.queries import ORACLE_SQL, QUERIES
from motionlake.sources import files
from motionlake.streaming import filters as L

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == frame_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_frame_query(spark, name):
    con = duckdb.connect()
    for t in "orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_asof_on_one_long_key(spark):
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.integers(0, 10**9, 60_000)), np.unique(rng.integers(0, 10**9, 60_000))
    frame = lambda v: spark.createDataFrame([(1, int(x), i) for i, x in enumerate(v)], "bag long, us long, id long")
    began = time.perf_counter()
    rows = T.neighbours(frame(a), frame(b)).orderBy("id").collect()
    assert time.perf_counter() - began < 60
    at = np.searchsorted(b, a, "right")
    assert [r.before_us for r in rows] == [int(b[i - 1]) if i else None for i in at]
    assert [r.after_us for r in rows] == [int(b[i]) if i < len(b) else None for i in at]


def test_folds_do_not_depend_on_batches(spark):
    rng = random.Random(6)
    rows = [(s, f, d, f / 30, rng.random() * 900, rng.random() * 500, rng.choice(["Left", "Right", "Unknown"])) for s in range(3) for f in range(40) for d in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "stream long, frame long, det int, t double, x double, y double, side string")
    values = spark.createDataFrame([(s, f, t, None if f == 5 else x) for s, f, _, t, x, _, _ in rows], "bag long, id long, t double, x double").dropDuplicates(["bag", "id"])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    out = []
    try:
        for size in ("5", "10000"):
            spark.conf.set(name, size)
            out.append([sorted(map(tuple, df_.collect()), key=repr) for df_ in (L.hand_tracks(df), L.body_tracks(df), L.one_euro(values, "bag"))])
    finally:
        spark.conf.set(name, before)
    assert out[0] == out[1] and len(out[0][0]) == len(rows)


def test_one_euro_starts_anew_after_null(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.1, None), (1, 3, 0.2, 5.0)], "bag long, id long, t double, x double")
    assert [r.smooth for r in L.one_euro(df, "bag").orderBy("id").collect()] == [1.0, None, 5.0]


def test_nearest_distance_of_odd_points(spark):
    schema = "seq long, x double, y double, z double"
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1e6, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0)], schema)
    cloud = spark.createDataFrame([(1, 3.0, 4.0, 0.0)], schema)
    got = {r.seq: r.distance for r in S.nearest_distance(points, cloud, 0.5).collect()}
    assert got[1] == 5.0 and abs(got[2] - 999997.0) < 1e-3 and got[3] is None and got[4] is None
    assert {r.distance for r in S.nearest_distance(points, cloud.limit(0), 0.5).collect()} == {None}


def test_loose_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 2 3 4\n\n1,2,3,4,0.5,0.5,0.5,0.5,9\n1 2 x 4\n1 2 3\n")
    got = [tuple(r)[1:] for r in files.read_loose(spark, str(tmp_path / "a.txt")).collect()]
    assert got == [(1, 2, 3, 4, 0, 0, 0, 1), (1, 2, 3, 4, 0.5, 0.5, 0.5, 0.5)]
    (tmp_path / "b.csv").write_text("t,x,y,z\n1,2,3,4,\n\n5,6,7\n")
    assert [tuple(r)[1:] for r in files.read_positions(spark, str(tmp_path / "b.csv")).collect()] == [(2, 3, 4)]
    (tmp_path / "c.csv").write_text("#timestamp [ns],filename\n100, a.png\n200,b.png\n")
    assert [tuple(r) for r in files.read_index(spark, str(tmp_path / "c.csv")).collect()] == [(100, "a.png"), (200, "b.png")]


def test_anti_proximity_reads_all_poses(spark):
    assert P.poses(spark, SF).select("bag").distinct().count() > 1
    far = QUERIES["anti_proximity"](spark, SF)
    assert far.filter(F.col("frame").isNull()).count() == 0
