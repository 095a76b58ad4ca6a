"""Trackers over frames without detections: tables and streams against a loop that calls the tracker for every frame."""

import random

import pytest
from pyspark.sql import functions as F

from motionlake.plans import record_queries  # noqa: F401  adds its queries
from motionlake.plans.queries import QUERIES
from motionlake.streaming import filters as L
from motionlake.streaming import poses as K

SF = "/root/testdata/sf0.001"
FLAT = "stream long, frame long, det int, t double, x double, y double, side string"
POSED = f"{FLAT}, k array<struct<x:double,y:double,c:double>>"
EPOCH = 1_700_000_000


def scene(seed, streams=3, frames=120, joints=3):
    """Rows of detections that move, come and go; about a third of the frames have none, some gaps are long."""
    rng = random.Random(seed)
    rows = []
    for s in range(streams):
        places = [(rng.random() * 900, rng.random() * 500) for _ in range(10)]
        silent = set()
        for _ in range(6):
            a = rng.randrange(frames)
            silent |= set(range(a, a + rng.choice([1, 2, 7, 8, 9, 10, 15])))
        for f in range(frames):
            places = [(x + rng.gauss(0, 9), y + rng.gauss(0, 9)) for x, y in places]
            if f in silent:
                continue
            seen = [i for i in range(len(places)) if rng.random() < 0.35]
            rows += [
                (s, f, d, f / 30, *places[i], rng.choice(["Left", "Right", "Unknown"]), [(rng.random() * 99, rng.random() * 99, rng.choice([0.1, 0.2, 0.9])) for _ in range(joints)])
                for d, i in enumerate(seen)
            ]
    return rows


def looped(rows, made, call, frames):
    """Every frame of every stream in order, empty ones included."""
    out = []
    for s in sorted({r[0] for r in rows}):
        tracker = made()
        for f in frames:
            found = sorted((r for r in rows if r[0] == s and r[1] == f), key=lambda r: r[2])
            out += [(s, f, r[2], *given) for r, given in zip(found, call(tracker, f / 30, found))]
    return out


CASES = {
    "hands": (L.HandTracker, lambda h, t, rows: h.frame(t, [r[4:7] for r in rows]), L.hand_tracks, L.hand_tracks_stream),
    "bodies": (L.BodyTracker, lambda b, t, rows: [(i,) for i in b.frame([r[4:6] for r in rows])], L.body_tracks, L.body_tracks_stream),
    "hand_poses": (K.HandPoses, lambda h, t, rows: h.frame(t, [r[4:8] for r in rows]), K.hand_poses, K.hand_poses_stream),
    "body_poses": (K.BodyPoses, lambda b, t, rows: b.frame(t, [(*r[4:6], r[7]) for r in rows]), K.body_poses, K.body_poses_stream),
}


def comparable(rows):
    flat = []
    for r in rows:
        r = list(r)
        if isinstance(r[-1], list):
            r[-1] = [tuple(round(v, 9) for v in tuple(j)) for j in r[-1]]
        flat.append(tuple(r))
    return sorted(flat, key=repr)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rows_of_batch", ["7", "10000"])
def test_gaps_count_on_tables(spark, case, rows_of_batch):
    made, call, batch, _ = CASES[case]
    rows = scene(len(case))
    want = comparable(looped(rows, made, call, range(140)))
    df = spark.createDataFrame(rows, POSED)
    every = spark.range(3).withColumnRenamed("id", "stream").crossJoin(spark.range(140).selectExpr("id AS frame", "id / 30D AS t"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, rows_of_batch)
        assert comparable(batch(df).collect()) == want
        assert comparable(batch(df, frames=every).collect()) == want
        assert comparable(batch(df, period=1 / 30).collect()) == want
    finally:
        spark.conf.set(name, before)


def test_hands_that_stay_away_come_back_as_new(spark):
    rows = [(0, f, 0, f / 30, 50.0, 50.0, "Left") for f in (0, 1, 10, 20)]
    got = {r.frame: r.track for r in L.hand_tracks(spark.createDataFrame(rows, FLAT)).collect()}
    assert got == {0: 0, 1: 0, 10: 0, 20: 1}  # 8 missing frames are forgiven, 9 are not


def test_frames_that_were_not_recorded_are_not_missing(spark):
    rows = spark.createDataFrame([(0, f, 0, f / 30, 50.0, 50.0, "Left") for f in (0, 100)], FLAT)
    frames = spark.createDataFrame([(0, 0, 0.0), (0, 100, 3.3)], "stream long, frame long, t double")
    assert {r.track for r in L.hand_tracks(rows, frames=frames).collect()} == {0}
    assert {r.track for r in L.hand_tracks(rows).collect()} == {0, 1}


def test_bodies_go_after_one_empty_frame(spark):
    rows = [(0, 0, 0, 0.0, 10.0, 0.0, ""), (0, 0, 1, 0.0, 900.0, 0.0, ""), (0, 100, 0, 3.3, 900.0, 0.0, "")]
    got = {(r.frame, r.det): r.person for r in L.body_tracks(spark.createDataFrame(rows, FLAT)).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (100, 0): 0}


def test_a_ninth_person_starts_anew():
    bodies = K.BodyPoses()
    joint = lambda x: [(x, 0.0, 0.9)]
    first = bodies.frame(0.0, [(1000.0 * i, 0.0, joint(1.0)) for i in range(8)])
    assert [i for i, _ in first] == list(range(8))
    (_, _), *rest = bodies.frame(0.1, [(1000.0 * i, 0.0, joint(1.0)) for i in range(8)] + [(50_000.0, 0.0, joint(77.0))])
    assert rest[-1] == (0, joint(77.0))  # an old filter would draw it to 1


def test_keys_of_text_and_odd_frames(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.0, 1.0, 1.0, "Left"), ("a", 1, None, 0.1, None, None, None), (None, 0, 0, 0.0, 1.0, 1.0, "Left")], FLAT.replace("stream long", "stream string"))
    assert sorted(map(tuple, L.hand_tracks(df).collect()), key=repr) == [("a", 0, 0, 0, "Left"), (None, 0, 0, 0, "Left")]
    assert L.hand_tracks(df.limit(0)).count() == 0


@pytest.fixture()
def many_states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def run(spark, made, folder, name, sources):
    """One run over what is in the source folder, and stop; the checkpoint stays."""
    q = made(sources).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("case", ["hands", "body_poses"])
def test_streams_give_what_tables_give_also_after_a_restart(spark, tmp_path, many_states, case):
    _, _, batch, stream = CASES[case]
    rows = scene(7, streams=2, frames=60)
    df = spark.createDataFrame(rows, POSED).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col("frame") / 30))
    last = spark.createDataFrame([(s, 9000, None, 300.0, None, None, None, None) for s in (0, 1)], POSED).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH + 300.0)))
    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "400 milliseconds")
    parts = [df.filter("frame < 25"), df.filter("frame BETWEEN 25 AND 39 OR frame = 41"), df.filter("frame >= 40 AND frame <> 41"), last]  # frame 41 comes early
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, lambda d: stream(d, period=1 / 30), tmp_path, "out", read())  # each run starts again from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out"))
    assert comparable(got.collect()) == comparable(batch(df, period=1 / 30).collect())


def test_tracker_queries_have_streams_by_the_table(spark):
    for name, column in (("hand_tracker", "track"), ("body_tracker", "person"), ("hand_pose_tracks", "track"), ("body_pose_tracks", "person")):
        got = QUERIES[name](spark, SF)
        assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count() and got.filter(F.col(column).isNull()).count() == 0
