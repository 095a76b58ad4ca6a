"""Scans over keys that are cut into ranges, against the same along whole keys."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from motionlake.operators import pairing as A
from motionlake.operators import scans as S
from motionlake.operators import timeseries as T
from motionlake.operators import trajectory as R
from motionlake.plans import frame_queries  # noqa: F401  adds its queries
from motionlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, seed=1, keys=("a", "a", "a", "b", None), n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, rng.randrange(200), rng.choice([None, None, rng.randrange(1000)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "bag string, id long, us long, v long")


@pytest.mark.parametrize("ranges", [1, 3, 17, 300])
def test_all_kinds_of_scans(spark, ranges):
    rows, df = table(spark)
    got = S.scanned(
        df, ["bag"], ["us", "id"], before={"last": F.col("v")}, after={"next": F.col("v")}, previous={"row": F.col("id"), "old": F.col("v")}, sums={"total": F.col("v"), "place": F.lit(1)}, ranges=ranges,
    )
    got = {r.id: (r["last"], r["next"], r["row"], r["old"], r["total"], r["place"]) for r in got.collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        last, total, before = None, None, (None, None)
        for i, (_, id_, _, v) in enumerate(own):
            last = v if v is not None else last
            total = total if v is None else (total or 0) + v
            after = next((x[3] for x in own[i:] if x[3] is not None), None)
            assert got[id_] == (last, after, *before, total, i + 1)
            before = (id_, v)
    assert len(got) == len(rows)


@pytest.mark.parametrize("ranges", [2, 13])
def test_neighbours_and_next_right_of_cut_keys(spark, ranges):
    _, left = table(spark, 2)
    _, right = table(spark, 3, n=150)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    columns = ["bag", "us", "id", "before_us", "after_us"]
    assert rows(T.neighbours(left, right, ranges=ranges).select(columns)) == rows(T.neighbours(left, right).select(columns))
    for join in (T.nearest, T.forward, A.next_right):
        whole, cut = join(left, right), join(left, right, ranges=ranges)
        assert cut.columns == whole.columns and rows(cut) == rows(whole) and cut.count() > 0
    assert T.neighbours(left, right.limit(0), ranges=ranges).filter("before_us IS NULL AND after_us IS NULL").count() == left.count()
    assert T.neighbours(left.limit(0), right, ranges=ranges).count() == 0


def test_distance_travelled_over_ranges(spark):
    rng = random.Random(4)
    poses = spark.createDataFrame([(b, i, i / 10, rng.random(), rng.random(), rng.random()) for b in range(3) for i in range(200)], "bag long, seq long, ts double, x double, y double, z double")
    whole = {(r.bag, r.seq): (r.step, r.dt, r.distance) for r in R.travelled(poses).collect()}
    cut = {(r.bag, r.seq): (r.step, r.dt, r.distance) for r in R.travelled(poses, ranges=7).collect()}
    assert whole.keys() == cut.keys()
    for k, v in whole.items():
        assert cut[k] == pytest.approx(v, nan_ok=True) if None not in v else cut[k] == v


def test_one_long_key_is_many_tasks(spark, monkeypatch):
    """The rows of one recording, in as many tasks as ranges, found to be long by their number."""
    n = 20_000
    left = spark.range(n).select(F.lit("x").alias("bag"), (F.col("id") * 3).alias("us"), "id")
    right = spark.range(n).select(F.lit("x").alias("bag"), (F.col("id") * 5 + 1).alias("us"), "id")
    monkeypatch.setattr(S, "LONG_KEY", 1000)
    monkeypatch.setattr(T, "has_long_key", lambda df, key: S.has_long_key(df, key, 1000))
    out = T.neighbours(left, right).cache()
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < n
    rights = [5 * i + 1 for i in range(n)]
    for r in out.sample(0.01, 3).collect():
        at = bisect.bisect_right(rights, r.us)
        assert (r.before_us, r.after_us) == (rights[at - 1] if at else None, rights[at] if at < n else None)
    out.unpersist()


def test_new_columns_may_be_named_like_the_key(spark):
    df = spark.createDataFrame([(7, i, i if i % 3 else None) for i in range(30)], "bag long, us long, v long")
    out = S.scanned(df, ["bag"], ["us"], before={"bag": F.col("v")}, sums={"_rows": F.col("v")}, ranges=4)
    want, last, total = [], None, None
    for i in range(30):
        if i % 3:
            last, total = i, (total or 0) + i
        want.append((i, last, total))
    assert sorted((r.us, r.bag, r._rows) for r in out.collect()) == want


def test_long_key_queries(spark):
    for name in ("asof_long_key", "next_right_long_key"):
        out = QUERIES[name](spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "us#" in line]
        assert out.count() > 0 and windows and all("windowspecdefinition(_range#" in line for line in windows)
