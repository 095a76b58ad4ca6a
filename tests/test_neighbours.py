"""The k nearest points against all distances, on even, crowded and odd clouds."""

import numpy as np
import pytest

from motionlake import proxies as P
from motionlake.operators import neighbours as N
from motionlake.plans.queries import QUERIES

SCHEMA = "id long, x double, y double, z double"


def brute(points, cloud, k):
    out = {}
    for i, *p in points:
        d = sorted((float(np.sum((np.array(p) - np.array(q)) ** 2)), j) for j, *q in cloud)
        out[i] = [(j, d2) for d2, j in d[:k]]
    return out


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("kind", ["even", "crowded", "line", "equal"])
def test_nearest_equal_all_distances(spark, monkeypatch, k, kind):
    monkeypatch.setattr(N, "ASKED", 40)
    monkeypatch.setattr(N, "TILE", 999)
    rng = np.random.default_rng(3)
    where = rng.random((300, 3)) * 10
    if kind == "crowded":
        where[:250] = 5 + where[:250] / 1e4
    if kind == "line":
        where[:, 1:] = 0
    if kind == "equal":
        where[:200] = 1.0
    cloud = [(1000 + i, *map(float, p)) for i, p in enumerate(where)]
    points = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.random((80, 3)) * 12 - 1, where[:40], rng.random((5, 3)) * 1000]))]
    got = N.nearest_k(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(cloud, SCHEMA), k, cell=20)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], {})[r["rank"]] = (r.other, r.distance)
    want = brute(points, cloud, k)
    assert found.keys() == want.keys()
    for i, ranks in found.items():
        assert sorted(ranks) == list(range(1, k + 1))
        assert np.allclose([ranks[r + 1][1] for r in range(k)], [np.sqrt(d2) for _, d2 in want[i]])
        if kind != "equal":
            assert [ranks[r + 1][0] for r in range(k)] == [j for j, _ in want[i]]
        else:
            assert ranks[1][0] == want[i][0][0]


def test_cells_of_a_crowded_cloud_are_even():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.random((900, 3)) / 1e6, rng.random((100, 3)) * 1000])
    tree = N.Tree.grown(points, 16)
    count = np.bincount(tree.cell(points), minlength=len(tree.low))
    assert len(count) == 16 and count.max() < 2 * 1000 / 16


def test_odd_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0)], SCHEMA)
    cloud = spark.createDataFrame([(7, 3.0, 4.0, 0.0), (8, None, 1.0, 1.0)], SCHEMA)
    assert [tuple(r) for r in N.nearest_k(points, cloud, 3).collect()] == [(1, 1, 7, 5.0)]
    assert N.nearest_k(points, cloud.limit(0)).count() == 0 and N.nearest_k(points.limit(0), cloud).count() == 0


def most_joined(spark, since):
    """The most rows that a join has given in the executions from `since` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(since, store.executionsCount()):
        run = store.executionsList().apply(i)
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["nearest_point", "nearest_point_all"])
def test_crowded_points_are_not_all_compared(spark, monkeypatch, name):
    """All poses within a few centimetres, so within one cell of any grid as wide as the distances."""
    rng = np.random.default_rng(5)
    where = np.round(rng.random((4000, 3)) / 10, 5)
    poses = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(where)], SCHEMA).repartition(4)
    messages = spark.range(4000).selectExpr("id", f"if(id % 2 = 0, '{P.LEFT}', 'other') AS topic")
    monkeypatch.setattr(P, "poses", lambda *_: poses)
    monkeypatch.setattr(P, "messages", lambda *_: messages)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.id: r.distance for r in QUERIES[name](spark, "").collect()}
    d = np.sqrt(((where[1::2, None] - where[None, ::2]) ** 2).sum(axis=2).min(axis=1))
    assert sorted(got) == list(range(1, 4000, 2)) and np.allclose([got[i] for i in sorted(got)], d, atol=1e-6)
    assert most_joined(spark, since) <= 4000 * 4
