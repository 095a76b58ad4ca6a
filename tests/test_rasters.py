"""Resampling, suppression, percentiles and peaks against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions import colours as C
from motionlake.operators import detections as D
from motionlake.operators import rasters as I
from motionlake.operators import selection as S
from motionlake.operators import trajectory as R


def bilinear(p, x, y):
    """One value of p[line][column][channel]."""
    h, w = len(p), len(p[0])
    x0, y0 = int(x), int(y)
    x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
    dx, dy = x - x0, y - y0
    return [(1 - dx) * (1 - dy) * a + dx * (1 - dy) * b + (1 - dx) * dy * c + dx * dy * d for a, b, c, d in zip(p[y0][x0], p[y0][x1], p[y1][x0], p[y1][x1])]


@pytest.mark.parametrize("size", [(1, 1), (3, 7), (13, 5), (40, 33), (7, 64)])
@pytest.mark.parametrize("tile", [1 << 18, 8])
def test_resizing_against_a_loop(monkeypatch, size, tile):
    monkeypatch.setattr(I, "TILE", tile)
    rng = np.random.default_rng(1)
    width, height = size
    for h, w in ((9, 11), (1, 4), (5, 1), (32, 17)):
        picture = rng.random((h, w, 3))
        want = [
            [bilinear(picture.tolist(), min(max((u + 0.5) * w / width - 0.5, 0), w - 1), min(max((v + 0.5) * h / height - 0.5, 0), h - 1)) for u in range(width)] for v in range(height)
        ]
        assert np.allclose(I.resize(picture, width, height), want)


def test_maps_against_a_loop(monkeypatch):
    monkeypatch.setattr(I, "TILE", 20)
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (6, 9, 3)).astype(float)
    x, y = rng.random((10, 8)) * 13 - 2, rng.random((10, 8)) * 9 - 2
    x[0, :4], y[0, :4] = [0, 8, 7.999, math.inf], [0, 0, 4.999, 1]
    want = [[bilinear(picture.tolist(), a, b) if 0 <= a < 8 and 0 <= b < 5 else [0, 0, 0] for a, b in zip(*r)] for r in zip(x.tolist(), y.tolist())]
    assert np.allclose(I.remap(picture, x, y), want)


def test_rasters_of_a_table(spark):
    rows = [(1, 3, 2, [1.0, 2.0, None, 4.0, 5.0, 6.0], "a"), (2, 2, 2, [1.0], "b"), (3, None, 2, [1.0, 2.0], "c"), (4, 1, 1, None, "d"), (5, 0, 0, [], "e"), (6, 1, 1, [7.0], None)]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels array<double>, note string")
    out = I.rescaled(df, 6, 4)
    assert out.columns == ["id", "note", "width", "height", "pixels"]
    got = {r.id: r for r in out.collect()}
    want = np.array(I.resize(np.array([1.0, 2, 0, 4, 5, 6]).reshape(2, 3, 1), 6, 4)).ravel() * 2
    assert np.allclose(got[1].pixels, want) and (got[1].width, got[1].height) == (6, 4) and got[6].pixels == [42.0] * 24
    assert all(got[i].pixels is None and got[i].width is None for i in (2, 3, 4, 5))
    assert I.resized(df.limit(0), 3, 3).count() == 0
    one = spark.createDataFrame([(1, 2, 1, [0.0, 255.0, 10.0, 20.0, 30.0, 40.0])], "id long, width int, height int, pixels array<double>")
    flat = I.normalised(one, (1.0, 2.0, 3.0), (2.0, 4.0, 8.0), turned=True).first().pixels
    assert np.allclose(flat, [(10 - 1) / 2, (40 - 1) / 2, (255 - 2) / 4, (30 - 2) / 4, (0 - 3) / 8, (20 - 3) / 8])
    bad = I.remapped(one.withColumns({"map_x": F.array(F.lit(0.0)), "map_y": F.lit(None).cast("array<double>")}), 1, 1, channels=3).first()
    assert bad.pixels is None


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def iou(a, b):
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    both = area(a) + area(b) - shared
    return shared / both if both > 0 else 0


@pytest.mark.parametrize("most", [0.5, 0.6])
def test_suppression_against_a_loop(spark, most):
    rng = random.Random(8)
    rows = []
    for f in range(200):
        for d in range(rng.randrange(25)):
            x, y = rng.randrange(40), rng.randrange(40)
            rows.append((f, d, float(x), float(y), float(x + rng.randrange(-1, 30)), float(y + rng.randrange(30)), rng.choice([0.1, 0.5, 0.9, rng.random()])))
    want = []
    for f in range(200):
        own = sorted((r for r in rows if r[0] == f and r[6] > 0.2), key=lambda r: (-r[6], r[1]))[:15]
        kept = []
        for r in own:
            if len(kept) < 6 and all(iou(k[2:6], r[2:6]) <= most for k in kept):
                kept.append(r)
        want += [(f, r[1], i + 1) for i, r in enumerate(kept)]
    df = spark.createDataFrame([*rows, (0, 99, None, 0.0, 1.0, 1.0, 5.0), (0, 98, 0.0, 0.0, 1.0, 1.0, None)], "frame int, det int, x1 double, y1 double, x2 double, y2 double, score double")
    got = D.suppressed(df, most, least_score=0.2, looked_at=15, kept=6)
    assert sorted((r.frame, r.det, r["rank"]) for r in got.collect()) == sorted(want)
    assert D.suppressed(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PARTS = [0.0, 0.02, 0.5, 0.5, 0.98, 1.0]


@pytest.mark.parametrize("few", [0, 1024])
def test_percentiles_of_odd_tables(spark, few):
    rng = random.Random(3)
    tables = {
        "even": [rng.random() for _ in range(3000)], "hot": [1.0] * 2000 + [rng.random() for _ in range(1000)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(1500)],
        "two": [3.0, 1.0], "same": [2.5] * 100, "endless": [math.inf, -math.inf, 1e17, 1e17 + 16, 1e17 + 32] * 50 + [0.0] * 7,
    }
    for name, values in tables.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = S.percentiles(df, F.col("x"), PARTS, bins=64 if name == "hot" else 4096, few=few)
        want = df.agg(F.percentile("x", F.lit(PARTS))).first()[0]
        for g, w in zip(got, want):
            assert g == pytest.approx(w, rel=1e-12) or (math.isnan(g) and math.isnan(w)) or g == w, name
    assert S.percentiles(spark.createDataFrame([(None,)], "x double"), F.col("x"), [0.5]) == [None]
    odd = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double")
    assert S.percentiles(odd, F.col("x"), [0.0, 0.5])[:2] == [1.0, 2.0] and math.isnan(S.percentiles(odd, F.col("x"), [1.0])[0])


def test_levels_of_an_empty_table_and_of_one_height(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "z double")
    assert [r.level for r in C.elevation(df, F.col("z")).orderBy(F.col("z").isNull()).collect()] == [0.0, 0.0, None]
    assert C.elevation(df.limit(0), F.col("z")).count() == 0


def plain_peaks(values, prominence, distance):
    """Peaks of a series by looking at all of it for each: (place, prominence)."""
    found, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j < n - 1 and values[j + 1] == values[i]:
                j += 1
            if j < n - 1 and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept = []
    for p in sorted(found, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        sides = []
        for side in (values[p::-1], values[p:]):
            end = next((k for k, v in enumerate(side) if v > values[p]), len(side))
            sides.append(min(side[:end]))
        rise = values[p] - max(sides)
        if rise >= prominence:
            out.append((p, rise))
    return out


def series(rng):
    n, kind = rng.randrange(0, 120), rng.randrange(4)
    steps = [float(rng.choice([rng.randrange(6), rng.random() * 5]) if kind == 0 else rng.randrange(4) if kind == 1 else round(rng.gauss(0, 1) * 3)) for _ in range(n)]
    return np.cumsum(steps).tolist() if kind == 3 else steps


@pytest.mark.parametrize("row", [3, 64])
def test_peaks_in_parts_against_a_loop(monkeypatch, row):
    monkeypatch.setattr(R.PeakScan, "ROW", row)
    rng = random.Random(0)
    for _ in range(1500):
        values, prominence, distance = series(rng), rng.choice([0.0, 0.5, 1, 2, 5]), rng.choice([1, 2, 3, 7, 20])
        scan, i, got = R.PeakScan(prominence, distance), 0, []
        while i < len(values):
            step = rng.randrange(1, 9)
            scan.add(values[i : i + step])
            got += scan.taken()
            i += step
        got += scan.ended()
        assert sorted((p, pytest.approx(rise)) for p, _, rise in got) == plain_peaks(values, prominence, distance)
        assert all(values[p] == h for p, h, _ in got)


def test_a_long_series_is_linear_and_keeps_little():
    scan = R.PeakScan(0.5, 50)
    n, most = 300_000, 0
    for i in range(0, n, 1000):
        scan.add([math.sin(k / 40) + 0.3 * math.sin(k / 3) + (k % 7) / 100 for k in range(i, i + 1000)])
        scan.taken()
        most = max(most, len(scan.waiting) + len(scan.higher) + len(scan.row) + len(scan.kept))
    assert most < 2000


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_peaks_of_a_table(spark, batch):
    rng = random.Random(5)
    walks = {k: series(rng) for k in ("a", "b", None)}
    df = spark.createDataFrame([(k, i, v) for k, vs in walks.items() for i, v in enumerate(vs)], "bag string, seq long, z double").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        got = R.peak_rows(df, "z", 1.0, 3).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(((r.bag, r.place) for r in got), key=repr) == sorted(((k, p) for k, vs in walks.items() for p, _ in plain_peaks(vs, 1.0, 3)), key=repr)
