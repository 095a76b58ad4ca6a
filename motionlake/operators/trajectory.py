"""Trajectories: lengths, drift, speed, smoothing, segments, alignment and error scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folds import folded
from .scans import RANGE, has_long_key, scanned

KEY = ("bag",)


def _w(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("seq")


def norm(*parts: Column) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def steps(poses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """poses with the step length and the time since the pose before; null at the first."""
    w = _w(key)
    return poses.withColumns({"step": norm(*(F.col(a) - F.lag(a).over(w) for a in "xyz")), "dt": F.col("ts") - F.lag("ts").over(w)})


def summary(poses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per run: length, displacement, drift, step errors, speeds, heights and the flying-point verdict."""
    half = lambda q: F.struct(F.col("x"), F.col("y"), F.col("z"), q.alias("yaw"))
    yaw = F.atan2(2 * F.col("qw") * F.col("qz"), 1 - 2 * F.col("qz") * F.col("qz"))
    s = steps(poses, key).groupBy(*key).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"),
        F.min_by(half(yaw), "seq").alias("a"), F.max_by(half(yaw), "seq").alias("b"),
        (F.max("ts") - F.min("ts")).alias("duration_s"),
        F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("step_rmse"), F.avg("step").alias("step_mean"), F.stddev_pop("step").alias("step_std"), F.max("step").alias("step_max"),
        F.percentile(F.when(F.col("dt") > 1e-4, F.col("step") / F.col("dt")), 0.99).alias("speed_p99"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"),
    )
    turn = F.abs(F.col("b.yaw") - F.col("a.yaw"))
    wrapped = F.abs(F.pmod(turn + F.lit(np.pi), F.lit(2 * np.pi)) - F.lit(np.pi))
    s = s.withColumns({
        "net_m": norm(*(F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz")),
        "xy_error_m": norm(*(F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xy")),
        "z_drift_m": F.col("b.z") - F.col("a.z"),
        "yaw_drift_deg": F.degrees(wrapped),
    })
    mean = F.when(F.col("duration_s") > 0, F.col("length_m") / F.col("duration_s")).otherwise(F.lit(0.0))
    return s.withColumns({
        "drift_percent": F.col("net_m") / F.greatest(F.col("length_m"), F.lit(1e-3)) * 100,
        "mean_speed": mean, "max_speed": F.coalesce("speed_p99", mean),
        "rejected": F.col("n") < 10,
        "flying": (F.col("z_max") - F.col("z_min") > 2.5) | (F.coalesce("step_max", F.lit(0.0)) > 1.5) | (F.col("n") < 50),
    }).drop("a", "b", "speed_p99")


def travelled(poses: DataFrame, key: Sequence[str] = KEY, ranges: int | None = None) -> DataFrame:
    """poses with the step before, its time and the distance travelled so far; long runs are cut into ranges, always where `ranges` tells how many."""
    if not (ranges or has_long_key(poses, key)):
        w = _w(key).rowsBetween(Window.unboundedPreceding, 0)
        return steps(poses, key).withColumn("distance", F.sum(F.coalesce("step", F.lit(0.0))).over(w))
    rows = scanned(poses, key, ["seq"], previous={"_p": F.struct("x", "y", "z", "ts")}, ranges=ranges)
    step = norm(*(F.col(a) - F.col(f"_p.{a}") for a in "xyz"))
    rows = rows.withColumns({"step": step, "dt": F.col("ts") - F.col("_p.ts")}).drop("_p")
    return scanned(rows, key, ["seq"], sums={"distance": F.coalesce("step", F.lit(0.0))}).drop(RANGE)


def smoothed7(df: DataFrame, column: str, key: Sequence[str] = KEY) -> DataFrame:
    """Mean of seven rows with the edge values repeated; the end rows and series under seven stay."""
    w, whole = _w(key), Window.partitionBy(*key)
    near = w.rowsBetween(-3, 3)
    d = df.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(w) - 1})
    d = d.withColumns({"_a": F.max(F.when(F.col("_i") == 0, F.col(column))).over(whole), "_b": F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col(column))).over(whole), "_s": F.sum(column).over(near)})
    low, high = F.greatest(F.lit(0), 3 - F.col("_i")), F.greatest(F.lit(0), F.col("_i") + 4 - F.col("_n"))
    mean = (F.col("_s") + low * F.col("_a") + high * F.col("_b")) / 7
    end = (F.col("_n") < 7) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    return d.withColumn("smooth", F.when(end, F.col(column)).otherwise(mean)).drop("_n", "_i", "_a", "_b", "_s")


def gradient(df: DataFrame, column: str, key: Sequence[str] = KEY) -> DataFrame:
    """Central differences, one-sided at the ends; null for a single row."""
    w = _w(key)
    before, after, own = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    return df.withColumn("gradient", F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2))


def slope(poses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Regression of height on distance, and the pitch that it means."""
    d = travelled(poses, key).groupBy(*key).agg(F.regr_slope("z", "distance").alias("slope"), F.regr_intercept("z", "distance").alias("intercept"))
    return d.withColumn("pitch_deg", F.degrees(F.asin(F.least(F.abs("slope"), F.lit(1.0)))))


def principal_axis(poses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Larger eigenvalue and direction of the 2x2 covariance of x and y."""
    c = poses.groupBy(*key).agg(F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("c")).filter("a IS NOT NULL")
    value = (F.col("a") + F.col("c")) / 2 + F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    return c.select(*key, value.alias("eigenvalue"), (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"))


def along_axis(poses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """poses with `along`, their place on the principal axis of x and y, turned so that the last pose is not behind the first."""
    axis = principal_axis(poses, key).select(*key, F.cos("angle").alias("_cx"), F.sin("angle").alias("_cy"))
    placed = poses.join(axis, list(key)).withColumn("along", F.col("x") * F.col("_cx") + F.col("y") * F.col("_cy"))
    ends = placed.groupBy(*key).agg((F.max_by("along", "seq") < F.min_by("along", "seq")).alias("_back"))
    return placed.join(ends, list(key)).withColumn("along", F.when(F.col("_back"), -F.col("along")).otherwise(F.col("along"))).drop("_cx", "_cy", "_back")


def phases(poses: DataFrame, column: str = "x", key: Sequence[str] = KEY) -> DataFrame:
    """Rows marked excitation, walk or stop: up to the least value of the first half, up to the greatest of all, after."""
    d = travelled(poses, key).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    ends = d.groupBy(*key).agg(
        F.min_by("seq", F.when(F.col("seq") < F.greatest(F.lit(1), F.expr("_n div 2")), F.struct(F.col(column), F.col("seq")))).alias("start_seq"),
        F.min_by("seq", F.struct(-F.col(column), F.col("seq"))).alias("stop_seq"),
    )
    d = d.drop("_n").join(ends, list(key))
    return d.withColumn("phase", F.when(F.col("seq") < F.col("start_seq"), "excitation").when(F.col("seq") <= F.col("stop_seq"), "walk").otherwise("stop"))


def _rigid(m: np.ndarray) -> np.ndarray:
    """Rotation that turns p onto q, from sum(p q^T) of centred points; never a reflection."""
    u, _, vt = np.linalg.svd(m)
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    return vt.T @ np.diag([1, 1, d]) @ u.T


def alignment(pairs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rotation r (9 numbers, by rows) and shift t with q = r p + t, least squares, per key.

    pairs has px, py, pz, qx, qy, qz. Spark sums the nine products; only they reach Python.
    """
    both = [f"{s}{c}" for s in "pq" for c in "xyz"]
    sums = pairs.groupBy(*key).agg(F.count("*").cast("double").alias("n"), *(F.avg(c).alias(c) for c in both), *(F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r, t = [], []
            for row in f.to_dict("records"):
                p, q = (np.array([row[f"{s}{c}"] for c in "xyz"]) for s in "pq")
                m = np.array([[row[f"{a}{b}"] for b in "xyz"] for a in "xyz"]) - row["n"] * np.outer(p, q)
                turn = _rigid(m)
                r.append(turn.ravel().tolist())
                t.append((q - turn @ p).tolist())
            yield f[[*key]].assign(r=r, t=t)

    kinds = ", ".join(f"`{k}` {t}" for k, t in sums.dtypes if k in key)
    return sums.mapInPandas(solve, f"{kinds}, r array<double>, t array<double>")


def aligned(pairs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """pairs with the distance of the turned p from q."""
    d = pairs.join(alignment(pairs, key), list(key))
    moved = [sum(F.col("r")[3 * i + j] * F.col(f"p{c}") for j, c in enumerate("xyz")) + F.col("t")[i] for i in range(3)]
    return d.withColumn("error", norm(*(m - F.col(f"q{c}") for m, c in zip(moved, "xyz")))).drop("r", "t")


def error_stats(df: DataFrame, column: str = "error", key: Sequence[str] = KEY) -> DataFrame:
    e = F.col(column)
    return df.groupBy(*key).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.percentile(e, 0.5).alias("median"),
        F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.sum(e * e).alias("sse"),
    )


def _turned(r: Column, s: Column) -> list[Column]:
    """The nine numbers, by rows, of r^T s."""
    return [sum(r[3 * k + i] * s[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def turn_angle(r: Sequence[Column] | Column, s: Sequence[Column] | Column) -> Column:
    """Degrees between two rotations of nine numbers."""
    trace = sum(r[i] * s[i] for i in range(9))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def turn_errors(pairs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """pairs, which have the rotations pr and qr too, with the angle of the aligned p from q in degrees."""
    d = pairs.join(alignment(pairs, key).select(*key, "r"), list(key))
    product = [sum(F.col("r")[3 * i + k] * F.col("pr")[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return d.withColumn("angle", turn_angle(product, F.col("qr"))).drop("r")


def stretches(pairs: DataFrame, delta: float = 1.0, key: str = "bag") -> DataFrame:
    """The rows at which p has gone another `delta` since the row before that did."""

    def step(state: list, f: pd.DataFrame) -> pd.DataFrame:
        at = f[["px", "py", "pz"]].to_numpy(float)
        before = np.vstack([at[:1] if not state else state[1:], at[:-1]])
        gone, kept = state[0] if state else 0.0, []
        for length in np.sqrt(((at - before) ** 2).sum(axis=1)).tolist():
            gone += length
            kept.append(gone >= delta)
            gone = 0.0 if kept[-1] else gone
        state[:] = [gone, at[-1]]
        return f.loc[kept, [key, "seq"]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if c in (key, "seq"))
    marks = folded(pairs.select(key, "seq", "px", "py", "pz"), [key], ["seq"], list, step, kinds)
    return pairs.join(marks, [key, "seq"])


def relative_errors(pairs: DataFrame, delta: float = 1.0, key: str = "bag") -> DataFrame:
    """(key, seq, next_seq, error, angle) of the motion between rows that lie `delta` of travel apart.

    pairs: (key, seq, px, py, pz, pr, qx, qy, qz, qr). The motion of p against that of q, each
    seen from its own first pose, as metres and degrees.
    """
    w = _w([key])
    whole = F.struct("seq", "px", "py", "pz", "pr", "qx", "qy", "qz", "qr")
    d = stretches(pairs, delta, key).withColumn("n", F.lead(whole).over(w)).filter("n IS NOT NULL")
    moved, turns = [], []
    for s in "pq":
        r, step_ = F.col(f"{s}r"), [F.col(f"n.{s}{c}") - F.col(f"{s}{c}") for c in "xyz"]
        moved.append([sum(r[3 * k + i] * step_[k] for k in range(3)) for i in range(3)])
        turns.append(_turned(r, F.col(f"n.{s}r")))
    error = norm(*(a - b for a, b in zip(*moved)))
    return d.select(key, "seq", F.col("n.seq").alias("next_seq"), error.alias("error"), turn_angle(*turns).alias("angle"))


class PeakScan:
    """Local maxima of a series that comes in parts, in time linear in it; what is kept are peaks, not values.

    A plateau counts once, at its middle. Of peaks nearer than `distance` to each other the
    higher clears the lower, the later of equal ones the earlier; peaks that are further
    apart than that in a row don't touch each other, so a row is settled when it ends. A
    peak's prominence is what it rises over the higher of the two lowest values up to
    anything higher on either side: peaks that nothing higher has followed yet wait in
    falling order. A row that gets long is settled up to its highest peak, which nothing
    can clear once all near it are known.
    """

    ROW = 64

    def __init__(self, prominence: float, distance: int) -> None:
        self.prominence, self.distance = prominence, distance
        self.n, self.last, self.begin, self.rising = 0, None, 0, False
        self.low: float | None = None  # least value since the last peak
        self.higher: list[list[float]] = []  # falling peaks: height, least value between the one before and it
        self.waiting: list[list] = []  # peaks without an end on the right: [peak, height, least value between the one before and it]
        self.row: list[list] = []  # peaks of a row: [place, height, rise on the left, rise on the right or None]
        self.kept: list[list] = []
        self.done: list[tuple[int, float, float]] = []
        self.long = self.ROW

    def add(self, values: Sequence[float]) -> None:
        for v in values:
            if self.last is None or v != self.last:
                if self.last is not None:
                    if v < self.last and self.rising:
                        self._peak((self.begin + self.n - 1) // 2, self.last)
                    self.rising = v > self.last
                self.begin, self.last = self.n, v
            self.low = v if self.low is None or v < self.low else self.low
            self.n += 1

    def _peak(self, place: int, height: float) -> None:
        low = self.low
        while self.higher and self.higher[-1][0] <= height:
            low = min(low, self.higher.pop()[1])
        self.higher.append([height, low])
        peak = [place, height, height - low, None]
        self._settle(height)
        self.waiting.append([peak, height, self.low])
        if self.row and place - self.row[-1][0] >= self.distance:
            self._clear()
        self.row.append(peak)
        self.low = height
        if len(self.row) > self.long:
            self._part()

    def _settle(self, height: float) -> None:
        """End those on the right that are lower than what has come."""
        low = self.low
        while self.waiting and self.waiting[-1][1] < height:
            peak, own, before = self.waiting.pop()
            peak[3] = own - low
            low = min(low, before)
        self.low = low if self.waiting else self.low

    def _part(self) -> None:
        top = max(range(len(self.row)), key=lambda i: (self.row[i][1], self.row[i][0]))
        place = self.row[top][0]
        if self.row[-1][0] - place >= self.distance:
            rest = [p for p in self.row[top + 1 :] if p[0] - place >= self.distance]
            self.row = self.row[: top + 1]
            self._clear()
            self.row = rest
        self.long = max(self.ROW, 2 * len(self.row))  # so that looking costs little for each peak

    def _clear(self) -> None:
        """The row is over: keep its higher peaks."""
        gone: set[int] = set()
        places = [p[0] for p in self.row]
        for i in sorted(range(len(self.row)), key=lambda i: (-self.row[i][1], -places[i])):
            if i in gone:
                continue
            self.kept.append(self.row[i])
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(places) and abs(places[j] - places[i]) < self.distance:
                    gone.add(j)
                    j += step
        self.row = []
        self.done += [(p[0], p[1], min(p[2], p[3])) for p in self.kept if p[3] is not None and min(p[2], p[3]) >= self.prominence]
        self.kept = [p for p in self.kept if p[3] is None and p[2] >= self.prominence]

    def taken(self) -> list[tuple[int, float, float]]:
        """(place, height, prominence) of the peaks that are certain since the last call."""
        out, self.done = self.done, []
        return out

    def ended(self) -> list[tuple[int, float, float]]:
        """Those of the rest, once the series has ended."""
        if self.low is not None:
            self._settle(float("inf"))
        self._clear()
        return self.taken()


def peaks(values: Sequence[float], prominence: float, distance: int) -> np.ndarray:
    """Places of the peaks of a short series; see PeakScan."""
    scan = PeakScan(prominence, distance)
    scan.add(list(map(float, values)))
    return np.array(sorted(place for place, _, _ in scan.ended()), int)


def peak_rows(df: DataFrame, value: str, prominence: float, distance: int, key: Sequence[str] = KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    """(key, place, height, prominence) of the peaks of each key's series, places counted from 0."""
    rows = df.select(*key, *order, F.col(value).cast("double").alias("_value"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def given(k: tuple, found: list[tuple[int, float, float]]) -> pd.DataFrame:
        return pd.DataFrame([(*k, *p) for p in found], columns=[*key, "place", "height", "prominence"])

    def step(scan: PeakScan, f: pd.DataFrame) -> pd.DataFrame | None:
        scan.add(f["_value"].tolist())
        found = scan.taken()
        return given(tuple(f[c].iloc[0] for c in key), found) if found else None

    return folded(rows, key, order, lambda: PeakScan(prominence, distance), step, f"{kinds}, place long, height double, prominence double", finish=lambda scan, k: given(k, scan.ended()))


def trips(poses: DataFrame, prominence: float = 0.5, distance: int = 50) -> DataFrame:
    """Per bag the peaks and valleys of the distance from the start; a round trip has one peak."""

    def start() -> dict:
        return {"first": None, "up": PeakScan(prominence, distance), "down": PeakScan(prominence, distance), "n": [0, 0]}

    def step(state: dict, f: pd.DataFrame) -> None:
        at = f[["x", "y", "z"]].to_numpy()
        if state["first"] is None:
            state["first"] = at[0]
        d = np.sqrt(((at - state["first"]) ** 2).sum(axis=1))
        for i, (side, values) in enumerate((("up", d), ("down", -d))):
            state[side].add(values.tolist())
            state["n"][i] += len(state[side].taken())

    def finish(state: dict, key: tuple) -> pd.DataFrame:
        up, down = (n + len(state[side].ended()) for n, side in zip(state["n"], ("up", "down")))
        return pd.DataFrame({"bag": [key[0]], "round_trips": [up], "valleys": [down]})

    rows = poses.select("bag", "seq", "x", "y", "z")
    return folded(rows, ["bag"], ["seq"], start, step, f"bag {rows.schema['bag'].dataType.simpleString()}, round_trips long, valleys long", finish=finish)


