"""Recursive filters and trackers: one core for batch groups and for streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .folds import folded
from .frames import Kind, tracked, tracked_stream

DEFAULT_STEP = 1 / 30


def smoothing(te: float, cutoff: float) -> float:
    r = 2 * math.pi * cutoff * te
    return r / (r + 1)


@dataclass
class OneEuro:
    """Low-pass filter whose cutoff rises with speed."""

    min_cutoff: float = 1.0
    beta: float = 0.007
    d_cutoff: float = 1.0
    x: float | None = None
    dx: float = 0.0
    t: float | None = None

    def __call__(self, x: float, t: float | None) -> float:
        before, self.t = self.t, t
        if self.x is None:
            self.x = x
            return x
        te = t - before if t is not None and before is not None and t > before else DEFAULT_STEP
        a = smoothing(te, self.d_cutoff)
        self.dx = a * (x - self.x) / te + (1 - a) * self.dx
        a = smoothing(te, self.min_cutoff + self.beta * abs(self.dx))
        self.x = a * x + (1 - a) * self.x
        return self.x


def one_euro(df: DataFrame, key: str, min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0) -> DataFrame:
    """(key, id, t, x, smooth) from (key, id, t, x), in the order of t and id; a null x starts the filter anew."""

    def step(f: OneEuro, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, t in zip(rows["x"].tolist(), rows["t"].tolist()):
            if x is None or math.isnan(x):
                f.x, f.dx, f.t = None, 0.0, t
                out.append(None)
            else:
                out.append(f(x, t))
        return rows.assign(smooth=pd.Series(out, rows.index, dtype="float64"))

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col("id").cast("long"), F.col("t").cast("double"), F.col("x").cast("double"))
    schema = f"`{key}` {kind}, id long, t double, x double, smooth double"
    return folded(rows, [key], ["t", "id"], lambda: OneEuro(min_cutoff, beta, d_cutoff), step, schema)


def one_euro_stream(df: DataFrame, key: str = "bag", key_type: str = "long") -> DataFrame:
    """The same filter on a stream of (key, id, t, x); its state is three numbers per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = OneEuro()
        if state.exists:
            f.x, f.dx, f.t = state.get
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        rows["smooth"] = [f(x, t) for x, t in zip(rows["x"], rows["t"])]
        state.update((f.x, f.dx, f.t))
        yield rows[[key, "id", "t", "x", "smooth"]]

    out = f"{key} {key_type}, id long, t double, x double, smooth double"
    return df.groupBy(key).applyInPandasWithState(step, out, "x double, dx double, t double", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Track:
    id: int
    x: float
    y: float
    side: str
    t: float
    vx: float = 0.0
    vy: float = 0.0
    missed: int = 0
    votes: list[str] = field(default_factory=list)


class HandTracker:
    """Greedy nearest matching of detections to tracks that move on at their last speed."""

    REACH, PENALTY, EXPIRY, STEP, VOTES = 350.0, 800.0, 8, 0.033, 15

    def __init__(self) -> None:
        self.tracks: list[Track] = []
        self.next_id = 0

    def frame(self, t: float, detections: list[tuple[float, float, str]]) -> list[tuple[int, str]]:
        """(track id, side) for each detection (x, y, side or Unknown)."""
        cost = []
        for i, (x, y, side) in enumerate(detections):
            for j, k in enumerate(self.tracks):
                away = math.hypot(x - k.x - k.vx * self.STEP, y - k.y - k.vy * self.STEP)
                cost.append((away + (self.PENALTY if "Unknown" not in (side, k.side) and side != k.side else 0.0), i, j))
        taken: dict[int, Track] = {}
        used: set[int] = set()
        for c, i, j in sorted(cost):
            if c <= self.REACH and i not in taken and j not in used:
                taken[i] = self.tracks[j]
                used.add(j)
        for i, (x, y, side) in enumerate(detections):
            if i not in taken:
                taken[i] = Track(self.next_id, x, y, side, t, votes=[side] if side != "Unknown" else [])
                self.tracks.append(taken[i])
                self.next_id += 1
        for i, (x, y, side) in enumerate(detections):
            k = taken[i]
            dt = max(1e-3, t - k.t)
            k.vx, k.vy = 0.7 * k.vx + 0.3 * (x - k.x) / dt, 0.7 * k.vy + 0.3 * (y - k.y) / dt
            k.x, k.y, k.t, k.missed = x, y, t, -1
            if side != "Unknown":
                k.votes = [*k.votes, side][-self.VOTES :]
                k.side = "Left" if 2 * k.votes.count("Left") >= len(k.votes) else "Right"
        self.missing(1)
        return [(taken[i].id, taken[i].side) for i in range(len(detections))]

    def missing(self, frames: int) -> None:
        """So many frames without detections."""
        for k in self.tracks:
            k.missed += frames
        self.tracks = [k for k in self.tracks if k.missed <= self.EXPIRY]

    def saved(self) -> dict:
        return {"next": self.next_id, "tracks": [asdict(k) for k in self.tracks]}

    def restore(self, saved: dict) -> None:
        self.next_id, self.tracks = saved["next"], [Track(**k) for k in saved["tracks"]]


class BodyTracker:
    """Nearest earlier box within reach; ids 0 to 7 are used again, ids not seen are dropped."""

    REACH, IDS = 350.0, 8

    def __init__(self) -> None:
        self.boxes: dict[int, tuple[float, float]] = {}
        self.begun: list[bool] = []

    def frame(self, detections: list[tuple[float, float]]) -> list[int]:
        """The person of each detection; `begun` tells which of them nobody was near."""
        out, self.begun = [], []
        for x, y in detections:
            near = [(math.hypot(x - a, y - b), n, k) for n, (k, (a, b)) in enumerate(self.boxes.items())]
            best = min(near, default=(self.REACH, 0, 0))
            k = best[2] if best[0] < self.REACH else next((i for i in range(self.IDS) if i not in self.boxes), 0)
            self.begun.append(not best[0] < self.REACH)
            self.boxes[k] = (x, y)
            out.append(k)
        self.boxes = {k: v for k, v in self.boxes.items() if k in out}
        return out

    def missing(self, frames: int) -> None:
        """So many frames without detections; one is enough for all to go."""
        if frames > 0:
            self.boxes = {}

    def saved(self) -> dict:
        return {"boxes": [[k, *at] for k, at in self.boxes.items()]}

    def restore(self, saved: dict) -> None:
        self.boxes = {k: (x, y) for k, x, y in saved["boxes"]}


HANDS = Kind(HandTracker, ("x", "y", "side"), "track int, side string", lambda hands, t, found: hands.frame(t, found), HandTracker.EXPIRY)
BODIES = Kind(BodyTracker, ("x", "y"), "person int", lambda bodies, _, found: [(i,) for i in bodies.frame(found)], 0)


def hand_tracks(detections: DataFrame, key: str = "stream", frames: DataFrame | None = None, period: float | None = None) -> DataFrame:
    """(key, frame, det, track, side) from (key, frame, det, t, x, y, side); see frames.tracked."""
    return tracked(detections, HANDS, key, frames, period)


def body_tracks(detections: DataFrame, key: str = "stream", frames: DataFrame | None = None, period: float | None = None) -> DataFrame:
    """(key, frame, det, person) from (key, frame, det, t, x, y); see frames.tracked."""
    detections = detections if "t" in detections.columns else detections.withColumn("t", F.lit(0.0))
    return tracked(detections, BODIES, key, frames, period)


def hand_tracks_stream(detections: DataFrame, key: str = "stream", time: str = "ts", period: float | None = None) -> DataFrame:
    """hand_tracks of a stream; see frames.tracked_stream."""
    return tracked_stream(detections, HANDS, key, time, period)


def body_tracks_stream(detections: DataFrame, key: str = "stream", time: str = "ts", period: float | None = None) -> DataFrame:
    return tracked_stream(detections, BODIES, key, time, period)


def windowed(df: DataFrame, time: str = "ts", length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per time window and topic; with `late`, rows that come later than that are dropped by streams."""
    df = df.withWatermark(time, late) if late else df
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w.alias("w"), "topic").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, key: str = "bag", time: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
