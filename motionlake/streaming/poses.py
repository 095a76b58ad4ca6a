"""Trackers that give smoothed joints beside the ids: joints of hands that are hidden stay near where they were."""

from __future__ import annotations

from collections.abc import Container, Sequence

from pyspark.sql import DataFrame

from .filters import BodyTracker, HandTracker, OneEuro
from .frames import Kind, tracked, tracked_stream

Joint = tuple[float, float, float]
JOINTS = "array<struct<x:double,y:double,c:double>>"


def _filters(n: int, min_cutoff: float, beta: float) -> list[tuple[OneEuro, OneEuro]]:
    return [(OneEuro(min_cutoff, beta), OneEuro(min_cutoff, beta)) for _ in range(n)]


def _saved(filters: dict[int, list[tuple[OneEuro, OneEuro]]]) -> list:
    return [[i, [[f.x, f.dx, f.t] for pair in every for f in pair]] for i, every in filters.items()]


def _restored(saved: list, min_cutoff: float, beta: float) -> dict[int, list[tuple[OneEuro, OneEuro]]]:
    made = {i: [OneEuro(min_cutoff, beta, x=x, dx=dx, t=t) for x, dx, t in flat] for i, flat in saved}
    return {i: list(zip(flat[::2], flat[1::2])) for i, flat in made.items()}


class HandPoses:
    """Tracked hands with a filter per joint.

    A joint that is not sure goes on from where it was last sure by a hundredth of the
    hand's speed, through the filter, and keeps a trust of at least 0.05; the place where
    it was last sure does not change meanwhile.
    """

    MIN_CUTOFF, BETA, SURE, DRIFT, LEAST = 0.8, 0.005, 0.22, 0.01, 0.05

    def __init__(self) -> None:
        self.tracker = HandTracker()
        self.filters: dict[int, list[tuple[OneEuro, OneEuro]]] = {}
        self.sure: dict[int, list[tuple[float, float]]] = {}

    def frame(self, t: float, detections: list[tuple[float, float, str, Sequence[Joint]]]) -> list[tuple[int, str, list[Joint]]]:
        """(track id, side, joints) for each detection (x, y, side, joints)."""
        found = self.tracker.frame(t, [d[:3] for d in detections])
        tracks = {k.id: k for k in self.tracker.tracks}
        self._keep(tracks)
        out = []
        for (i, side), (*_, joints) in zip(found, detections):
            filters = self.filters.setdefault(i, _filters(len(joints), self.MIN_CUTOFF, self.BETA))
            sure = self.sure.setdefault(i, [(x, y) for x, y, _ in joints])
            smooth = []
            for n, (x, y, c) in enumerate(joints):
                hidden = c < self.SURE
                if hidden:
                    x, y = sure[n][0] + tracks[i].vx * self.DRIFT, sure[n][1] + tracks[i].vy * self.DRIFT
                    c = max(self.LEAST, c)
                x, y = (f(v, t) for f, v in zip(filters[n], (x, y)))
                if not hidden:
                    sure[n] = (x, y)
                smooth.append((x, y, c))
            out.append((i, side, smooth))
        return out

    def _keep(self, ids: Container[int]) -> None:
        self.filters = {i: f for i, f in self.filters.items() if i in ids}
        self.sure = {i: s for i, s in self.sure.items() if i in ids}

    def missing(self, frames: int) -> None:
        self.tracker.missing(frames)
        self._keep({k.id for k in self.tracker.tracks})

    def saved(self) -> dict:
        return {"tracker": self.tracker.saved(), "filters": _saved(self.filters), "sure": list(self.sure.items())}

    def restore(self, saved: dict) -> None:
        self.tracker.restore(saved["tracker"])
        self.filters = _restored(saved["filters"], self.MIN_CUTOFF, self.BETA)
        self.sure = {i: [tuple(at) for at in every] for i, every in saved["sure"]}


class BodyPoses:
    """Tracked persons with a filter per joint; joints that are not sure pass and start theirs anew."""

    MIN_CUTOFF, BETA, SURE = 0.7, 0.005, 0.2

    def __init__(self) -> None:
        self.tracker = BodyTracker()
        self.filters: dict[int, list[tuple[OneEuro, OneEuro]]] = {}

    def frame(self, t: float, detections: list[tuple[float, float, Sequence[Joint]]]) -> list[tuple[int, list[Joint]]]:
        """(person, joints) for each detection (x, y, joints)."""
        found = self.tracker.frame([d[:2] for d in detections])
        out = []
        for i, begun, (*_, joints) in zip(found, self.tracker.begun, detections):
            if begun:  # also where no id was free and a person's own is taken over
                self.filters[i] = _filters(len(joints), self.MIN_CUTOFF, self.BETA)
            filters = self.filters[i]
            smooth = []
            for n, (x, y, c) in enumerate(joints):
                if c > self.SURE:
                    x, y = (f(v, t) for f, v in zip(filters[n], (x, y)))
                else:
                    filters[n] = _filters(1, self.MIN_CUTOFF, self.BETA)[0]
                smooth.append((x, y, c))
            out.append((i, smooth))
        self.filters = {i: f for i, f in self.filters.items() if i in found}
        return out

    def missing(self, frames: int) -> None:
        self.tracker.missing(frames)
        self.filters = self.filters if self.tracker.boxes else {}

    def saved(self) -> dict:
        return {"tracker": self.tracker.saved(), "filters": _saved(self.filters)}

    def restore(self, saved: dict) -> None:
        self.tracker.restore(saved["tracker"])
        self.filters = _restored(saved["filters"], self.MIN_CUTOFF, self.BETA)


def _structs(joints: list[Joint]) -> list[dict]:
    return [dict(zip("xyc", map(float, j))) for j in joints]


def _run_hands(hands: HandPoses, t: float, found: list[tuple]) -> list[tuple]:
    return [(i, side, _structs(k)) for i, side, k in hands.frame(t, found)]


def _run_bodies(bodies: BodyPoses, t: float, found: list[tuple]) -> list[tuple]:
    return [(i, _structs(k)) for i, k in bodies.frame(t, found)]


HANDS = Kind(HandPoses, ("x", "y", "side", "k"), f"track int, side string, k {JOINTS}", _run_hands, HandTracker.EXPIRY)
BODIES = Kind(BodyPoses, ("x", "y", "k"), f"person int, k {JOINTS}", _run_bodies, 0)


def hand_poses(detections: DataFrame, key: str = "stream", frames: DataFrame | None = None, period: float | None = None) -> DataFrame:
    """(key, frame, det, track, side, k) from (key, frame, det, t, x, y, side, k), k with joints (x, y, c); see frames.tracked."""
    return tracked(detections, HANDS, key, frames, period)


def body_poses(detections: DataFrame, key: str = "stream", frames: DataFrame | None = None, period: float | None = None) -> DataFrame:
    """(key, frame, det, person, k) from (key, frame, det, t, x, y, k); see frames.tracked."""
    return tracked(detections, BODIES, key, frames, period)


def hand_poses_stream(detections: DataFrame, key: str = "stream", time: str = "ts", period: float | None = None) -> DataFrame:
    """hand_poses of a stream; see frames.tracked_stream."""
    return tracked_stream(detections, HANDS, key, time, period)


def body_poses_stream(detections: DataFrame, key: str = "stream", time: str = "ts", period: float | None = None) -> DataFrame:
    return tracked_stream(detections, BODIES, key, time, period)
