"""Smoothing of joints in space along a track: depth that bleeds over from behind is drawn back to the hand."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

from .filters import OneEuro
from .folds import folded

JOINT = "array<struct<x:double,y:double,z:double,c:double>>"
Joint = tuple[float, float, float, float]


class JointSmoother:
    """One filter per joint and axis.

    Joints that are not seen (z or trust too small) pass as they are and start their filter
    anew. With `reach` (hands), joints further than that from the hand's slowly followed
    depth are put at it, and joints that are not seen stay where they were last.
    """

    NEAR, SEEN, STEADY, KEEP, LEAST = 0.1, 0.20, 0.25, 0.85, 0.05

    def __init__(self, joints: int, min_cutoff: float, beta: float, reach: float | None = None) -> None:
        self.made = lambda: [OneEuro(min_cutoff, beta) for _ in range(3)]
        self.filters = [self.made() for _ in range(joints)]
        self.reach = reach
        self.depth = 0.0
        self.last: list[tuple[float, float, float] | None] = [None] * joints

    def __call__(self, joints: Sequence[Joint], t: float | None) -> list[Joint]:
        if self.reach is not None:
            known = [z for _, _, z, c in joints if z > self.NEAR and c > self.STEADY]
            now = median(known) if known else self.depth
            if now > self.NEAR:
                self.depth = self.KEEP * self.depth + (1 - self.KEEP) * now if self.depth else now
        return [self._joint(i, j, t) for i, j in enumerate(joints)]

    def _joint(self, i: int, joint: Joint, t: float | None) -> Joint:
        x, y, z, c = joint
        if z > self.NEAR and c > self.SEEN:
            if self.reach is not None and self.depth > self.NEAR and abs(z - self.depth) > self.reach:
                z = self.depth
            at = tuple(f(v, t) for f, v in zip(self.filters[i], (x, y, z)))
            self.last[i] = at
            return (*at, c)
        if self.reach is not None and self.last[i] is not None and self.last[i][2] > self.NEAR:
            return (*self.last[i], max(self.LEAST, c))
        self.filters[i] = self.made()
        return joint


def hand() -> JointSmoother:
    return JointSmoother(21, 0.6, 0.004, reach=0.18)


def fingertip() -> JointSmoother:
    return JointSmoother(1, 0.6, 0.004, reach=0.18)


def body() -> JointSmoother:
    return JointSmoother(17, 0.5, 0.004)


def smoothed_joints(df: DataFrame, smoother=hand, key: Sequence[str] = ("stream", "track"), joints: str = "k") -> DataFrame:
    """(key, frame, t, joints) with the joints of each track smoothed in the order of its frames."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*key, "frame", "t"))

    def step(s: JointSmoother, f: pd.DataFrame) -> pd.DataFrame:
        rows = [s([(j["x"], j["y"], j["z"], j["c"]) for j in k], t) for k, t in zip(f[joints], f["t"])]
        out = f[[*key, "frame", "t"]].copy()
        out[joints] = [[dict(zip("xyzc", map(float, j))) for j in r] for r in rows]
        return out

    return folded(df.select(*key, "frame", "t", joints), key, ["frame"], smoother, step, f"{kinds}, {joints} {JOINT}")
