"""Trackers over frames, on tables and on streams: frames without detections count too.

A tracker sees the frames of a key in order. Rows tell only of frames with detections, so
what lies between two of them is counted: by the frame numbers, by time where a period is
given, or by a table of all frames. A tracker ages by so many missing frames at once.

On a stream, frames wait until the watermark has passed them, so that late rows still come
in their place. What is kept for a key is the tracker, the last frame and the frames that
wait. With a period, a timer lets tracks go when no frame has come for so long that they
have ended, so that a key that fell silent keeps nothing but its next id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import folded


@dataclass(frozen=True)
class Kind:
    """What a tracker reads of each detection beside (key, frame, det, t), and what it gives after (key, frame, det).

    It has missing(frames), saved() and restore(saved); `run` calls it with the time and the
    detections of a frame. After more than `expiry` missing frames it holds no track.
    """

    made: Callable[[], Any]
    reads: tuple[str, ...]
    gives: str
    run: Callable[[Any, float, list[tuple]], list[tuple]]
    expiry: int

    @property
    def names(self) -> list[str]:
        return [part.split()[0] for part in _split(self.gives)]


def _split(ddl: str) -> list[str]:
    """The columns of a DDL text; commas within < > don't count."""
    parts, depth = [""], 0
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            parts.append("")
        else:
            parts[-1] += char
    return [p.strip() for p in parts]


def _plain(value: Any) -> Any:
    """A detection's value as numbers, texts and tuples of them."""
    if isinstance(value, dict) or hasattr(value, "asDict"):
        value = value if isinstance(value, dict) else value.asDict()
        return tuple(map(_plain, value.values()))
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [_plain(v) for v in value]
    return value.item() if hasattr(value, "item") else value


class Timeline:
    """A tracker with the last frame that it saw."""

    def __init__(self, kind: Kind, period: float | None, listed: bool = False) -> None:
        self.kind, self.period, self.listed = kind, period, listed
        self.tracker = kind.made()
        self.frame: int | None = None
        self.t = 0.0

    def seen(self, frame: int, t: float, found: list[tuple]) -> list[tuple]:
        """What the tracker gives for the detections of a frame, after all that was missing before it."""
        if self.frame is not None and not self.listed:
            gap = frame - self.frame if self.period is None else round((t - self.t) / self.period)
            if gap > 1:
                self.tracker.missing(gap - 1)
        self.frame, self.t = frame, t
        if found:
            return self.kind.run(self.tracker, t, found)
        self.tracker.missing(1)
        return []

    def saved(self) -> str:
        return json.dumps([self.frame, self.t, self.tracker.saved()])

    def restore(self, saved: str) -> None:
        self.frame, self.t, tracker = json.loads(saved)
        self.tracker.restore(tracker)


def tracked(detections: DataFrame, kind: Kind, key: str = "stream", frames: DataFrame | None = None, period: float | None = None) -> DataFrame:
    """(key, frame, det, what the tracker gives) from (key, frame, det, t, what it reads).

    frames: (key, frame, t) of all frames, with or without detections. Without that table
    missing frames follow from the frame numbers, or with `period` (seconds) from the times.
    Rows with a null det tell of a frame without detections.
    """
    rows = detections.select(key, F.col("frame").cast("long").alias("frame"), F.col("det").cast("int").alias("det"), F.col("t").cast("double").alias("t"), *kind.reads)
    all_listed = frames is not None
    if all_listed:
        listed = frames.select(key, F.col("frame").cast("long").alias("frame"), F.col("t").cast("double").alias("t")).distinct()
        rows = rows.unionByName(listed, allowMissingColumns=True)

    def step(line: Timeline, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame, g in f.groupby("frame", sort=False):
            g = g[g["det"].notna()] if len(g) > 1 or g["det"].isna().any() else g
            t = float(f["t"].loc[g.index[0]]) if len(g) else float(f.loc[f["frame"] == frame, "t"].iloc[0])
            found = line.seen(int(frame), t, [tuple(map(_plain, r)) for r in zip(*(g[c] for c in kind.reads))])
            out += [(f[key].iloc[0], frame, int(d), *r) for d, r in zip(g["det"], found)]
        return pd.DataFrame(out, columns=[key, "frame", "det", *kind.names])

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, frame long, det int, {kind.gives}"
    return folded(rows, [key], ["frame", "det"], lambda: Timeline(kind, period, all_listed), step, schema, "frame")


class _Processor(StatefulProcessor):
    """A Timeline for each key; frames wait by their time until the watermark has passed it."""

    def __init__(self, kind: Kind, key: str, period: float | None) -> None:
        self.kind, self.key, self.period = kind, key, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "value string")
        self.next = handle.getValueState("next", "ms long")
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")

    def _wake(self, ms: int) -> None:
        """One timer at a time, the earliest."""
        if self.next.exists():
            now = self.next.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.next.update((ms,))

    def _restored(self) -> Timeline:
        line = Timeline(self.kind, self.period)
        if self.line.exists():
            line.restore(self.line.get()[0])
        return line

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came: dict[int, list] = {}
        for f in rows:
            for ms, frame, det, t, *values in zip(f["wait_ms"], f["frame"], f["det"], f["t"], *(f[c] for c in self.kind.reads)):
                there = came.setdefault(int(ms), [])
                there.append([int(frame), -1 if pd.isna(det) else int(det), float(t), *map(_plain, values)])
        for ms, found in came.items():
            before = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), (json.dumps(before + found),))
        if came:
            self._wake(min(came))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.next.clear()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        times = sorted(ms for (ms,) in self.waiting.keys())
        line, out = self._restored(), []
        ready: list[list] = []
        for ms in times:
            if ms <= passed:
                ready += json.loads(self.waiting.getValue((ms,))[0])
                self.waiting.removeKey((ms,))
        ready.sort(key=lambda r: r[:2])
        at = 0
        while at < len(ready):
            frame, end = ready[at][0], at
            while end < len(ready) and ready[end][0] == frame:
                end += 1
            own = [r for r in ready[at:end] if r[1] >= 0]
            found = line.seen(frame, (own or ready[at:end])[0][2], [tuple(r[3:]) for r in own])
            out += [(key[0], frame, r[1], *given) for r, given in zip(own, found)]
            at = end
        left = [ms for ms in times if ms > passed]
        if left:
            self._wake(left[0])
        elif self.period is not None and line.frame is not None:
            ends = int((line.t + (self.kind.expiry + 1.5) * self.period) * 1000) + 1
            if passed >= ends:
                line.tracker.missing(self.kind.expiry + 1)
            else:
                self._wake(ends)
        self.line.update((line.saved(),))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "frame", "det", *self.kind.names])

    def close(self) -> None:
        pass


def tracked_stream(detections: DataFrame, kind: Kind, key: str = "stream", time: str = "ts", period: float | None = None) -> DataFrame:
    """The same from a stream of (key, frame, det, t, time, what the tracker reads) with a watermark on `time`.

    A frame's rows share their time, and later frames have later times. It is given out when
    the watermark has passed it. Rows with a null det tell of a frame without detections.
    Needs a state store that holds many states for a key (RocksDB).
    """
    rows = detections.select(
        key, F.col("frame").cast("long").alias("frame"), F.col("det").cast("int").alias("det"), F.col("t").cast("double").alias("t"),
        F.col(time), F.unix_millis(F.col(time)).alias("wait_ms"), *kind.reads,
    )
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, frame long, det int, {kind.gives}"
    return rows.groupBy(key).transformWithStateInPandas(_Processor(kind, key, period), schema, "Append", "EventTime")
