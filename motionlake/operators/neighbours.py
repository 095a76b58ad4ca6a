"""The k nearest points of a cloud, exactly, on clouds that are crowded in places.

Cuts from a bounded sample of the cloud make cells of about equal numbers of points,
however the points lie: a k-d tree of at most SAMPLE / 8 cells, which is all that the driver
holds. Each point first meets its own cell, which bounds how far its neighbours can be, and
then only the cells whose box that ball reaches. Cells that many points ask are asked in
parts.

Defined results for odd input: points without three finite coordinates have no neighbours
and are left out, in the cloud too; equal points of the cloud are neighbours each; ties go
to the smaller id of the cloud; with fewer than k points in the cloud all are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import finite
from ..storage import cut

#: Points of the sample, points of a cell, and points that ask a cell at a time.
SAMPLE = 1 << 15
CELL = 2048
ASKED = 1 << 15
#: Distances that are worked out at a time.
TILE = 1 << 21


@dataclass(frozen=True)
class Tree:
    """Inner nodes (axis, place of the cut, children); a child below 0 is the cell -child - 1. Boxes of the cells."""

    axis: np.ndarray
    place: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def grown(sample: np.ndarray, cells: int) -> Tree:
        axis: list[int] = []
        place: list[float] = []
        children: list[list[int]] = []
        low: list[np.ndarray] = []
        high: list[np.ndarray] = []

        def grow(points: np.ndarray, want: int, a: np.ndarray, b: np.ndarray) -> int:
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(3)
            k = int(np.argmax(spread))
            if want < 2 or spread[k] <= 0:
                low.append(a)
                high.append(b)
                return -len(low)
            at = float(np.quantile(points[:, k], (want // 2) / want))
            left = points[:, k] < at
            if not left.any() or left.all():
                at = float(points[:, k].mean())
                left = points[:, k] < at
            if not left.any() or left.all():
                low.append(a)
                high.append(b)
                return -len(low)
            node = len(axis)
            axis.append(k)
            place.append(at)
            children.append([0, 0])
            middle_b, middle_a = b.copy(), a.copy()
            middle_b[k] = middle_a[k] = at
            children[node][0] = grow(points[left], want // 2, a, middle_b)
            children[node][1] = grow(points[~left], want - want // 2, middle_a, b)
            return node

        grow(sample, cells, np.full(3, -np.inf), np.full(3, np.inf))
        return Tree(np.array(axis, int), np.array(place), np.array(children, int).reshape(-1, 2), np.array(low), np.array(high))

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), int) if len(self.axis) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = points[inner, self.axis[node]] >= self.place[node]
            at[inner] = self.children[node, right.astype(int)]
        return -at - 1

    def reached(self, points: np.ndarray, reach2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) wherever a point's ball (its radius squared) touches the cell's box."""
        found_p, found_c = [], []
        step = max(1, TILE // (8 * len(self.low)))
        for i in range(0, len(points), step):
            p = points[i : i + step, None, :]
            away = np.maximum(np.maximum(self.low - p, p - self.high), 0)
            near, cell = np.nonzero((away * away).sum(axis=2) <= reach2[i : i + step, None])
            found_p.append(near + i)
            found_c.append(cell)
        return np.concatenate([np.zeros(0, int), *found_p]), np.concatenate([np.zeros(0, int), *found_c])


def _xyz(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in "xyz"], axis=1)


def _nearest(k: int):
    def search(points: pa.Table, cloud: pa.Table) -> pa.Table:
        kinds = {"id": points.schema.field("id").type, "other": cloud.schema.field("other").type, "d2": pa.float64()}
        if not points.num_rows or not cloud.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        order = cloud.sort_by("other")
        asked, there = _xyz(points), _xyz(order)
        most, step = min(k, len(there)), max(1, TILE // len(there))
        picks, far = [], []
        for i in range(0, len(asked), step):
            part = asked[i : i + step]
            d2 = sum((part[:, None, c] - there[None, :, c]) ** 2 for c in range(3))
            by = np.argsort(d2, axis=1, kind="stable")[:, :most] if most > 1 else np.argmin(d2, axis=1)[:, None]
            picks.append(by)
            far.append(np.take_along_axis(d2, by, axis=1))
        who = np.repeat(np.arange(len(asked)), most)
        return pa.table({
            "id": points.column("id").take(pa.array(who)), "other": order.column("other").take(pa.array(np.concatenate(picks).ravel())), "d2": pa.array(np.concatenate(far).ravel()),
        })

    return search


def nearest_k(points: DataFrame, cloud: DataFrame, k: int = 1, id_: str = "id", other: str = "id", cell: int = CELL) -> DataFrame:
    """(id_, rank, other, distance): the k nearest of the cloud's points for each point, ranks from 1. Ids tell rows apart."""
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    asked = points.select(F.col(id_).alias("id"), *xyz).filter(finite(*"xyz"))
    there = cut(cloud.select(F.col(other).alias("other"), *xyz).filter(finite(*"xyz")))
    n = there.count()
    few = there.select("x", "y", "z") if n <= SAMPLE else there.select("x", "y", "z").orderBy(F.xxhash64("other", F.lit("cut"))).limit(SAMPLE)
    sample = np.array([tuple(r) for r in few.collect()], float).reshape(-1, 3)
    tree = Tree.grown(sample, min(-(-n // cell), SAMPLE // 8) if n else 1)
    id_kind, other_kind = (df.schema[c].dataType.simpleString() for df, c in ((asked, "id"), (there, "other")))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cell(_xyz(b)).astype(np.int32))], [*b.schema.names, "cell"])

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _xyz(b)
            reach = b.column("reach").fill_null(np.inf).to_numpy()
            who, to = tree.reached(p, reach)
            other_cell = to != tree.cell(p)[who]
            rows = b.take(pa.array(who[other_cell]))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(to[other_cell].astype(np.int32))], [*b.schema.names[:4], "cell"])

    whole = cut(there.mapInArrow(celled, f"other {other_kind}, x double, y double, z double, cell int"))

    def met(rows: DataFrame) -> DataFrame:
        """(id, other, d2) of the k nearest in the cell of each row; crowded cells are asked in parts."""
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        left = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        right = whole.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        by = ["cell", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_nearest(k), f"id {id_kind}, other {other_kind}, d2 double")

    own = cut(asked.mapInArrow(celled, f"id {id_kind}, x double, y double, z double, cell int"))
    first = cut(met(own))
    reach = first.groupBy("id").agg(F.max("d2").alias("reach"), F.count("*").alias("n"))
    reach = reach.select("id", F.when(F.col("n") >= k, F.col("reach")).alias("reach"))  # too few so far: no bound
    wide = own.drop("cell").join(reach, "id", "left").select("id", "x", "y", "z", "reach")
    more = met(cut(wide.mapInArrow(reaching, f"id {id_kind}, x double, y double, z double, cell int")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))
    best = first.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias(id_), "rank", F.col("other").alias("other"), F.sqrt("d2").alias("distance"))
