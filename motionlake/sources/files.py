"""Trajectory texts, point-cloud and grid files: readers and writers."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TUM = ("ts", "x", "y", "z", "qx", "qy", "qz", "qw")
#: Bytes of a cloud's file that are read at a time, and rows of a batch made of them.
RANGE = 1 << 23
_ROWS = 1 << 14
_PLY_KINDS = {"float": "f4", "float32": "f4", "double": "f8", "uchar": "u1", "uint8": "u1", "int": "i4"}


def _numbers(lines: DataFrame, split: str, names: tuple[str, ...]) -> DataFrame:
    """Rows of at least so many numbers; comments, blank, short and unreadable lines go."""
    parts = F.split(F.trim("value"), split)
    kept = lines.filter(~F.trim("value").startswith("#")).withColumn("p", parts).filter(F.size("p") >= len(names))
    made = kept.select(F.input_file_name().alias("run"), *(F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return made.dropna(subset=list(names))


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """(run, ts, x, y, z, qx, qy, qz, qw)."""
    return _numbers(spark.read.text(path), r"\s+", TUM)


def read_estimator_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from comma-separated rows whose quaternion starts with w; nanoseconds become seconds."""
    d = _numbers(spark.read.text(path), r"\s*,\s*", ("ts", "x", "y", "z", "qw", "qx", "qy", "qz"))
    return d.withColumn("ts", F.when(F.abs("ts") > 1e14, F.col("ts") / 1e9).otherwise(F.col("ts"))).select("run", *TUM)


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """(run, ts, x, y, z, qx, qy, qz, qw) of rows of at least four numbers, with spaces or commas; no turn below eight."""
    parts = F.split(F.trim(F.translate("value", ",", " ")), r"\s+")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).withColumn("p", parts).filter(F.size("p") >= 4)
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    full = F.size("p") >= 8
    turn = [F.when(full, number(i)).otherwise(F.lit(0.0 if n != "qw" else 1.0)).alias(n) for i, n in enumerate(TUM) if i >= 4]
    return lines.select(F.input_file_name().alias("run"), *(number(i).alias(n) for i, n in enumerate(TUM[:4])), *turn).dropna(subset=list(TUM))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(run, x, y, z) from the second to fourth fields; rows where one is no number go."""
    parts = F.split("value", ",")
    made = spark.read.text(path).select(F.input_file_name().alias("run"), *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))))
    return made.dropna(subset=["x", "y", "z"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, filename) of an image index; comments go."""
    return spark.read.csv(path, schema="timestamp long, filename string", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def write_tum(poses: DataFrame, path: str) -> None:
    poses.orderBy("ts").select(F.format_string(" ".join(["%.6f"] * 8), *TUM)).write.text(path)


@dataclass(frozen=True)
class _Head:
    """What a cloud's file says of itself; its points begin at `start`."""

    text: bool
    count: int
    names: list[str]
    kinds: list[str]
    start: int

    @staticmethod
    def read(f: BinaryIO) -> _Head:
        count, names, kinds, text = 0, [], [], False
        for line in iter(f.readline, b""):
            w = line.decode().split()
            if w[:1] == ["end_header"]:
                break
            if w[:2] == ["format", "ascii"]:
                text = True
            elif w[:2] == ["element", "vertex"]:
                count = int(w[2])
            elif w[:1] == ["property"]:
                kinds.append(_PLY_KINDS[w[1]])
                names.append(w[2])
        return _Head(text, count, names, kinds, f.tell())

    @property
    def record(self) -> np.dtype:
        return np.dtype([(n, "<" + k) for n, k in zip(self.names, self.kinds)])

    def ranges(self, length: int, step: int) -> Iterator[tuple[int, int]]:
        """(first byte, byte behind) of parts of the points; records stay whole, lines belong to the part they begin in."""
        size = 1 if self.text else self.record.itemsize
        end = length if self.text else self.start + self.count * size
        if end > length:
            raise ValueError(f"{self.count} points of {size} bytes are announced, {length - self.start} bytes are there")
        step = max(1, step // max(1, size)) * max(1, size)
        yield from ((at, min(end, at + step)) for at in range(self.start, end, step))

    def part(self, f: BinaryIO, at: int, end: int) -> bytes:
        """The records, or the lines that begin, from `at` to before `end`."""
        if not self.text:
            f.seek(at)
            return f.read(end - at)
        f.seek(at if at == self.start else at - 1)
        if at > self.start:
            f.readline()
        data = f.read(max(0, end - f.tell()))
        return data if not data or data.endswith(b"\n") else data + f.readline()

    def held(self, data: bytes) -> tuple[int, int]:
        """Lines of a part, and points among them."""
        if not self.text:
            return (n := len(data) // self.record.itemsize), n
        lines = data.splitlines()
        return len(lines), sum(1 for line in lines if line.strip())

    def values(self, data: bytes, most: int) -> dict[str, np.ndarray]:
        """The points of a part's first `most` lines."""
        if not self.text:
            table = np.frombuffer(data, self.record)
            return {n: table[n].astype(float) for n in self.names}
        lines = data.splitlines()
        if len(lines) > most:
            lines = lines[: max(0, most)]
            data = b"\n".join(lines)
        if data.strip() and b"\r" not in data:
            read = {"read_options": csv.ReadOptions(use_threads=False, column_names=self.names), "parse_options": csv.ParseOptions(delimiter=" ", quote_char=False)}
            with contextlib.suppress(pa.ArrowInvalid):  # other spaces, or more on a line than is named
                kinds = csv.ConvertOptions(column_types=dict.fromkeys(self.names, pa.float64()), null_values=[])
                table = csv.read_csv(pa.BufferReader(data), convert_options=kinds, **read)
                return {n: table.column(n).to_numpy() for n in self.names}
        rows = np.array([line.decode().split()[: len(self.names)] for line in lines if line.strip()], float).reshape(-1, len(self.names))
        return {n: rows[:, i] for i, n in enumerate(self.names)}


_PLY = "path string, seq long, x double, y double, z double, red int, green int, blue int"


def _points(path: str, first: int, values: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of _PLY, a few at a time."""
    n = len(values["x"])
    for i in range(0, n, _ROWS):
        own = {c: v[i : i + _ROWS] for c, v in values.items()}
        size = len(own["x"])
        colours = [pa.array(own[c].astype("int32") if c in own else np.zeros(size, "int32")) for c in ("red", "green", "blue")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * size), pa.array(np.arange(first + i, first + i + size)), *(pa.array(own[c].astype(float)) for c in "xyz"), *colours], ["path", "seq", "x", "y", "z", "red", "green", "blue"],
        )


def _mounted(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, x, y, z, red, green, blue) of ascii and little-endian files.

    Files of a mounted folder are read in ranges of RANGE bytes. Files that only Spark can
    open are read whole, each in one task.
    """
    found = spark.read.format("binaryFile").load(path)
    if not found.select("path").filter(~F.col("path").startswith("file:")).isEmpty():

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    head = _Head.read(io.BytesIO(data))
                    for at, end in head.ranges(len(data), max(1, len(data))):
                        yield from _points(name, 0, head.values(data[at:end], head.count))

        return found.select("path", "content").mapInArrow(parse, _PLY)
    tasks, size = int(spark.conf.get("spark.sql.shuffle.partitions")), RANGE

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(_mounted(name), "rb") as f:
                    parts = list(_Head.read(f).ranges(length, size))
                yield pa.RecordBatch.from_pydict({"path": [name] * len(parts), "at": [a for a, _ in parts], "end": [e for _, e in parts]}, pa.schema([("path", pa.string()), ("at", pa.int64()), ("end", pa.int64())]))

    def opened(rows: pa.RecordBatch) -> Iterator[tuple[dict, _Head, bytes]]:
        for r in rows.to_pylist():
            with open(_mounted(r["path"]), "rb") as f:
                head = _Head.read(f)
                yield r, head, head.part(f, r["at"], r["end"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [head.held(data) for _, head, data in opened(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([h[i] for h in held], pa.int64()) for i in (0, 1))], [*b.schema.names, "lines", "points"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, head, data in opened(b):
                yield from _points(r["path"], r["point"], head.values(data, head.count - r["line"]))

    planned = found.select("path", "length").mapInArrow(ranges, "path string, at long, end long").repartition(tasks)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    placed = planned.mapInArrow(counted, "path string, at long, end long, lines long, points long")
    placed = placed.select("path", "at", "end", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("lines", "line"), ("points", "point"))))
    return placed.repartition(tasks).mapInArrow(points, _PLY)


def read_npy(spark: SparkSession, path: str, values: int = 1 << 20) -> DataFrame:
    """(at, value) of an array file, places counted from 0 in the order of its lines; each task maps its own part."""
    local = path.removeprefix("file://")
    array = np.load(local, mmap_mode="r")
    if not array.flags.c_contiguous:
        raise ValueError(f"{path} is not in the order of lines")
    size = array.size

    def parts(frames):  # noqa: ANN001, ANN202
        flat = np.load(local, mmap_mode="r").reshape(-1)
        for f in frames:
            for i in f["id"].tolist():
                own = flat[i * values : (i + 1) * values]
                yield pd.DataFrame({"at": np.arange(i * values, i * values + len(own)), "value": own.astype(float)})

    count = -(-size // values)
    return spark.range(0, count, 1, max(1, count)).mapInPandas(parts, "at long, value double")


def ply_lines(points: DataFrame) -> DataFrame:
    """The body of an ascii file, a line per point."""
    return points.orderBy("seq").select(F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", "red", "green", "blue").alias("value"))


def read_pgm(spark: SparkSession, path: str, occupied: int = 0, free: int = 254) -> DataFrame:
    """(path, gx, gy, state) of the known cells of binary grey maps; row 0 is the lowest."""

    def parse(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                words, at = [], 0
                while len(words) < 4:
                    end = at
                    while data[end : end + 1].strip():
                        end += 1
                    word = data[at:end]
                    if word.startswith(b"#"):
                        end = data.index(b"\n", at)
                    elif word:
                        words.append(word)
                    at = end + 1
                w, h = int(words[1]), int(words[2])
                grid = np.frombuffer(data, np.uint8, w * h, at).reshape(h, w)[::-1]
                for value, state in ((occupied, "OCCUPIED"), (free, "FREE")):
                    y, x = np.nonzero(grid == value)
                    yield pd.DataFrame({"path": name, "gx": x.astype("int32"), "gy": y.astype("int32"), "state": state})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, gx int, gy int, state string")


def pgm_rows(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(row, pixels) from the top row down: each row's bytes, made in Spark; unknown cells are 205."""
    value = F.when(F.col("state") == "OCCUPIED", "00").when(F.col("state") == "FREE", "FE").otherwise("CD")
    known = cells.filter(F.col("gx").between(0, width - 1) & F.col("gy").between(0, height - 1)).groupBy("gy").agg(F.map_from_entries(F.collect_list(F.struct("gx", value.alias("v")))).alias("m"))
    rows = cells.sparkSession.range(height).select(F.col("id").cast("int").alias("gy")).join(known, "gy", "left")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit("CD"))), "")
    return rows.select((F.lit(height - 1) - F.col("gy")).alias("row"), F.unhex(text).alias("pixels"))
