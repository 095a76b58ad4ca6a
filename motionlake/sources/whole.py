"""Whole files written in parallel: clouds (PLY), grids (PGM with YAML), tensors (NPY), JSON documents.

The rows of a file are cut into ranges of their order. A task writes its range's bytes to a
file of its own in a hidden folder beside the file, and a sum over the sizes in front gives
the place where each range begins. The head, which tells counts, is written first, and the
ranges are then copied to their places. A task that is run again writes another file of its
own, or the same bytes to the same place, so it does no harm. The file has a temporary name
until all of it is there.

Files are written by path, at places within them, so all machines must share the folder.

Defined results for odd input: rows that are null in the body count as empty; an empty
table gives a file of a head alone; numbers that are null become 0 in binary files.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import pgm_rows, read_pgm

#: How a row becomes bytes: the bytes of a batch, rows one after another.
Packing = Callable[[pa.RecordBatch], bytes]
# Fields of a cloud's vertex by (name, kind in the head, kind in binary).
PLACE = [(c, "float", "<f4") for c in "xyz"]
COLOUR = [(c, "uchar", "u1") for c in ("red", "green", "blue")]
NORMAL = [*((c, "float", "<f4") for c in ("nx", "ny", "nz")), ("curvature", "float", "<f4")]
# What a grid's cells are in its picture, and the thresholds that tell them.
OCCUPIED_OVER, FREE_UNDER = 0.65, 0.25


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _ranged(between: bytes, pack: Packing | None, scratch: str):
    """Writes each range's bytes to a file of its own; gives (range, file, rows, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, size, name = None, 0, 0, f"{scratch}/{uuid.uuid4().hex}"
        with contextlib.ExitStack() as stack:
            for batch in filter(lambda b: b.num_rows, batches):
                if part is None:
                    part, f = batch.column(0)[0].as_py(), stack.enter_context(open(name, "wb"))
                if pack:
                    data = pack(batch.select(batch.schema.names[1:]))
                else:
                    bodies = batch.column(1).cast(pa.binary()).fill_null(b"")
                    data = between.join(bodies.to_numpy(zero_copy_only=False))
                size += f.write(between) + f.write(data) if rows else f.write(data)
                rows += batch.num_rows
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "rows": [rows], "size": [size]})

    return write


def _placed(parts: Sequence[tuple[str, int]], between: bytes, path: str):
    """Copies the files of ranges, each with what stands in front of it, to their places; gives (range, bytes written)."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, at = parts[i]
                with open(name, "rb") as source, open(path, "r+b") as f:
                    f.seek(at)
                    f.write(between if i else b"")
                    shutil.copyfileobj(source, f, 1 << 20)
                    yield pa.RecordBatch.from_pydict({"part": [i], "written": [f.tell() - at]})

    return copy


def write_whole(
    rows: DataFrame, order: Sequence[str], path: str, head: Callable[[int], bytes] = lambda n: b"", between: bytes = b"", tail: bytes = b"", ranges: int | None = None, body: Column | None = None,
    columns: Sequence[str] = (), pack: Packing | None = None,
) -> int:
    """One file: head(number of rows), the bodies of all rows in order with `between` between two, tail. The number of rows.

    A row's body is the column `body` or the given one, or what `pack` makes of the columns; it is made when rows are in order.
    """
    path, spark = _local(path), rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    source = sorted_.select(F.spark_partition_id().alias("_part"), *(columns if pack else [(F.col("body") if body is None else body).alias("body")]))
    folder = os.path.dirname(path) or "."
    scratch = f"{folder}/.{uuid.uuid4().hex}"
    os.makedirs(scratch)
    try:
        made = sorted(map(tuple, source.mapInArrow(_ranged(between, pack, scratch), "part int, name string, rows long, size long").collect()))  # one row for each range
        count = sum(n for _, _, n, _ in made)
        begin = head(count)
        parts, want, at = [], {}, len(begin)
        for i, (_, name, _, size) in enumerate(made):
            parts.append((name, at))
            want[i] = size + (len(between) if i else 0)
            at += want[i]
        temporary = f"{scratch}/whole"
        with open(temporary, "wb") as f:
            f.write(begin)
            f.truncate(at)
            f.seek(at)
            f.write(tail)
        if made:
            written = spark.range(0, len(made), 1, len(made)).mapInArrow(_placed(parts, between, temporary), "part long, written long")
            if {r.part: r.written for r in written.collect()} != want:
                raise OSError(f"{path}: ranges have other sizes than planned")
        os.replace(temporary, path)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
    return count


# -- clouds --------------------------------------------------------------------------------


def _records(fields: Sequence[tuple[str, str, str]]) -> Packing:
    def pack(batch: pa.RecordBatch) -> bytes:
        out = np.zeros(batch.num_rows, np.dtype([(name, kind) for name, _, kind in fields]))
        for name, _, kind in fields:
            values = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            out[name] = np.clip(values, 0, 255) if kind == "u1" else values
        return out.tobytes()

    return pack


def write_ply(points: DataFrame, path: str, order: Sequence[str] = ("seq",), binary: bool = False) -> int:
    """A cloud's file, ascii or little-endian, of (x, y, z, red, green, blue) and, where the points have them, (nx, ny, nz, curvature)."""
    fields = PLACE + COLOUR + (NORMAL if all(n in points.columns for n, _, _ in NORMAL) else [])
    kind = "binary_little_endian" if binary else "ascii"

    def head(n: int) -> bytes:
        lines = ["ply", f"format {kind} 1.0", f"element vertex {n}", *(f"property {k} {name}" for name, k, _ in fields), "end_header", ""]
        return "\n".join(lines).encode()

    if binary:
        names = [n for n, _, _ in fields]
        return write_whole(points.select(*dict.fromkeys([*order, *names])), order, path, head, columns=names, pack=_records(fields))
    number = lambda name, k: F.coalesce(F.col(name).cast("int" if k == "uchar" else "double"), F.lit(0))
    text = F.format_string(" ".join("%d" if k == "uchar" else "%.4f" for _, k, _ in fields) + "\n", *(number(name, k) for name, k, _ in fields))
    return write_whole(points.select(*dict.fromkeys([*order, *(name for name, _, _ in fields)])), order, path, head, body=text)


# -- grids ---------------------------------------------------------------------------------


def map_yaml(image: str, resolution: float, origin: Sequence[float], negate: int = 0, occupied: float = OCCUPIED_OVER, free: float = FREE_UNDER, mode: str | None = None) -> str:
    x, y, turn = (*origin, 0.0)[:3]
    lines = [f"image: {image}", f"resolution: {resolution!r}", f"origin: [{float(x)!r}, {float(y)!r}, {float(turn)!r}]", f"negate: {negate}", f"occupied_thresh: {occupied!r}", f"free_thresh: {free!r}"]
    return "\n".join(lines + ([f"mode: {mode}"] if mode else [])) + "\n"


def write_map(cells: DataFrame, path: str, width: int, height: int, resolution: float, origin: Sequence[float], **more) -> None:  # noqa: ANN003
    """path.pgm and path.yaml of cells (gx, gy, state); row 0 of the grid is the picture's last."""
    rows = pgm_rows(cells, width, height).select("row", F.col("pixels").alias("body"))
    write_whole(rows, ["row"], f"{path}.pgm", lambda n: f"P5\n{width} {height}\n255\n".encode())
    temporary = f"{_local(path)}.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        f.write(map_yaml(f"{os.path.basename(path)}.pgm", resolution, origin, **more))
    os.replace(temporary, f"{_local(path)}.yaml")


def read_map_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, resolution, x, y, turn, negate, occupied, free, mode) of map descriptions; image is beside its description."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.translate(F.regexp_extract("value", rf"(?m)^{name}:[ \t]*([^#\r\n]*)", 1), "'\"", "")), F.lit(""))

    list_ = F.regexp_replace("value", r"(?m)\r?\n[ \t]*-[ \t]*", ", ")  # a list of one number a line is a list all the same
    origin = F.split(F.regexp_extract(list_, r"(?m)^origin:[ \t]*[\[,]?([^\]\r\n]*)", 1), ",")
    at = lambda i: F.coalesce(F.get(origin, F.lit(i)).try_cast("double"), F.lit(0.0))
    image = field("image")
    beside = F.concat(F.regexp_replace("path", "[^/]*$", ""), image)
    return files.select(
        "path", F.when(image.startswith("/"), image).otherwise(beside).alias("image"), field("resolution").try_cast("double").alias("resolution"), at(0).alias("x"), at(1).alias("y"), at(2).alias("turn"),
        F.coalesce(field("negate").try_cast("int"), F.lit(0)).alias("negate"), F.coalesce(field("occupied_thresh").try_cast("double"), F.lit(OCCUPIED_OVER)).alias("occupied"),
        F.coalesce(field("free_thresh").try_cast("double"), F.lit(FREE_UNDER)).alias("free"), F.coalesce(field("mode"), F.lit("trinary")).alias("mode"),
    )


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, gx, gy, state, x, y) of the known cells of maps given by their descriptions, with each cell's middle in the world.

    Pictures whose greys mean the contrary (negate) are turned round.
    """
    heads = read_map_yaml(spark, path).collect()  # one row for each map
    out = None
    for h in heads:
        greys = (0, 254) if not h.negate else (254, 0)
        cells = read_pgm(spark, h.image, *greys).drop("path")
        middle = lambda c, start: (F.col(c) + 0.5) * h.resolution + F.lit(start)  # noqa: B023, E731
        cells = cells.select(F.lit(h.path).alias("path"), "gx", "gy", "state", middle("gx", h.x).alias("x"), middle("gy", h.y).alias("y"))
        out = cells if out is None else out.unionByName(cells)
    return spark.createDataFrame([], "path string, gx int, gy int, state string, x double, y double") if out is None else out


# -- tensors and documents -------------------------------------------------------------------


def write_npy(rows: DataFrame, path: str, order: Sequence[str], columns: Sequence[str], inner: Sequence[int], kind: str = "<f4") -> int:
    """An array file of shape (outer, *inner): each row gives its columns in order, the rows of all outer places in order.

    The number of rows must be a whole number of times what inner leaves for a place.
    """
    each = int(np.prod(inner)) // len(columns)

    def head(n: int) -> bytes:
        if n % each:
            raise ValueError(f"{n} rows are no whole number of places of {each}")
        text = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({', '.join(map(str, (n // each, *inner)))}{',' if not inner else ''}), }}"
        text += " " * (-(len(text) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode()

    def pack(batch: pa.RecordBatch) -> bytes:
        return np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) for c in batch.columns], axis=1).tobytes()

    return write_whole(rows.select(*dict.fromkeys([*order, *columns])), order, path, head, columns=columns, pack=pack)


def write_document(frames: DataFrame, path: str, head: dict, order: Sequence[str] = ("frame",), key: str = "frames") -> int:
    """One JSON document: the head's fields, then an array of the frames' records (column value) in order."""
    begin = json.dumps(head)[:-1] + (", " if head else "") + json.dumps(key) + ": ["
    return write_whole(frames.select(*order, F.col("value").alias("body")), order, path, lambda n: begin.encode(), b",\n", b"]}\n")


def document_head(name: str, created: str, camera, width: int, height: int, coordinates: str, topology: str) -> dict:  # noqa: ANN001
    """The fields in front of the frames; camera has fx, fy, cx, cy and baseline."""
    lens = {c: float(getattr(camera, c)) for c in ("fx", "fy", "cx", "cy")}
    lens |= {"baseline_meters": float(camera.baseline), "resolution": [int(width), int(height)]}
    return {"dataset_name": name, "created_at": created, "camera_intrinsics": lens, "coordinate_system": coordinates, "keypoint_topology": topology}
