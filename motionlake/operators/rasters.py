"""Resampling of pictures and disparities, a vector kernel over rows of pixels in Arrow batches.

A raster is a row with `width`, `height` and `pixels`, the values line by line, channels
together. Rows are worked on one at a time and a few lines of output at a time, so what a
task holds does not grow with the number of rasters.

Defined results for odd input: rasters that are null, have no lines or columns or not as
many values as their sizes say give null; values that are null count as 0; infinite places
of a map are outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values of output that are worked on at a time.
TILE = 1 << 18
# Means and deviations of the detector's and the pose model's pictures, by channel.
DETECTOR = ((103.53, 116.28, 123.675), (57.375, 57.12, 58.395))
POSE = ((123.675, 116.28, 103.53), (58.395, 57.12, 57.375))


def sampled(picture: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a picture (height, width, channels) at places inside it."""
    h, w = picture.shape[:2]
    x0, y0 = x.astype(np.int64), y.astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    dx, dy = (x - x0)[..., None], (y - y0)[..., None]
    top = (1 - dx) * (1 - dy) * picture[y0, x0] + dx * (1 - dy) * picture[y0, x1]
    return top + (1 - dx) * dy * picture[y1, x0] + dx * dy * picture[y1, x1]


def _lines(width: int, channels: int) -> int:
    return max(1, TILE // max(1, width * channels))


def resize(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture of another size; centres of pixels lie on each other, and the edge goes on outside."""
    h, w, channels = picture.shape
    out = np.empty((height, width, channels))
    x = np.clip((np.arange(width) + 0.5) * (w / width) - 0.5, 0, w - 1)
    step = _lines(width, channels)
    for a in range(0, height, step):
        b = min(height, a + step)
        y = np.clip((np.arange(a, b) + 0.5) * (h / height) - 0.5, 0, h - 1)
        out[a:b] = sampled(picture, np.broadcast_to(x, (b - a, width)), np.broadcast_to(y[:, None], (b - a, width)))
    return out


def remap(picture: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The values at the places (x, y) of a map, 0 where they are not inside the picture's last line and column."""
    h, w, channels = picture.shape
    out = np.zeros((*x.shape, channels))
    step = _lines(x.shape[1], channels)
    for a in range(0, len(x), step):
        u, v = x[a : a + step], y[a : a + step]
        inside = (u >= 0) & (u < w - 1) & (v >= 0) & (v < h - 1)
        out[a : a + step][inside] = sampled(picture, u[inside], v[inside])
    return out


def _each(df: DataFrame, channels: int, work: Callable[[np.ndarray, dict], tuple[np.ndarray | None, int, int]], more: Sequence[str] = ()) -> DataFrame:
    """df with width, height and pixels as `work` makes them of the picture and the columns `more`."""
    read = ["width", "height", "pixels", *more]
    rest = [c for c in df.columns if c not in ("width", "height", "pixels")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def array(value: pa.Scalar) -> np.ndarray | None:
        return None if not value.is_valid else value.values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                values = array(batch.column("pixels")[i])
                made, width, height = None, None, None
                if values is not None and w and h and w > 0 and h > 0 and len(values) == w * h * channels:
                    made, width, height = work(values.reshape(h, w, channels), {c: array(batch.column(c)[i]) for c in more})
                pixels = pa.array([None if made is None else made.ravel().astype(np.float32)], pa.list_(pa.float32()))
                own = [pa.array([None if made is None else v], pa.int32()) for v in (width, height)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in rest), *own, pixels], [*rest, "width", "height", "pixels"])

    return df.select(*dict.fromkeys([*rest, *read])).mapInArrow(run, f"{kinds}{', ' if kinds else ''}width int, height int, pixels array<float>")


def resized(df: DataFrame, width: int, height: int, channels: int = 1) -> DataFrame:
    """df with all rasters in one size."""
    return _each(df, channels, lambda p, _: (resize(p, width, height), width, height))


def rescaled(df: DataFrame, width: int, height: int) -> DataFrame:
    """Disparities in another size, as pixels of the new width."""
    return _each(df, 1, lambda p, _: (resize(p, width, height) * (width / p.shape[1]), width, height))


def remapped(df: DataFrame, width: int, height: int, x: str = "map_x", y: str = "map_y", channels: int = 1) -> DataFrame:
    """Pictures of whole values 0 to 255 seen through a map: `x` and `y` hold the place of each pixel of the result."""

    def work(picture: np.ndarray, maps: dict) -> tuple[np.ndarray | None, int, int]:
        u, v = maps[x], maps[y]
        if u is None or v is None or len(u) != width * height or len(v) != width * height:
            return None, width, height
        return np.trunc(np.clip(remap(picture, u.reshape(height, width), v.reshape(height, width)), 0, 255)), width, height

    return _each(df, channels, work, [x, y])


def normalised(df: DataFrame, mean: Sequence[float], deviation: Sequence[float], turned: bool = False, planar: bool = True) -> DataFrame:
    """Pictures less the mean over the deviation of each channel; channels turned round first, and one plane after another, if asked."""
    m, d = np.array(mean), np.array(deviation)

    def work(picture: np.ndarray, _: dict) -> tuple[np.ndarray, int, int]:
        h, w = picture.shape[:2]
        out = (picture[..., ::-1] if turned else picture) - m
        out /= d
        return (out.transpose(2, 0, 1) if planar else out), w, h

    return _each(df, len(m), work)
