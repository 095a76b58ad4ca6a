"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular-expression body of the ASCII white space that separates words.
SPACE = r"\x20\x09-\x0D"
ARROW_ROWS = 2500
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which all machines of a cluster share.

    Where the setting is absent in local mode (tests) a temporary folder is made and set;
    machines of a cluster would not see each other's, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    for made in _OPEN.get():
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows, so that a batch of long texts stays small; a setting of the caller's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """work, after which the worker, which lives on, gives back the memory that it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


#: Lists of stored paths of the scratch blocks that are open around the running code.
_OPEN: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open_scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside the block go at its end; the given function stores one that stays."""
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        made.pop()
        return out

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        discard(spark, made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the quick way serves texts of one byte per character."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, breaks: str = SPACE) -> Column:
    """The maximal runs of characters outside the class `breaks`, in order; null gives no words."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{breaks}]+")
    return F.filter(parts, lambda w: w != "")


def digest_column(name: str, taken: list[str]) -> str:
    """A working column name that clashes with none of `taken`, ignoring case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def opaque(value: Column) -> Column:
    """value, in a form through which the optimizer moves no later filter.

    A filter on a long chain of array expressions would otherwise be rewritten onto the
    source columns, and stored arrays would be computed again inside each function call.
    """
    return F.when(F.spark_partition_id() >= 0, value)
