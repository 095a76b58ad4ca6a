"""Payloads of recordings: fields, numbers, pixels, mended row lengths; metadata. The files themselves are in bags.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bags import RecordingSource, copied, register, write_recordings

__all__ = ["RecordingSource", "copied", "register", "write_recordings"]


def little_endian(data: Column, at: Column | int, size: int = 4) -> Column:
    """An unsigned whole number in a payload, `at` counted from 0."""
    digits = F.hex(F.substring(data, F.lit(at) + 1, F.lit(size)))
    return F.conv(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10).cast("long")


def stamp(data: Column) -> Column:
    """Seconds of the header stamp: whole seconds at byte 4, nanoseconds at byte 8."""
    return little_endian(data, 4) + little_endian(data, 8) * F.lit(1e-9)


def image_size(data: Column, mark: str = "mono8") -> Column:
    """struct(width, height), found before the encoding's name; null without it."""
    at = F.instr(F.decode(data, "ISO-8859-1"), F.lit(mark))
    number = lambda back: little_endian(data, at - 1 - back)
    return F.when(at > 12, F.struct(number(8).alias("width"), number(12).alias("height")))


def little_endian_double(data: Column, at: int) -> Column:
    """A number of 64 bits in a payload; null where the payload ends before it."""
    low, high = little_endian(data, at), little_endian(data, at + 4)
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(2047))
    part = (high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(2**32) + low).cast("double")
    size = (
        F.when(exponent == 0, part * 2.0**-1074).when(exponent < 2047, (1 + part * 2.0**-52) * F.pow(F.lit(2.0), exponent - 1023))
        .when(part == 0, float("inf")).otherwise(float("nan"))
    )
    return F.when(F.length(data) >= at + 8, F.when(high >= 2**31, -size).otherwise(size))


def acceleration(data: Column, at: int = 232) -> Column:
    """struct(x, y, z) of an inertial message."""
    return F.struct(*(little_endian_double(data, at + 8 * i).alias(c) for i, c in enumerate("xyz")))


def _mark(data: Column, mark: str) -> Column:
    """Where the encoding's name begins, counted from 0; -1 without it."""
    return F.instr(F.decode(data, "ISO-8859-1"), F.lit(mark)) - 1


def raw_pixels(data: Column, mark: str = "mono8", sizes: Sequence[tuple[int, int]] = ((1920, 1200), (960, 600))) -> Column:
    """struct(width, height, pixels): the end of the payload, in the first size that fits behind the encoding's name."""
    at = _mark(data, mark)
    found = F.lit(None)
    for w, h in reversed(sizes):
        pixels = F.substring(data, F.length(data) - w * h + 1, F.lit(w * h))
        picture = F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), pixels.alias("pixels"))
        found = F.when((at >= 0) & (F.length(data) - at > w * h), picture).otherwise(found)
    return found


def patched_step(data: Column, mark: str = "mono8") -> Column:
    """The payload with the row length set to the width; other payloads as they are."""
    at = _mark(data, mark)
    step = at + (len(mark) + 5) // 4 * 4
    width = F.substring(data, at - 7, F.lit(4))
    new = F.concat(F.substring(data, F.lit(1), step), width, F.substring(data, step + 5, F.length(data)))
    return F.when((at >= 12) & (F.length(data) >= step + 4), new).otherwise(data)


def patched(messages: DataFrame, topics: Sequence[str], mark: str = "mono8") -> DataFrame:
    """messages, on a table or a stream, with the row length of the topics' pictures mended; `changed` tells which."""
    new = F.when(F.col("topic").isin(*topics), patched_step(F.col("data"), mark)).otherwise(F.col("data"))
    return messages.withColumn("_new", new).withColumns({"changed": ~F.col("_new").eqNullSafe(F.col("data")), "data": F.col("_new")}).drop("_new")


def patch_recordings(spark: SparkSession, path: str, topics: Sequence[str], folder: str | None = None, mark: str = "mono8") -> int:
    """Mend the row lengths in the recordings of a folder, in place or into another folder; the number of messages changed.

    Files are written beside the old ones and take their place when all are ready.
    """
    register(spark)
    read = lambda: spark.read.format("recording").load(path)  # noqa: E731  Spark keeps the filters of a loaded table for its later uses
    mended = patched(read(), topics, mark)
    count = patched(read().filter(F.col("topic").isin(*topics)), topics, mark).filter("changed").count()
    if count or folder:
        copied(spark, path, folder or path, mended)
    return count


def metadata(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """(bag, value): the YAML that goes beside a recording, from its real first and last times and counts.

    topics: (topic, type, format, qos), every one of them named, with 0 where a recording has none.
    """
    counts = messages.groupBy("bag", "topic").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    whole = counts.groupBy("bag").agg(
        F.sum("n").alias("n"), (F.min("a") * 1000).alias("start"), ((F.max("b") - F.min("a")) * 1000).alias("long"),
        F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("by_topic"),
    )
    listed = topics.agg(F.array_sort(F.collect_list(F.struct("topic", "type", "format", "qos"))).alias("topics"))
    text = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    entry = lambda t: F.concat(
        F.lit("  - topic_metadata:\n      name: "), text(t["topic"]), F.lit("\n      type: "), text(t["type"]),
        F.lit("\n      serialization_format: "), text(t["format"]), F.lit("\n      offered_qos_profiles: "), text(t["qos"]),
        F.lit("\n    message_count: "), F.coalesce(F.try_element_at("by_topic", t["topic"]), F.lit(0)), F.lit("\n"),
    )
    file = F.concat(F.col("bag").cast("string"), F.lit(".db3"))
    value = F.concat(
        F.lit("rosbag2_bagfile_information:\n  version: 5\n  storage_identifier: sqlite3\n  duration:\n    nanoseconds: "), "long",
        F.lit("\n  starting_time:\n    nanoseconds_since_epoch: "), "start", F.lit("\n  message_count: "), "n",
        F.lit("\n  topics_with_message_count:\n"), F.array_join(F.transform("topics", entry), ""),
        F.lit("  compression_format: ''\n  compression_mode: ''\n  relative_file_paths:\n  - "), text(file),
        F.lit("\n  files:\n  - path: "), text(file), F.lit("\n    starting_time:\n      nanoseconds_since_epoch: "), "start",
        F.lit("\n    duration:\n      nanoseconds: "), "long", F.lit("\n    message_count: "), "n", F.lit("\n"),
    )
    return whole.crossJoin(F.broadcast(listed)).select("bag", value.alias("value"))
