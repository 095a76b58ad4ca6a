"""Time-stamped messages: rates and gaps, nearest-time joins, repair, decimation, windows.

Every operator works within a recording (the `key` columns), so a plan has one exchange
on that key; as-of joins cut long recordings into ranges of time. Ties in time are broken by `id`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import RANGE, has_long_key, scanned


def ordered(*key: str):
    return Window.partitionBy(*key).orderBy("us", "id")


def interval_stats(messages: DataFrame, key: Sequence[str] = ("bag", "topic"), drop_factor: float = 2.5) -> DataFrame:
    """Count, span, both rates, interval statistics, non-monotonic steps and drops per key."""
    step = messages.withColumn("dt", (F.col("us") - F.lag("us").over(ordered(*key))) / 1e6)
    step = step.withColumn("mean_dt", F.avg("dt").over(Window.partitionBy(*key)))
    span = (F.max("us") - F.min("us")) / 1e6
    out = step.groupBy(*key).agg(
        F.count("*").alias("n"), span.alias("span_s"),
        F.avg("dt").alias("mean_dt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.stddev_pop("dt").alias("std_dt"),
        F.percentile("dt", 0.5).alias("median_dt"), F.percentile("dt", 0.99).alias("p99_dt"),
        F.count_if(F.col("dt") <= 0).alias("non_monotonic"), F.count_if(F.col("dt") > drop_factor * F.col("mean_dt")).alias("drops"),
    )
    positive = F.col("span_s") > 0
    return out.withColumns({
        "rate_hz": F.when(positive, F.col("n") / F.col("span_s")), "step_rate_hz": F.when(positive, (F.col("n") - 1) / F.col("span_s")),
    })


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages of every topic in every bag, 0 where there are none, with the bag's time range."""
    topics = messages.agg(F.array_sort(F.collect_set("topic")).alias("topics"))  # one small row
    bags = messages.groupBy("bag").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    every = bags.join(F.broadcast(topics)).select("bag", "first_us", "last_us", F.explode("topics").alias("topic"))
    counts = messages.groupBy("bag", "topic").agg(F.count("*").alias("n"))
    return every.join(counts, ["bag", "topic"], "left").fillna(0, ["n"])


def neighbours(left: DataFrame, right: DataFrame, key: Sequence[str] = ("bag",), ranges: int | None = None) -> DataFrame:
    """left with before_us (last right at or before) and after_us (first right after) of its key.

    Long keys are cut into ranges of time (scans.scanned), always where `ranges` tells how
    many; short ones are a task's each.
    """
    a = left.select(*key, "us", "id", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_r"))
    b = right.select(*key, "us", "id", F.lit(0).alias("_side"), F.col("us").alias("_r"))
    both, order = a.unionByName(b), ["us", "_side", "id"]
    if ranges or has_long_key(both, key):
        both = scanned(both, key, order, before={"before_us": F.col("_r")}, after={"after_us": F.col("_r")}, ranges=ranges).drop(RANGE)
        return both.filter("_side = 1").drop("_side", "_r")
    # both look back from a row, one of them in the turned order: a frame up to the end is summed anew for each row
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before_us", F.last("_r", True).over(w)).withColumn("after_us", F.last("_r", True).over(back))
    return both.filter("_side = 1").drop("_side", "_r")


def nearest(left: DataFrame, right: DataFrame, key: Sequence[str] = ("bag",), ranges: int | None = None) -> DataFrame:
    """left with the nearest right time and the signed offset; equal distances take the one before."""
    n = neighbours(left, right, key, ranges)
    late, early = F.col("after_us") - F.col("us"), F.col("us") - F.col("before_us")
    pick = F.when(F.col("before_us").isNull() | (late < early), F.col("after_us")).otherwise(F.col("before_us"))
    return n.withColumn("near_us", pick).filter("near_us IS NOT NULL").withColumn("offset_us", F.col("near_us") - F.col("us"))


def sync_verdict(worst_ms: Column, p99_ms: Column) -> Column:
    return F.when(worst_ms < 1, "hardware").when(p99_ms < 15, "software").otherwise("unsynchronised")


def forward(left: DataFrame, right: DataFrame, key: Sequence[str] = ("bag",), ranges: int | None = None) -> DataFrame:
    """The first right at or after each left; lefts without one go."""
    n = neighbours(left.withColumn("us", F.col("us") - 1), right, key, ranges)  # "after" is strict, so step back one tick
    return n.filter("after_us IS NOT NULL").withColumns({"us": F.col("us") + 1}).drop("before_us")


def remapped(messages: DataFrame, target: DataFrame, key: Sequence[str] = ("bag",)) -> DataFrame:
    """messages with their time moved linearly from their own range to the target's range."""
    a = messages.groupBy(*key).agg(F.min("us").alias("a0"), F.max("us").alias("a1"))
    b = target.groupBy(*key).agg(F.min("us").alias("b0"), F.max("us").alias("b1"))
    rel = (F.col("us") - F.col("a0")) / F.greatest(F.lit(100_000.0), (F.col("a1") - F.col("a0")).cast("double"))
    return messages.join(a.join(b, list(key)), list(key)).withColumn("us", F.floor(F.col("b0") + rel * (F.col("b1") - F.col("b0"))).cast("long")).drop("a0", "a1", "b0", "b1")


def tolerance_match(targets: DataFrame, messages: DataFrame, tolerance_us: int, first: bool = False, key: Sequence[str] = ("bag",)) -> DataFrame:
    """For each target the closest message assigned to it, within the tolerance.

    A message goes to its nearest target, or with first=True to the first target in time
    that is near enough. Times are cut into cells of the tolerance, so the join is on equal keys.
    """
    cell = F.floor(F.col("us") / tolerance_us)
    t = targets.select(*key, F.col("us").alias("t_us"), F.col("id").alias("target"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    pairs = messages.select(*key, "us", "id", cell.alias("cell")).join(t, [*key, "cell"])
    gap = F.abs(F.col("us") - F.col("t_us"))
    pairs = pairs.withColumn("gap", gap).filter(F.col("gap") < tolerance_us)
    by = F.struct("t_us", "target") if first else F.struct("gap", "t_us", "target")
    own = pairs.groupBy(*key, "id").agg(F.min_by(F.struct("target", "t_us", "us", "gap"), by).alias("m")).select(*key, "id", "m.*")
    best = own.groupBy(*key, "target", "t_us").agg(F.min_by(F.struct("id", "gap"), F.struct("gap", "us", "id")).alias("m"))
    return best.select(*key, "target", "t_us", F.col("m.id").alias("id"), F.col("m.gap").alias("gap_us"))


def zipped(left: DataFrame, right: DataFrame, key: Sequence[str] = ("bag",)) -> DataFrame:
    """Rows of equal position, as far as the shorter side goes."""
    a = left.select(*key, (F.row_number().over(ordered(*key)) - 1).alias("pos"), F.col("id").alias("left_id"))
    b = right.select(*key, (F.row_number().over(ordered(*key)) - 1).alias("pos"), F.col("id").alias("right_id"))
    return a.join(b, [*key, "pos"])


def decimated(df: DataFrame, keep: int, key: Sequence[str] = ("bag",)) -> DataFrame:
    """Every step-th row, step = max(1, n div keep)."""
    n = F.count("*").over(Window.partitionBy(*key))
    d = df.withColumns({"_n": n, "_at": F.row_number().over(ordered(*key)) - 1})
    return d.filter(F.col("_at") % F.greatest(F.lit(1), F.call_function("div", F.col("_n"), F.lit(keep))) == 0).drop("_n", "_at")


def hashed_sample(df: DataFrame, n: int, id_: str = "id") -> DataFrame:
    """n rows, the same ones each time: those with the least hashes of their id."""
    return df.orderBy(F.md5(F.col(id_).cast("string")), id_).limit(n)


def repaired(df: DataFrame, key: Sequence[str] = ("bag",)) -> DataFrame:
    """repaired_us, counted from the key's first message: as recorded, or spread evenly over the
    key's range if it has a step back or a standstill."""
    w = Window.partitionBy(*key).orderBy("id")
    whole = Window.partitionBy(*key)
    d = df.withColumns({"_step": F.col("us") - F.lag("us").over(w), "_at": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    d = d.withColumns({"_bad": F.max(F.coalesce(F.col("_step") <= 0, F.lit(False))).over(whole), "_a": F.first("us").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_b": F.last("us").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    even = F.col("_at") * (F.col("_b") - F.col("_a")) / F.greatest(F.lit(1), F.col("_n") - 1)
    return d.withColumn("repaired_us", F.when(F.col("_bad"), even).otherwise((F.col("us") - F.col("_a")).cast("double"))).drop("_step", "_at", "_n", "_bad", "_a", "_b")


def majority15(df: DataFrame, vote: Column, key: Sequence[str] = ("bag",)) -> DataFrame:
    """Left if at least half of the last 15 votes are Left."""
    w = ordered(*key).rowsBetween(-14, 0)
    left = F.sum(F.when(vote, 1).otherwise(0)).over(w)
    return df.withColumn("side", F.when(2 * left >= F.count("*").over(w), "Left").otherwise("Right"))


def active15(df: DataFrame, event: Column, key: Sequence[str] = ("bag",)) -> DataFrame:
    """Whether one of this and the last 14 frames has the event."""
    return df.withColumn("active", F.max(event).over(ordered(*key).rowsBetween(-14, 0)))


def rate_limited(df: DataFrame, period_us: int, key: Sequence[str] = ("bag", "topic")) -> DataFrame:
    """The first message of each period, periods counted from time 0."""
    row = F.struct(*(c for c in df.columns if c not in key))
    first = df.groupBy(*key, F.floor(F.col("us") / period_us).alias("_period")).agg(F.min_by(row, F.struct("us", "id")).alias("_row"))
    return first.select(*key, "_row.*").select(*df.columns)


def associated(first: DataFrame, second: DataFrame, tolerance_us: int, key: Sequence[str] = ("bag",)) -> DataFrame:
    """(key, first_us, second_us): each row of a key's shorter side with the nearest time of its longer one.

    Of equal sides the second counts as the shorter. Pairs further apart than the tolerance go.
    """
    both = first.select(*key, "us", "id", F.lit(False).alias("_second")).unionByName(second.select(*key, "us", "id", F.lit(True).alias("_second")))
    whole = Window.partitionBy(*key)
    two = F.sum(F.col("_second").cast("int")).over(whole)
    short = F.col("_second") == F.col("_second_short")
    both = both.withColumn("_second_short", 2 * two <= F.count("*").over(whole))
    near = nearest(both.filter(short), both.filter(~short), [*key, "_second_short"]).filter(F.abs("offset_us") <= tolerance_us)
    at = lambda second: F.when(F.col("_second_short") == F.lit(second), F.col("us")).otherwise(F.col("near_us"))
    return near.select(*key, at(False).alias("first_us"), at(True).alias("second_us"))


def time_synced(left: DataFrame, right: DataFrame, tolerance: str = "10 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(bag, left_id, right_id, left_ts, right_ts): messages at most the tolerance apart, on tables or streams.

    Both sides have (bag, id, ts). Times are cut into cells of the tolerance, so the join is on
    equal keys; on streams the watermarks and the range let the state go.
    """
    us = F.expr(f"timestampdiff(MICROSECOND, timestamp'1970-01-01 00:00:00', timestamp'1970-01-01 00:00:00' + interval {tolerance})")
    cell = lambda ts: F.floor(F.unix_micros(ts) / us)
    a = left.select("bag", F.col("id").alias("left_id"), F.col("ts").cast("timestamp").alias("left_ts")).withWatermark("left_ts", late)
    b = right.select("bag", F.col("id").alias("right_id"), F.col("ts").cast("timestamp").alias("right_ts")).withWatermark("right_ts", late)
    at = cell(F.col("left_ts"))
    a = a.withColumn("_cell", F.explode(F.array(at - 1, at, at + 1)))
    b = b.withColumn("_cell", cell(F.col("right_ts"))).withColumnRenamed("bag", "_bag").withColumnRenamed("_cell", "_right_cell")
    near = F.expr(f"right_ts >= left_ts - interval {tolerance} AND right_ts <= left_ts + interval {tolerance}")
    pairs = a.join(b, (F.col("bag") == F.col("_bag")) & (F.col("_cell") == F.col("_right_cell")) & near)
    return pairs.select("bag", "left_id", "right_id", "left_ts", "right_ts")


def imu_rest(samples: DataFrame, key: Sequence[str] = ("bag",)) -> DataFrame:
    """(key, n, rate_hz, gravity) of inertial samples (us, x, y, z): their rate, and the mean length of what they feel."""
    span = (F.max("us") - F.min("us")) / F.lit(1e6)
    return samples.groupBy(*key).agg(
        F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) / span).alias("rate_hz"),
        F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("gravity"),
    )
