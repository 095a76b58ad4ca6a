"""Sensor tables made from the driver's tables by fixed rules, in Spark and in DuckDB SQL.

A recording (bag) is a user of `events`, a topic an event type; poses walk in whole
centimetres so that sums are exact; points, pixels and keypoints come from `lineitem` and
`embeddings`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEFT, RIGHT, IMU = "view", "click", "error"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bag, topic, us, value, data)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("bag"), F.col("event_type").alias("topic"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.col("props").alias("data"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bag, seq, id, us, ts, x, y, z, qz, qw), seq from 0 in time order within a bag."""
    m = messages(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    w = Window.partitionBy("bag").orderBy("us", "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    half = (F.col("id") % 628) / F.lit(200.0)
    walk = {"x": F.col("c") % 201 - 100, "y": F.expr("c div 7") % 201 - 100, "z": F.expr("c div 31") % 21 - 10}
    return m.select(
        "bag", (F.row_number().over(w) - 1).cast("long").alias("seq"), "id", "us", (F.col("us") / 1e6).alias("ts"),
        *((F.sum(step).over(run) / 100.0).alias(axis) for axis, step in walk.items()),
        F.sin(half).alias("qz"), F.cos(half).alias("qw"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, seq, x, y, z, d): a point cloud and a disparity, one per line item."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_discount") * 20).alias("z"),
        (1 + F.col("l_extendedprice") / 1000).alias("d"), (F.col("l_orderkey") % 960).cast("int").alias("u"), (F.col("l_partkey") % 600).cast("int").alias("v"),
    )


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, hand, k, score): k holds 21 joints (x, y, c), c between 0 and 1."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.struct(
        F.round(F.col("e")[j * 3] * 100, 4).alias("x"), F.round(F.col("e")[j * 3 + 1] * 100, 4).alias("y"), F.round(F.abs(F.col("e")[j * 3 + 2]) * 4, 4).alias("c")))
    rows = read(spark, sf_dir, "embeddings").withColumn("e", e)
    return rows.select(F.expr("vec_id div 2").alias("frame"), (F.col("vec_id") % 2).cast("int").alias("hand"), joints.alias("k"), F.col("e")[63].alias("score"))


# The same in DuckDB SQL, as common table expressions.
MESSAGES_SQL = "m AS (SELECT event_id AS id, user_id AS bag, event_type AS topic, epoch_us(ts) AS us, value, props AS data FROM events)"
POSES_SQL = MESSAGES_SQL + """,
c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM m),
p AS (SELECT bag, row_number() OVER w - 1 AS seq, id, us, us / 1e6 AS ts,
        CAST(sum(c % 201 - 100) OVER w AS BIGINT) / 100.0 AS x, CAST(sum((c // 7) % 201 - 100) OVER w AS BIGINT) / 100.0 AS y, CAST(sum((c // 31) % 21 - 10) OVER w AS BIGINT) / 100.0 AS z,
        sin((id % 628) / 200.0) AS qz, cos((id % 628) / 200.0) AS qw
      FROM c WINDOW w AS (PARTITION BY bag ORDER BY us, id ROWS UNBOUNDED PRECEDING))"""
POINTS_SQL = """pt AS (SELECT l_orderkey AS frame, l_orderkey * 10 + l_linenumber AS seq, l_quantity / 10 AS x, l_extendedprice / 20000 AS y, l_discount * 20 AS z,
        1 + l_extendedprice / 1000 AS d, CAST(l_orderkey % 960 AS INT) AS u, CAST(l_partkey % 600 AS INT) AS v FROM lineitem)"""
HANDS_SQL = """h AS (SELECT vec_id // 2 AS frame, CAST(vec_id % 2 AS INT) AS hand,
        list_transform(range(21), lambda j: {'x': round(CAST(embedding[3*j+1] AS DOUBLE) * 100, 4), 'y': round(CAST(embedding[3*j+2] AS DOUBLE) * 100, 4), 'c': round(abs(CAST(embedding[3*j+3] AS DOUBLE)) * 4, 4)}) AS k,
        CAST(embedding[64] AS DOUBLE) AS score FROM embeddings)"""
