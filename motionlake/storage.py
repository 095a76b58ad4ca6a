"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset in local mode (tests) a temporary folder is made and set; machines of
    a cluster would not see each other's, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under it for files that are opened by path, so it must be a folder that is mounted on all machines."""
    root = shared_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("files are opened by path: spark.checkpoint.dir must be a mounted folder")
    return f"{root.removeprefix('file://').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read from there."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()
