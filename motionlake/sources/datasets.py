"""Files around recordings: finding them, calibrations, summaries, matrices and exported data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = r"\[([^\]]*)\]"


def find_files(spark: SparkSession, folders: Sequence[str], pattern: str = "*.db3") -> DataFrame:
    """(path, modified, bytes) of files below the folders whose name fits, each once, by path; contents are not read, empty files left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(list(folders))
    found = found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.dropDuplicates(["path"]).orderBy("path")


def first_in_folder(files: DataFrame) -> DataFrame:
    """(folder, path): of each folder the file whose path comes first."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.min("path").alias("path"))


def latest_folder(files: DataFrame) -> DataFrame:
    """One row (folder, modified): the folder that holds the file changed last; of equal times the last path."""
    best = files.agg(F.max_by(F.struct("path", "modified"), F.struct("modified", "path")).alias("m")).filter("m is not null")
    return best.select(F.regexp_replace("m.path", "/[^/]*$", "").alias("folder"), "m.modified")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def read_stereo_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(path, camera, width, height, intrinsics, distortion, to_previous) of each camera of a stereo calibration.

    intrinsics are fx, fy, cx, cy; to_previous has the 16 numbers, by rows, of the transform
    from the camera before, empty for the first one.
    """
    cameras = _texts(spark, path).select("path", F.explode(F.split("value", r"(?m)^(?=cam[0-9]+\s*:)")).alias("s"))
    cameras = cameras.withColumn("camera", F.regexp_extract("s", r"^(cam[0-9]+)\s*:", 1)).filter("camera <> ''")
    listed = lambda name: _numbers(F.regexp_extract("s", rf"(?m)^\s*{name}\s*:\s*{_LIST}", 1))
    size = listed("resolution")
    turn = _numbers(F.regexp_extract("s", r"T_cn_cnm1\s*:\s*((?:-\s*\[[^\]]*\]\s*)+)", 1))
    return cameras.select(
        "path", "camera", F.get(size, F.lit(0)).cast("int").alias("width"), F.get(size, F.lit(1)).cast("int").alias("height"),
        listed("intrinsics").alias("intrinsics"), listed("distortion_coeffs").alias("distortion"), turn.alias("to_previous"),
    )


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, fx, fy, cx, cy, k2, k3, k4, k5) of fisheye camera files."""
    one = lambda name: F.regexp_extract("value", rf"(?m)^\s*{name}\s*:\s*(\S+)", 1).try_cast("double")
    names = {"fx": "mu", "fy": "mv", "cx": "u0", "cy": "v0"} | {k: k for k in ("k2", "k3", "k4", "k5")}
    size = [one(n).cast("int").alias(a) for a, n in (("width", "image_width"), ("height", "image_height"))]
    return _texts(spark, path).select("path", *size, *(one(n).alias(a) for a, n in names.items()))


def read_summaries(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The run summaries found, with their path; a schema saves a first reading of them all."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True).withColumn("path", F.input_file_name())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, numbers) of rows of numbers between spaces; line rises with the place; comments and blank lines go.

    A row that holds anything else has null in place of it.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line"), F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("t"))
    numbers = F.transform(F.split("t", r"\s+"), lambda x: x.try_cast("double"))
    return lines.filter("t <> ''").select("path", "line", numbers.alias("numbers"))


def summary_json(runs: DataFrame, digits: int = 4) -> DataFrame:
    """(bag, value): each run's numbers as one JSON object, decimals rounded."""
    fields = [F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in runs.dtypes]
    return runs.select("bag", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def summary_text(runs: DataFrame) -> DataFrame:
    """(bag, value): the same numbers in lines to be read, one for each column."""
    head = F.concat(F.lit("=== run summary: "), F.col("bag").cast("string"), F.lit(" ===\n"))
    lines = [F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("\n")) for c in runs.columns if c != "bag"]
    return runs.select("bag", F.concat(head, *lines).alias("value"))


def frame_records(hands: DataFrame) -> DataFrame:
    """(frame, value): the JSON record of each frame, its hands in order.

    hands: (frame, hand, x1, y1, x2, y2, score, k), k with 21 joints (x, y, z, c). The gap is
    that of thumb and index tip in cm, -1 where one of them has no depth.
    """
    tip, thumb = F.col("k")[8], F.col("k")[4]
    gap = F.sqrt(sum((thumb[c] - tip[c]) * (thumb[c] - tip[c]) for c in "xyz")) * 100
    wrist = F.col("k")[0]
    record = F.struct(
        F.col("hand").alias("hand_index"), F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"), F.col("score").alias("det_score"),
        F.array(wrist["x"], wrist["y"], wrist["z"]).alias("wrist_3d_m"),
        F.when((thumb["z"] > 0.1) & (tip["z"] > 0.1), gap).otherwise(F.lit(-1.0)).alias("pinch_gap_cm"),
        F.transform("k", lambda j: F.array(j["x"], j["y"], j["z"], j["c"])).alias("keypoints_3d_xyz_conf"),
    )
    frames = hands.select("frame", record.alias("r")).groupBy("frame").agg(F.array_sort(F.collect_list("r")).alias("hands"))
    return frames.select("frame", F.to_json(F.struct(F.col("frame").alias("frame_index"), "hands")).alias("value"))


#: What frame_records writes.
RECORD = (
    "frame_index long, hands array<struct<hand_index: int, bbox_xyxy: array<double>, det_score: double, wrist_3d_m: array<double>, "
    "pinch_gap_cm: double, keypoints_3d_xyz_conf: array<array<double>>>>"
)


def write_lines(rows: DataFrame, path: str) -> None:
    """One text line for each row's value, in files of a folder."""
    rows.select("value").write.text(path)


def write_imu_csv(frames: DataFrame, path: str) -> None:
    """A line for each sample of each frame.

    frames: (frame_idx, exp_start_us, exp_end_us, samples), samples an array of structs
    (imu_time_us, acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z).
    """
    rows = frames.select("frame_idx", "exp_start_us", "exp_end_us", F.posexplode("samples").alias("sample_idx", "s"))
    rows.select("frame_idx", "exp_start_us", "exp_end_us", "sample_idx", "s.*").write.option("header", True).csv(path)


def preferred(first: DataFrame, other: DataFrame, key: str = "bag") -> DataFrame:
    """The rows of `first`, and those of `other` for keys that `first` lacks."""
    return first.unionByName(other.join(first.select(key).distinct(), key, "left_anti"))
