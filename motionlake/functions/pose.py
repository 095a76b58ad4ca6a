"""Hand, body and touch rules on joint arrays, as column expressions.

A joint is struct(x, y, c) or struct(x, y, z, c); places are counted from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def apart(a: Column, b: Column, axes: str = "xy") -> Column:
    return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in axes))


def turn(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sign-bearing cross product of the vectors a-b and c-d."""
    return (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])


def chirality(k: Column, least: float = 0.20) -> Column:
    """Left, Right, or Unknown if a deciding joint is unsure: the side of the palm axis on which the
    thumb lies, seen from the side that the knuckles show."""
    unsure = F.least(*(k[j]["c"] for j in (0, 4, 5, 9, 17))) < least
    palm = turn(k[5], k[17], k[9], k[0]) > 0
    thumb = turn(k[9], k[0], k[4], k[5]) > 0
    return F.when(unsure, "Unknown").when(palm == thumb, "Left").otherwise("Right")


def handedness(k: Column) -> Column:
    """The other rule: the thumb's direction from the wrist, by whether the palm faces the camera."""
    facing = turn(k[17], k[5], k[9], k[0]) > 0
    thumb = k[4]["x"] - k[0]["x"]
    return F.when(((thumb < 0) & facing) | ((thumb > 0) & ~facing), "Right Hand").otherwise("Left Hand")


# Tip and middle joint of the four fingers, and of the thumb.
FINGERS = ((8, 6), (12, 10), (16, 14), (20, 18))
THUMB = (4, 2)
STRETCH = 1.15


def extended(k: Column) -> Column:
    """Five flags, thumb first: the tip is clearly farther from the wrist than the middle joint."""
    return F.array(*(apart(k[tip], k[0]) > STRETCH * apart(k[mid], k[0]) for tip, mid in (THUMB, *FINGERS)))


def gesture(f: Column, gap_cm: Column) -> Column:
    """The ladder of gestures; the first that fits counts, so a lone thumb is a fist."""
    n = F.size(F.filter(f, lambda x: x))
    rest = ~f[3] & ~f[4]
    return (
        F.when((gap_cm > 0) & (gap_cm < 3.5), "PINCHING").when(n == 5, "OPEN PALM")
        .when((n == 0) | ((n == 1) & f[0]), "FIST").when(f[1] & ~f[2] & rest, "POINTING")
        .when(f[1] & f[2] & rest, "VICTORY / V").otherwise("MANIPULATING")
    )


def zone(z: Column) -> Column:
    return F.when(z > 2, "GREEN").when(z > 1, "YELLOW").when(z > 0.1, "RED").otherwise("UNKNOWN")


def torso(k: Column, k3: Column, least: float = 0.3) -> tuple[Column, Column]:
    """Middle of the shoulders (else the nose) and of the hips (else 0.4 m under the shoulders)."""
    def mid(a: int, b: int, other: Column) -> Column:
        both = (k[a]["c"] > least) & (k[b]["c"] > least)
        return F.when(both, F.struct(*(((k3[a][c] + k3[b][c]) * 0.5).alias(c) for c in "xyz"))).otherwise(other)

    axes = lambda v, down: F.struct(v["x"].alias("x"), (v["y"] + down).alias("y"), v["z"].alias("z"))
    shoulders = mid(5, 6, axes(k3[0], 0.0))
    return shoulders, mid(11, 12, axes(shoulders, 0.4))


def spine_angle(shoulders: Column, hips: Column) -> Column:
    """Degrees between the line from hips to shoulders and straight up; 0 for a line of no length."""
    d = [shoulders[c] - hips[c] for c in "xyz"]
    n = F.sqrt(sum(x * x for x in d))
    return F.when(n > 1e-4, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -d[1] / n))))).otherwise(F.lit(0.0))


def hands_raised(k: Column, least: float = 0.3) -> Column:
    """A wrist is over its shoulder, both being sure."""
    up = [(k[w]["c"] > least) & (k[s]["c"] > least) & (k[w]["y"] < k[s]["y"]) for w, s in ((9, 5), (10, 6))]
    return up[0] | up[1]


def posture(angle: Column) -> Column:
    return F.when(angle > 40, "WARNING").when(angle > 20, "NORMAL").otherwise("GOOD")


def touching(z: Column) -> Column:
    return (z > 0.1) & (z <= 0.35)


# The joints of the parts, in the order in which they are asked for.
HAND_PARTS = {"thumb": (1, 4), "index": (5, 8), "middle": (9, 12), "ring": (13, 16), "pinky": (17, 20)}
BODY_PARTS = {"head": (0, 1, 2, 3, 4), "l_arm": (5, 7, 9), "r_arm": (6, 8, 10), "torso": (5, 6, 11, 12), "l_leg": (11, 13, 15)}


#: The bones of a hand and of a body as pairs of joints.
HAND_BONES = (
    (0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (11, 12),
    (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20), (5, 9), (9, 13), (13, 17),
)
BODY_BONES = ((0, 1), (0, 2), (1, 3), (2, 4), (5, 7), (7, 9), (6, 8), (8, 10), (5, 6), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16))


def hand_part(a: Column, b: Column) -> Column:
    """The finger of the bone a-b: a is on it, b is on it or the wrist; palm otherwise."""
    part = F.lit("palm")
    for name, (low, high) in reversed(HAND_PARTS.items()):
        part = F.when(a.between(low, high) & (b.between(low, high) | (b == 0)), name).otherwise(part)
    return part


def body_part(a: Column, b: Column) -> Column:
    """The limb that both ends of the bone a-b are on, the first that fits; r_leg otherwise."""
    part = F.lit("r_leg")
    for name, joints in reversed(BODY_PARTS.items()):
        part = F.when(a.isin(*joints) & b.isin(*joints), name).otherwise(part)
    return part


def bone_table(spark: SparkSession, bones: Sequence[tuple[int, int]] = HAND_BONES, part: Callable[[Column, Column], Column] | None = hand_part) -> DataFrame:
    """(bone, a, b, part): one row for each bone."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bones)], "bone int, a int, b int")
    return rows.withColumn("part", part(F.col("a"), F.col("b")) if part else F.lit(None).cast("string"))


def bone_segments(poses: DataFrame, bones: DataFrame, key: Sequence[str], least: float = 0.25, joints: str = "k") -> DataFrame:
    """(key, bone, part, ax, ay, bx, by) of the bones whose ends are both trusted more than `least`.

    Each pose meets the rows of the bone table, which are few and fixed; joints a pose does
    not have make no bone.
    """
    each = poses.select(*key, joints).crossJoin(F.broadcast(bones))
    a, b = F.get(joints, F.col("a")), F.get(joints, F.col("b"))
    sure = (a["c"] > least) & (b["c"] > least)
    return each.filter(sure).select(*key, "bone", "part", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def simcc_in_crop(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """struct(u, v, c): the peaks of both axes as parts of a crop's sides, and the product of their values as trust."""
    part = lambda values: peak(values) / F.size(values)
    return F.struct(
        (left + part(x) * width).alias("u"), (top + part(y) * height).alias("v"), (F.array_max(x) * F.array_max(y)).alias("c"),
    )


def peak(values: Column) -> Column:
    """Place of the greatest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def median(values: Column) -> Column:
    """Of an array; 0 if it is empty."""
    s = F.array_sort(values)
    n = F.size(values)
    mid = F.call_function("div", n, F.lit(2)).cast("int")
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)
