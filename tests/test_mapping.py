"""Picture pairs, lines, colours, markers and smoothed joints against SQL, loops and values by hand."""

import math

import duckdb
import pytest

from motionlake.functions import colours as K
from motionlake.operators import pairing as A
from motionlake.operators import spatial as S
from motionlake.plans import mapping_queries as Q
from motionlake.plans.queries import ORACLE_SQL, QUERIES
from motionlake.streaming import joints as N

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == Q.__name__)
M = "bag long, us long, id long"


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in "lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert rows and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(rows, key=repr)


def paired(messages, poses, near, gap):
    """The same by a loop: messages (us, id, is_right) of one bag."""
    held, out = None, set()
    for us, i, right in sorted(messages):
        if not right:
            pose = next((p for t, p in sorted(poses) if abs(t - us) <= near), None)
            held = None if pose is None else (us, i, pose)
        elif held and abs(us - held[0]) <= gap:
            out.add((held[1], i, held[2]))
            held = None
    return out


def test_stereo_pairs_against_a_loop(spark):
    messages = [(us * 7 % 500, i, us * 13 % 3 == 0) for i, us in enumerate(range(120))]
    poses = [(us, 1000 + us) for us in range(0, 500, 60)]
    side = lambda right: spark.createDataFrame([(1, us, i) for us, i, r in messages if r == right], M)
    got = A.stereo_pairs(side(False), side(True), spark.createDataFrame([(1, us, p) for us, p in poses], M), 15, 4)
    want = paired(messages, poses, 15, 4)
    assert want and {(r.left_id, r.right_id, r.pose_id) for r in got.collect()} == want


def test_next_right(spark):
    lefts, rights = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 9, 3)], M), spark.createDataFrame([(1, 2, 5), (1, 8, 6)], M)
    assert {(r.left_id, r.right_id) for r in A.next_right(lefts, rights).collect()} == {(1, 5), (2, 5)}
    assert [r.left_id for r in A.next_right(lefts, rights, [2]).collect()] == [2]


def line(ax, ay, bx, by):
    """The same by steps: from the left end, with an error that falls by the short side."""
    if bx < ax:
        ax, ay, bx, by = bx, by, ax, ay
    w, h, up = bx - ax, abs(by - ay), 1 if by > ay else -1
    long, short = max(w, h), min(w, h)
    error, out = long - 2 * short, set()
    for _ in range(long + 1):
        out.add((ax, ay))
        side, error = error < 0, error - 2 * short + (2 * long if error < 0 else 0)
        if w >= h:
            ax, ay = ax + 1, ay + (up if side else 0)
        else:
            ax, ay = ax + (1 if side else 0), ay + up
    return out


@pytest.mark.parametrize("ray", [(0, 0, 7, 3), (0, 0, -4, 2), (3, 3, 3, 3), (2, 9, 2, -1), (5, -2, -6, 11), (0, 0, 4, -8), (0, 0, 4, 2)])
def test_lines_against_steps(spark, ray):
    d = spark.createDataFrame([ray], "ax int, ay int, bx int, by int")
    assert {tuple(r) for r in S.line_cells(d).collect()} == line(*ray)


def test_colours_at_the_ends(spark):
    d = spark.createDataFrame([(0.1,), (0.5,), (5.0,), (9.0,), (None,)], "z double")
    assert [r[0] for r in d.select(K.ramp_index(d.z, 0.5, 5.0)).collect()] == [255, 255, 0, 0, None]
    one = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0)], "frame long, seq long, x double, y double, z double")
    r = K.shaded(one, one.x * 100).first()
    assert (r.r, r.g, r.b) == (62, 50, 38)


def test_joints_in_space():
    s = N.hand()
    flat = [(0.0, 0.0, 1.0, 0.9)] * 21
    assert s(flat, 0.0) == flat
    far = [(0.0, 0.0, 2.0, 0.9), (5.0, 5.0, 0.0, 0.0), *flat[2:]]
    out = s(far, 0.1)
    assert math.isclose(out[0][2], 1.0) and out[1] == (0.0, 0.0, 1.0, 0.05)
    b = N.body()
    assert b(far[:17], 0.0)[0][2] == 2.0 and b(far[:17], 0.1)[1] == (5.0, 5.0, 0.0, 0.0)
