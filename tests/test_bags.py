"""Recordings as a source with pushed filters, as a stream with its own offsets, and as a two-phase sink."""

import os
import re
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from motionlake.sources import bags as B
from motionlake.sources import recordings as R

IMAGE = bytes(4) + (600).to_bytes(4, "little") + (960).to_bytes(4, "little") + (6).to_bytes(4, "little") + b"mono8\0\0\0"


def step(value):
    return IMAGE + value.to_bytes(4, "little") + b"pixels"


def rows_of(n, bag="a"):
    return [(bag, i, "left" if i % 3 else "imu", 1000 * i, step(2880)) for i in range(n)]


SCHEMA = "bag string, id long, topic string, us long, data binary"


@pytest.fixture()
def folder(spark, tmp_path):
    """Two recordings with topics that have no messages, qualities of service, schema and metadata."""
    topics = spark.createDataFrame([(b, t, k, "cdr", q) for b in "ab" for t, k, q in (("left", "image", "- history: 3"), ("imu", "inertial", "best effort"), ("never", "none", ""))], "bag string, topic string, type string, format string, qos string")
    schema = spark.createDataFrame([("a", 3, "one"), ("b", 4, "two")], "bag string, schema_version long, distro string")
    notes = spark.createDataFrame([("a", 1, "text of a"), ("a", 2, "more")], "bag string, metadata_version long, value string")
    made = R.write_recordings(spark.createDataFrame(rows_of(2000) + rows_of(7, "b"), SCHEMA), str(tmp_path / "bags"), topics=topics, schema=schema, metadata=notes)
    assert {(r.bag, r.messages, r.first_us, r.last_us) for r in made.collect()} == {("a", 2000, 0, 1_999_000), ("b", 7, 0, 6000)}
    return str(tmp_path / "bags")


def load(spark, folder, **options):
    return spark.read.format("recording").options(**options).load(folder)


def test_all_tables_come_back(spark, folder):
    name = F.regexp_extract("bag", r"([^/]*)\.db3$", 1).alias("bag")
    topics = {tuple(r) for r in load(spark, folder, table="topics").select(name, "topic", "type", "format", "qos").collect()}
    assert topics == {(b, *t) for b in "ab" for t in (("left", "image", "cdr", "- history: 3"), ("imu", "inertial", "cdr", "best effort"), ("never", "none", "cdr", ""))}
    assert {tuple(r) for r in load(spark, folder, table="schema").select(name, "schema_version", "distro").collect()} == {("a", 3, "one"), ("b", 4, "two")}
    assert [tuple(r) for r in load(spark, folder, table="metadata").select(name, "metadata_version", "value").orderBy("metadata_version").collect()] == [("a", 1, "text of a"), ("a", 2, "more")]
    m = load(spark, folder, split=300).filter(name == "a").orderBy("us").collect()
    assert [(r.topic, r.us, r.ns, bytes(r.data), r.type) for r in m[:2]] == [("imu", 0, 0, step(2880), "inertial"), ("left", 1000, 1_000_000, step(2880), "image")]
    assert len(m) == 2000
    with sqlite3.connect(f"{folder}/a.db3") as db:
        assert [r[1] for r in db.execute("PRAGMA index_list(messages)")] == ["timestamp_idx"]
    with pytest.raises(Exception, match="table must be one of"):
        load(spark, folder, table="nothing").count()


def fetched(folder, filters, split=100):
    """(rows read from the files, partitions, filters left to Spark)."""
    reader = B.Reader({"path": folder, "split": str(split)}, "messages")
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    return [row for p in parts for row in reader.read(p)], parts, left


def test_filters_read_only_their_range(folder):
    rows, parts, left = fetched(folder, [GreaterThanOrEqual(("us",), 500_000), LessThan(("us",), 700_000)])
    assert sorted(r[4] for r in rows) == [1000 * i for i in range(500, 700)] and not left and len(parts) == 2
    rows, _, left = fetched(folder, [In(("topic",), ("imu", "never")), GreaterThanOrEqual(("ns",), 1_990_000_000), StringContains(("topic",), "m")])
    assert [r[4] for r in rows] == [1_992_000, 1_995_000, 1_998_000] and [type(f) for f in left] == [StringContains]
    rows, parts, _ = fetched(folder, [EqualTo(("id",), 7)], split=1)
    assert [r[1] for r in rows] == [7, 7] and len(parts) == 2
    assert fetched(folder, [EqualTo(("topic",), "left"), EqualTo(("topic",), "imu")])[:2] == ([], [])
    assert fetched(folder, [EqualTo(("us",), 10**17)])[0] == [] and fetched(folder, [GreaterThanOrEqual(("us",), 2**63 - 1)])[0] == []
    rows, parts, _ = fetched(folder, [])
    assert len(rows) == 2007 and len(parts) == 21 and max(sum(1 for _ in B.messages(p)) for p in parts) <= 100
    with B.opened(f"{folder}/a.db3") as db:
        part = fetched(folder, [LessThan(("us",), 9000)])[1][0]
        condition, values = part.wanted.condition()
        plan = " ".join(r[3] for r in db.execute(f"EXPLAIN QUERY PLAN SELECT m.id FROM messages m JOIN topics t ON t.id = m.topic_id WHERE {condition}", values))
        assert "timestamp_idx" in plan


def test_pushed_filters_give_what_spark_would(spark, folder):
    R.register(spark)
    whole = [(r.us, r.topic, r.id, r.ns) for r in load(spark, folder, split=150).collect()]
    conditions = {
        "us BETWEEN 10000 AND 20000 AND topic = 'imu'": lambda us, topic, i, ns: 10000 <= us <= 20000 and topic == "imu",
        "topic IN ('left', 'x') AND id > 1990": lambda us, topic, i, ns: topic == "left" and i > 1990,
        "us < 5000 OR us > 1995000": lambda us, topic, i, ns: us < 5000 or us > 1995000,
        "ns = 7000000": lambda us, topic, i, ns: ns == 7000000,
        "topic <> 'imu' AND us >= 1999000": lambda us, topic, i, ns: topic != "imu" and us >= 1999000,
        "us IS NULL": lambda us, topic, i, ns: False,
        "topic LIKE 'l%' AND us = 1000": lambda us, topic, i, ns: topic == "left" and us == 1000,
    }
    for condition, holds in conditions.items():
        got = load(spark, folder, split=150).filter(condition).collect()
        assert sorted((r.us, r.topic, r.id, r.ns) for r in got) == sorted(r for r in whole if holds(*r)), condition
    plan = load(spark, folder).filter("us > 10 AND topic = 'imu'")._jdf.queryExecution().executedPlan().toString()
    assert not any("us#" in line for line in plan.splitlines() if line.strip(" +-*(0123456789)").startswith("Filter"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    R.register(spark)
    bad = F.udf(lambda us: 1 // (us - 5000), "long")
    df = spark.createDataFrame(rows_of(10) + rows_of(3, "b"), SCHEMA).withColumn("us", F.when(F.col("bag") == "a", bad("us")).otherwise(F.col("us")))
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="ZeroDivision"):
        R.write_recordings(df, out)
    assert not os.path.isdir(out) or os.listdir(out) == []
    R.write_recordings(spark.createDataFrame(rows_of(3), SCHEMA), out)
    with pytest.raises(Exception, match="is there already"):
        R.write_recordings(spark.createDataFrame(rows_of(4), SCHEMA), out, overwrite=False)
    assert os.listdir(out) == ["a.db3"] and load(spark, out).count() == 3


def test_a_write_that_breaks_off_within_a_file_removes_it(tmp_path):
    writer = B.Writer({"path": str(tmp_path), "batch": "2"}, True)
    with pytest.raises(RuntimeError):
        writer.write(_broken_off())
    assert os.listdir(tmp_path) == []


def _broken_off():
    import pyarrow as pa

    row = {"bag": "a", "kind": "message", "topic": "t", "type": None, "format": None, "qos": None, "id": 1, "ns": 1, "data": b"", "version": None, "value": None}
    yield pa.RecordBatch.from_pylist([row] * 5)
    raise RuntimeError


def test_steps_are_mended_in_place_and_counted(spark, folder):
    with sqlite3.connect(f"{folder}/b.db3") as db:
        db.execute("UPDATE messages SET data = ? WHERE id = 2", (step(960),))
    before = load(spark, folder, table="topics").select("topic", "qos").collect()
    assert R.patch_recordings(spark, folder, ["left"]) == 2000 - 667 + 4 - 1
    got = load(spark, folder).collect()
    assert len(got) == 2007 and all(bytes(r.data) == (step(960) if r.topic == "left" else step(2880)) for r in got)
    assert load(spark, folder, table="topics").select("topic", "qos").collect() == before
    assert load(spark, folder, table="metadata").count() == 2
    assert R.patch_recordings(spark, folder, ["left"]) == 0


def test_a_stream_yields_each_message_once_over_restarts(spark, tmp_path):
    R.register(spark)
    folder, state, out = str(tmp_path / "bags"), str(tmp_path / "state"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("recording").option("split", 4).load(folder).select("bag", "id", "topic", "us")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((os.path.basename(r.bag), r.id) for r in spark.read.parquet(out).collect())

    R.write_recordings(spark.createDataFrame(rows_of(10), SCHEMA), folder)
    assert run() == [("a.db3", i) for i in range(1, 11)]
    assert run() == [("a.db3", i) for i in range(1, 11)]
    with sqlite3.connect(f"{folder}/a.db3") as db:  # the recording goes on
        db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (1, ?, x'00')", [(10**9 + i,) for i in range(5)])
    R.write_recordings(spark.createDataFrame(rows_of(3, "b"), SCHEMA), folder)
    assert run() == [("a.db3", i) for i in range(1, 16)] + [("b.db3", i) for i in range(1, 4)]


def test_odd_recordings(spark, tmp_path):
    rows = [(None, 1, "t", 5, b"x"), ("c", 2, "t", -5, None), ("c", 1, "u", -5, b"")]
    made = R.write_recordings(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "o")).collect()
    assert {(r.bag, r.messages, r.first_us) for r in made} == {(None, 1, 5), ("c", 2, -5)}
    assert sorted((r.us, r.topic, bytes(r.data)) for r in load(spark, str(tmp_path / "o")).collect()) == [(-5, "t", b""), (-5, "u", b""), (5, "t", b"x")]
    assert R.write_recordings(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0
    assert load(spark, str(tmp_path / "none")).count() == 0


def test_small_recordings_share_partitions(spark, tmp_path, monkeypatch):
    """Planning opens none of them, and there is no task for each."""
    rows = [(f"b{k}", i, ("left", "imu", "left")[i % 3], 1000 * (i - 1), step(i)) for k in range(40) for i in range(3)]
    R.write_recordings(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(B, "opened", None)
        parts = B.Reader({"path": str(tmp_path)}, "messages").partitions()
    assert len(parts) == 1 and len(parts[0].paths) == 40
    assert load(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    want = sorted((f"{tmp_path}/{b}.db3", i + 1, topic, "raw", us, us * 1000, data) for b, i, topic, us, data in rows)
    assert sorted((r.bag, r.id, r.topic, r.type, r.us, r.ns, bytes(r.data)) for r in load(spark, str(tmp_path)).collect()) == want
    got = load(spark, str(tmp_path)).filter("us < 0 AND topic = 'left'").collect()
    assert sorted(r.bag for r in got) == sorted({w[0] for w in want}) and {r.us for r in got} == {-1000}
    monkeypatch.setattr(B, "GROUP", 5 * os.path.getsize(want[0][0]))
    reader = B.Reader({"path": str(tmp_path)}, "messages")
    assert len(reader.partitions()) == 8 and len([r for p in reader.partitions() for r in reader.read(p)]) == 120


def test_batches_are_the_rows(tmp_path):
    """Topics in the order of their first message, over batches of the sink and of the reader."""
    import pyarrow as pa

    row = {"kind": "message", "type": None, "format": None, "qos": "q", "version": None, "value": None}
    rows = [row | {"bag": b, "id": i, "topic": t, "ns": n, "data": d} for b, i, t, n, d in (("a", 1, "z", -1001, b"1"), ("a", 2, "y", 5, None), ("a", 3, "z", 7, b""), (None, 4, "x", 9, b"\x00"))]
    writer = B.Writer({"path": str(tmp_path), "batch": "2"}, True)
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows[:2]), pa.RecordBatch.from_pylist(rows[2:])]))])
    plain, packed = B.Reader({"path": str(tmp_path)}, "messages"), B.BatchReader({"path": str(tmp_path)}, "messages")
    (part,) = plain.partitions()
    got = list(plain.read(part))
    assert [tuple(r.values()) for b in packed.read(part) for r in b.to_pylist()] == got
    assert [(os.path.basename(r[0]), r[1], r[2], r[3], r[4], r[5], r[6], r[8]) for r in got] == [
        ("a.db3", 1, "z", "raw", -2, b"1", -1001, "q"), ("a.db3", 2, "y", "raw", 0, b"", 5, "q"), ("a.db3", 3, "z", "raw", 0, b"", 7, "q"), ("null.db3", 1, "x", "raw", 0, b"\x00", 9, "q"),
    ]
    with B.opened(f"{tmp_path}/a.db3") as db:
        assert db.execute("SELECT id, name FROM topics ORDER BY id").fetchall() == [(1, "z"), (2, "y")]


def test_tables_of_small_recordings_share_partitions(spark, tmp_path):
    rows = [(f"b{k}", i, "left", 1000 * i, b"") for k in range(40) for i in range(2)]
    R.write_recordings(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    for table, n in (("topics", 40), ("files", 40), ("schema", 0)):
        got = load(spark, str(tmp_path), table=table)
        assert got.rdd.getNumPartitions() == 1 and got.count() == n
    assert {(r.messages, r.first_us, r.last_us) for r in load(spark, str(tmp_path), table="files").collect()} == {(2, 0, 1000)}


def test_names_of_recordings_take_one_look(spark):
    """A search that tries each place of a path takes minutes for these, and took most of the time of a copy."""
    import time

    paths = ["/a/b.c/12.db3", "x.db3", "/a/.db3", "/a.db3/b", "/a/x.db3.txt", "/a/db3", "", None]
    got = spark.createDataFrame([(p,) for p in paths], "path string").select(B.stem(F.col("path"))).collect()
    assert [r[0] for r in got] == ["12", "x", "", "", "", "", "", None]
    began = time.monotonic()
    assert spark.range(40).select(B.stem(F.concat(F.repeat(F.lit("a"), F.lit(100_000)), F.col("id").cast("string"))).alias("n")).filter("n <> ''").count() == 0
    assert time.monotonic() - began < 20


def test_mending_counts_by_reading_only_the_topics(spark, folder, monkeypatch):
    asked = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "count", lambda self, f=frame.count: asked.append(self._jdf.queryExecution().optimizedPlan().toString()) or f(self))
    assert R.patch_recordings(spark, folder, ["left"]) == 2000 - 667 + 4
    assert len(asked) == 1 and re.search(r"topic#\d+ = left", asked[0])
