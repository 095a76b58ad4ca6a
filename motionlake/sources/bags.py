"""Recordings in SQLite files as a data source: scans with pushed filters, streams, and a two-phase sink.

    spark.read.format("recording").load("/folder")                      messages
    spark.read.format("recording").option("table", "topics").load(...)  topics, schema, metadata, files
    spark.readStream.format("recording").load("/folder")
    rows.write.format("recording").mode("overwrite").save("/folder")

Filters on topic, id, us and ns reach the files: a range of time is read through the index
on time, anything else by ranges of row numbers, and a file is cut into as many partitions
as it has SPLIT rows. Files that are too small to hold so many are not opened for that, and
a partition takes GROUP bytes of them. Files are opened by path, so all machines must share
the folder.

A write puts each recording into a file of its own under a temporary name, commits rows in
batches and makes the index when all are in. Only when every task has ended are the files
renamed; where one fails, all that the write made is removed.
"""

from __future__ import annotations

import functools
import glob
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

SUFFIX = ".db3"
#: Rows of a partition, and rows of a commit.
SPLIT = 1_000_000
BATCH = 500
#: Bytes of small files of a partition; the least bytes of a row; rows and bytes of what is handed to Spark at a time.
GROUP = 1 << 23
ROW = 9
READ_ROWS, READ_BYTES = 1 << 13, 1 << 22
LOW, HIGH = -(2**63), 2**63 - 1
TABLES = {
    "messages": "bag string, id long, topic string, type string, us long, data binary, ns long, format string, qos string",
    "topics": "bag string, id long, topic string, type string, format string, qos string",
    "schema": "bag string, schema_version long, distro string",
    "metadata": "bag string, id long, metadata_version long, value string",
    "files": "bag string, path string, messages long, first_us long, last_us long",
}
#: What the sink takes; `kind` is message, topic, schema or metadata.
ROWS = "bag string, kind string, topic string, type string, format string, qos string, id long, ns long, data binary, version long, value string"
# The tables of a recording.
DDL = (
    "CREATE TABLE schema (schema_version INTEGER PRIMARY KEY, ros_distro TEXT NOT NULL)",
    "CREATE TABLE metadata (id INTEGER PRIMARY KEY, metadata_version INTEGER NOT NULL, metadata TEXT NOT NULL)",
    "CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT NOT NULL, type TEXT NOT NULL, serialization_format TEXT NOT NULL, offered_qos_profiles TEXT NOT NULL)",
    "CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER NOT NULL, timestamp INTEGER NOT NULL, data BLOB NOT NULL)",
)
INDEX = "CREATE INDEX timestamp_idx ON messages (timestamp ASC)"


def opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def listed(options: dict) -> list[str]:
    """The files of the options paths (by commas) and path (a file, a folder or a pattern)."""
    found = []
    for p in [*options.get("paths", "").split(","), options.get("path", "")]:
        p = p.removeprefix("file://").strip()
        if os.path.isdir(p):
            found += sorted(glob.glob(f"{glob.escape(p)}/*{SUFFIX}"))
        elif p:
            found += sorted(glob.glob(p)) if glob.has_magic(p) else [p]
    return list(dict.fromkeys(f for f in found if not os.path.basename(f).startswith(".")))


def _bounded(value: int) -> int:
    return min(max(value, LOW), HIGH)


@dataclass
class Wanted:
    """What the filters let through: closed ranges of ns and id, and topics (None: all)."""

    ns: tuple[int, int] = (LOW, HIGH)
    id: tuple[int, int] = (LOW, HIGH)
    topics: frozenset[str] | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With one more filter; None where it can't be asked of a file."""
        name = f.attribute[0].lower() if len(getattr(f, "attribute", ())) == 1 else ""
        if name == "topic" and isinstance(f, (EqualTo, In)):
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            return Wanted(self.ns, self.id, values if self.topics is None else self.topics & values)
        if isinstance(f, IsNotNull) and name in ("topic", "us", "ns", "id"):
            return self  # they never are
        value = getattr(f, "value", None)
        if name not in ("us", "ns", "id") or not isinstance(value, int):
            return None
        low, high = {
            EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value),
        }.get(type(f), (None, None))
        if low is None and high is None:
            return None
        unit = 1000 if name == "us" else 1  # a microsecond holds a thousand nanoseconds
        low, high = LOW if low is None else _bounded(low * unit), HIGH if high is None else _bounded(high * unit + unit - 1)
        cut = lambda r: (max(r[0], low), min(r[1], high))
        return Wanted(cut(self.ns), self.id, self.topics) if name != "id" else Wanted(self.ns, cut(self.id), self.topics)

    @property
    def nothing(self) -> bool:
        return self.topics == frozenset() or self.ns[0] > self.ns[1] or self.id[0] > self.id[1]

    def condition(self) -> tuple[str, list]:
        """SQL over messages m and topics t."""
        parts, values = ["1"], []
        for column, (low, high) in (("m.timestamp", self.ns), ("m.id", self.id)):
            if low > LOW:
                parts.append(f"{column} >= ?")
                values.append(low)
            if high < HIGH:
                parts.append(f"{column} <= ?")
                values.append(high)
        if self.topics is not None:
            parts.append(f"t.name IN ({', '.join('?' * len(self.topics))})")
            values += sorted(self.topics)
        return " AND ".join(parts), values


@dataclass
class Part(InputPartition):
    """Rows of a file."""

    path: str
    wanted: Wanted = field(default_factory=Wanted)


@dataclass
class Group(InputPartition):
    """Small files that are read one after another."""

    paths: list[str]
    wanted: Wanted = field(default_factory=Wanted)


def grouped(sizes: Sequence[tuple[str, int]], wanted: Wanted) -> list[Group]:
    """Partitions of about GROUP bytes of whole files."""
    out, room = [], 0
    for path, size in sizes:
        if not out or size > room:
            out.append(Group([], wanted))
            room = GROUP
        out[-1].paths.append(path)
        room -= size
    return out


def _size(path: str) -> int:
    """Bytes of a file and of what is still to be written into it."""
    log = f"{path}-wal"
    return os.path.getsize(path) + (os.path.getsize(log) if os.path.exists(log) else 0)


def planned(path: str, wanted: Wanted, split: int) -> list[Part]:
    """Partitions of a file: by time where the filters bound it and there is an index, else by row number."""
    if wanted.nothing:
        return []
    with opened(path) as db:
        timed = wanted.ns != (LOW, HIGH) and any(
            db.execute(f"PRAGMA index_info('{r[1]}')").fetchone()[2] == "timestamp" for r in db.execute("PRAGMA index_list(messages)")
        )
        column, (low, high) = ("timestamp", wanted.ns) if timed else ("id", wanted.id)
        first, last, n = db.execute(f"SELECT min({column}), max({column}), count(*) FROM messages WHERE {column} BETWEEN ? AND ?", (low, high)).fetchone()
    if not n:
        return []
    count = min(-(-n // split), last - first + 1)
    cuts = [first + (last - first + 1) * i // count for i in range(count)] + [last + 1]
    ranges = [(a, b - 1) for a, b in zip(cuts, cuts[1:])]
    return [Part(path, Wanted(r, wanted.id, wanted.topics) if timed else Wanted(wanted.ns, r, wanted.topics)) for r in ranges]


def messages(part: Part) -> Iterator[tuple]:
    """The rows of a partition, in the order of time."""
    condition, values = part.wanted.condition()
    with opened(part.path) as db:
        yield from (
            (part.path, i, name, kind, ns // 1000, data, ns, format_, qos)
            for i, name, kind, ns, data, format_, qos in db.execute(
                "SELECT m.id, t.name, t.type, m.timestamp, m.data, t.serialization_format, t.offered_qos_profiles "
                f"FROM messages m JOIN topics t ON t.id = m.topic_id WHERE {condition} ORDER BY m.timestamp, m.id", values,
            )
        )


def _batch(path: str, topics: dict[int, tuple], rows: list[tuple]) -> pa.RecordBatch:
    """(id, topic_id, ns, data) as a batch of messages."""
    ids, kinds, ns, data = zip(*rows)
    known = sorted(topics)
    at = pa.array(np.searchsorted(known, kinds))
    topic, type_, format_, qos = (pa.array([topics[t][i] for t in known], pa.string()).take(at) for i in range(4))
    nanos = np.array(ns, np.int64)
    columns = [pa.repeat(pa.scalar(path, pa.string()), len(rows)), pa.array(ids, pa.int64()), topic, type_, pa.array(nanos // 1000), pa.array(data, pa.binary()), pa.array(nanos), format_, qos]
    return pa.RecordBatch.from_arrays(columns, ["bag", "id", "topic", "type", "us", "data", "ns", "format", "qos"])


def _read_batches(parts: Iterable[Part]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        condition, values = part.wanted.condition()
        with opened(part.path) as db:
            topics = {i: more for i, *more in db.execute("SELECT id, name, type, serialization_format, offered_qos_profiles FROM topics")}
            found = db.execute(f"SELECT m.id, t.id, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE {condition} ORDER BY m.timestamp, m.id", values)
            rows, size = [], 0
            while more := found.fetchmany(256):
                rows += more
                size += sum(len(r[3] or b"") for r in more)
                if len(rows) >= READ_ROWS or size >= READ_BYTES:
                    yield _batch(part.path, topics, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(part.path, topics, rows)


def batches(parts: Iterable[Part]) -> Iterator[pa.RecordBatch]:
    """The rows of partitions as Arrow batches, those of small files together."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for b in _read_batches(parts):
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= READ_ROWS or size >= READ_BYTES:
            yield whole()
            held, rows, size = [], 0, 0
    if held:
        yield whole()


def _others(table: str, path: str) -> Iterator[tuple]:
    with opened(path) as db:
        if table == "files":
            n, a, b = db.execute("SELECT count(*), min(timestamp), max(timestamp) FROM messages").fetchone()
            yield path, path, n, a and a // 1000, b and b // 1000
            return
        names = {"topics": "id, name, type, serialization_format, offered_qos_profiles", "schema": "schema_version, ros_distro", "metadata": "id, metadata_version, metadata"}
        if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
            yield from ((path, *r) for r in db.execute(f"SELECT {names[table]} FROM {table} ORDER BY 1"))


class Reader(DataSourceReader):
    def __init__(self, options: dict, table: str) -> None:
        self.table, self.paths, self.split = table, listed(options), int(options.get("split", SPLIT))
        micro = lambda name, default: int(options.get(name, default))
        self.wanted = Wanted((_bounded(micro("from_us", LOW) * 1000), _bounded(micro("to_us", HIGH) * 1000 + 999)))
        if options.get("topics"):
            self.wanted.topics = frozenset(options["topics"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            narrowed = self.wanted.narrowed(f) if self.table == "messages" else None
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self) -> Sequence[InputPartition]:
        sizes = [(p, _size(p)) for p in self.paths]
        if self.table != "messages":
            return grouped(sizes, self.wanted)
        if self.wanted.nothing:
            return []
        small = grouped([(p, size) for p, size in sizes if size <= self.split * ROW], self.wanted)
        return small + [part for p, size in sizes if size > self.split * ROW for part in planned(p, self.wanted, self.split)]

    def parts(self, partition: Part | Group | None) -> Iterator[Part]:
        if partition is not None:  # it is where there are no partitions
            yield from (Part(p, partition.wanted) for p in partition.paths) if isinstance(partition, Group) else [partition]

    def read(self, partition: Part | Group | None) -> Iterator[tuple]:
        for part in self.parts(partition):
            yield from messages(part) if self.table == "messages" else _others(self.table, part.path)


class BatchReader(Reader):
    """The same; messages come as Arrow batches."""

    def read(self, partition: Part | Group | None) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        return batches(self.parts(partition)) if self.table == "messages" else super().read(partition)


class StreamReader(DataSourceStreamReader):
    """New messages of a folder's files: the offset of a file is the number of its last row that has been read."""

    def __init__(self, options: dict) -> None:
        self.options, self.split = options, int(options.get("split", SPLIT))
        self.topics = frozenset(options["topics"].split(",")) if options.get("topics") else None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for path in listed(self.options):
            with opened(path) as db:
                found[path] = db.execute("SELECT coalesce(max(id), 0) FROM messages").fetchone()[0]
        return found

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges = [(path, (start.get(path, LOW + 1) + 1 if path in start else LOW, last)) for path, last in sorted(end.items())]
        return [part for path, ids in ranges for part in planned(path, Wanted(id=ids, topics=self.topics), self.split)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return messages(partition)

    def commit(self, end: dict) -> None:
        pass  # files stay


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, final name) of each file of a task."""

    files: list[tuple[str, str]]


@functools.cache
def _empty() -> bytes:
    """A recording without rows."""
    with closing(sqlite3.connect(":memory:")) as db:
        for line in DDL:
            db.execute(line)
        return db.serialize()


class _Recording:
    """One file that is being written."""

    def __init__(self, temporary: str) -> None:
        self.topics: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.path = temporary
        with open(temporary, "wb") as f:
            f.write(_empty())
        self.db = sqlite3.connect(temporary)
        self.db.execute("PRAGMA synchronous = OFF")  # nobody sees the file before it is whole and on disk
        self.db.execute("PRAGMA journal_mode = MEMORY")

    def topic(self, name: str, kind: str | None, format_: str | None, qos: str | None) -> int:
        if name not in self.topics:
            self.topics[name] = len(self.topics) + 1
            self.db.execute("INSERT INTO topics VALUES (?, ?, ?, ?, ?)", (self.topics[name], name, kind or "raw", format_ or "cdr", qos or ""))
        return self.topics[name]

    def add(self, row: dict) -> None:
        """Anything but a message."""
        if row["kind"] == "schema":
            self.db.execute("INSERT OR REPLACE INTO schema VALUES (?, ?)", (row["version"], row["value"] or ""))
        elif row["kind"] == "metadata":
            self.db.execute("INSERT INTO metadata (metadata_version, metadata) VALUES (?, ?)", (row["version"], row["value"] or ""))
        else:
            self.topic(row["topic"], row["type"], row["format"], row["qos"])

    def add_messages(self, topics: list[int], ns: list[int], data: list[bytes], batch: int) -> None:
        self.rows.extend(zip(topics, ns, data))
        whole = len(self.rows) // batch * batch
        for i in range(0, whole, batch):
            self.put(self.rows[i : i + batch])
        self.rows = self.rows[whole:]

    def put(self, rows: list[tuple]) -> None:
        self.db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", rows)
        self.db.commit()

    def done(self) -> None:
        self.put(self.rows)
        self.db.execute(INDEX)
        self.db.commit()
        self.db.close()
        with open(self.path, "rb") as f:
            os.fsync(f.fileno())


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """The place of each text among the distinct ones, and these."""
    d = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(), d.dictionary.to_pylist()


class Writer(DataSourceArrowWriter):
    """Rows of ROWS, sorted by bag, into one file for each bag; see recording_rows."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.batch, self.overwrite = int(options.get("batch", BATCH)), overwrite
        self.mark = f".{uuid.uuid4().hex}"  # of this write: tells its temporary files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        made: list[tuple[str, str]] = []
        now, at = None, None
        try:
            for batch in iterator:
                (bag, bags), (kind, kinds), (topic, topics) = (_codes(batch.column(c)) for c in ("bag", "kind", "topic"))
                ns, data = batch.column("ns"), batch.column("data").cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False)
                new = np.flatnonzero((np.diff(bag) != 0) | (np.diff(kind) != 0)) + 1
                for first, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows] if batch.num_rows else []):
                    if now is None or bags[bag[first]] != at:
                        if now is not None:
                            now.done()
                        at, temporary = bags[bag[first]], f"{self.folder}/{self.mark}-{uuid.uuid4().hex}"
                        made.append((temporary, f"{self.folder}/{'null' if at is None else at}{SUFFIX}"))
                        now = _Recording(temporary)
                    if kinds[kind[first]] != "message":
                        for row in batch.slice(first, end - first).to_pylist():
                            now.add(row)
                        continue
                    _, places = np.unique(topic[first:end], return_index=True)
                    ids = np.zeros(len(topics), np.int64)
                    for place in sorted(places.tolist()):  # in the order in which they come
                        code = topic[first + place]
                        ids[code] = now.topics.get(topics[code]) or now.topic(topics[code], *(batch.column(c)[first + place].as_py() for c in ("type", "format", "qos")))
                    times = ns.slice(first, end - first)
                    now.add_messages(ids[topic[first:end]].tolist(), times.to_pylist() if times.null_count else times.to_numpy().tolist(), data[first:end].tolist(), self.batch)
            if now is not None:
                now.done()
        except BaseException:
            _remove(t for t, _ in made)
            raise
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        taken = [name for _, name in files if os.path.exists(name)]
        if taken and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{taken[0]} is there already")
        for temporary, name in files:
            os.replace(temporary, name)
        self.abort([])  # what tasks left that ran twice

    def abort(self, messages: list[Written | None]) -> None:
        """Also the files of tasks whose message never came."""
        _remove(glob.glob(f"{glob.escape(self.folder)}/{self.mark}-*"))


def _remove(paths: Iterable[str]) -> None:
    for p in paths:
        for name in (p, f"{p}-journal"):
            if os.path.exists(name):
                os.remove(name)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def _table(self) -> str:
        table = self.options.get("table", "messages")
        if table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BatchReader(dict(self.options), self._table())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def stem(path: Column) -> Column:
    """A recording's name, from the path of its file; empty for other files."""
    last = F.substring_index(path, "/", -1)
    return F.when(last.endswith(SUFFIX), F.substring(last, F.lit(1), F.length(last) - len(SUFFIX))).when(last.isNotNull(), "")


def recording_rows(messages: DataFrame, topics: DataFrame | None = None, schema: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """What the sink takes, each bag in one task: its schema, metadata and topics, then its messages by time.

    messages: (bag, id, topic, us, data) and any of (ns, type, format, qos). topics: (bag,
    topic) and any of (type, format, qos), also of topics without messages. schema: (bag,
    schema_version, distro). metadata: (bag, metadata_version, value).
    """
    have = lambda df, c, kind="string": F.col(c).cast(kind).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c)
    bag = F.col("bag").cast("string").alias("bag")
    ns = F.col("ns") if "ns" in messages.columns else F.col("us") * 1000
    rows = messages.select(
        bag, F.lit("message").alias("kind"), F.col("topic"), *(have(messages, c) for c in ("type", "format", "qos")), F.col("id").cast("long").alias("id"),
        ns.cast("long").alias("ns"), F.col("data").cast("binary").alias("data"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("value"), F.lit(3).alias("_at"),
    )
    if topics is not None:
        own = topics.select(bag, F.lit("topic").alias("kind"), "topic", *(have(topics, c) for c in ("type", "format", "qos")), have(topics, "id", "long"), F.lit(2).alias("_at"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    for df, kind, version, value in ((schema, "schema", "schema_version", "distro"), (metadata, "metadata", "metadata_version", "value")):
        if df is not None:
            own = df.select(bag, F.lit(kind).alias("kind"), F.col(version).cast("long").alias("version"), F.col(value).alias("value"), F.lit(1).alias("_at"))
            rows = rows.unionByName(own, allowMissingColumns=True)
    return rows.repartition("bag").sortWithinPartitions("bag", "_at", "ns", "id").drop("_at")


def write_recordings(
    messages: DataFrame, folder: str, batch: int = BATCH, topics: DataFrame | None = None, schema: DataFrame | None = None, metadata: DataFrame | None = None, overwrite: bool = True,
) -> DataFrame:
    """One file for each bag, all or none; (bag, path, messages, first_us, last_us) of the files. See recording_rows."""
    spark = messages.sparkSession
    register(spark)
    kind = messages.schema["bag"].dataType.simpleString()
    rows = recording_rows(messages, topics, schema, metadata)
    rows.write.format("recording").option("batch", batch).mode("overwrite" if overwrite else "append").save(folder)
    files = spark.read.format("recording").option("table", "files").load(folder)
    name = stem(F.col("path"))
    bags = messages.select(F.col("bag").cast("string").alias("_bag")).distinct()
    own = files.withColumn("bag", F.when(name != "null", name)).join(F.broadcast(bags), F.col("bag").eqNullSafe(F.col("_bag")), "left_semi")
    return own.withColumn("bag", F.col("bag").try_cast(kind))


def copied(spark: SparkSession, source: str, folder: str, messages: DataFrame | None = None, bag=None) -> DataFrame:  # noqa: ANN001
    """Recordings of `source` written to `folder` with all four tables, messages replaced by the given ones of the same bags.

    `bag` makes a file's path the name of its copy; without it the name stays.
    """
    register(spark)
    read = lambda table: spark.read.format("recording").option("table", table).load(source)
    named = bag or stem
    moved = lambda df: df.withColumn("bag", named(F.col("bag")))
    own = moved(read("messages") if messages is None else messages)
    return write_recordings(own, folder, topics=moved(read("topics")), schema=moved(read("schema")), metadata=moved(read("metadata")))
