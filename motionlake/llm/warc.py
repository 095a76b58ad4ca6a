"""WARC: archives written from, and read back as, a chunked record table.

A payload travels as (record, chunk number, bytes) rows of at most CHUNK bytes, made by
Spark from the page. The writer appends chunk after chunk to its task's archive and
carries the digest along, so neither side of the Python boundary ever holds a whole
record; the reader streams archives block by block and gives chunk rows back, each with
the digest of the payload so far. The last chunk's digest is the payload's.

Each record is a gzip member of its own, as is usual for WARC, so archives can be joined
end to end. Archives go to the shared folder through pyarrow's file systems. A task writes under a
name of its own attempt and hands the name back as a row; only names in that committed
manifest are read, so a lost executor or a repeated task leaves nothing behind that is
read twice.

Defined results for odd input: a null payload is an empty one; an empty payload is one
chunk of no bytes; pages that repeat a page_id each have their record, and are responses
if they bear their group's largest id; equal pages have equal record ids; columns beyond
page_id, url and the payload are not archived; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_column, releasing, shared_dir, stored, table

CHUNK = 256 * 1024
REVISIT_BYTES = 1000
BLOCK = 1 << 16
GZIP = 31  # zlib's window bits for gzip members
RECORD = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, chunk_start long, chunk_bytes long, running_digest string, last boolean"


def roles(pages: DataFrame, payload: str, key: str = "page_id", least: int = REVISIT_BYTES) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Groups are found on keys and digests alone. Pages are joined with their revisits by key
    and digest, so a payload that many pages share is not one key of a join with payloads.
    """
    body = F.col(payload).cast("binary")  # the same bytes, not a copy
    measured = {"payload_bytes": F.coalesce(F.octet_length(body), F.lit(0)).cast("long"), "payload_digest": F.sha1(F.coalesce(body, F.lit(b"")))}
    pages = pages.withColumns(measured)
    k, d, top = (digest_column(c, pages.columns) for c in ("_key", "_digest", "_response"))
    narrow = stored(pages.filter(F.col("payload_bytes") >= least).select(F.col(key).alias(k), F.col("payload_digest").alias(d)), "digests")
    groups = narrow.groupBy(d).agg(F.max(k).alias(top), F.count("*").alias("copies")).filter("copies > 1").select(d, top)
    others = narrow.join(groups, d).filter(~F.col(k).eqNullSafe(F.col(top))).distinct()
    joined = pages.join(others, F.col(key).eqNullSafe(F.col(k)) & (F.col("payload_digest") == F.col(d)), "left")
    revisit = F.col(d).isNotNull()
    own = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col(top))}
    return joined.withColumns(own).drop(k, d, top)


def chunked(pages: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk, in order: the record's columns, chunk_no, data and last.

    Revisits carry no payload. Chunks of one record stay next to each other in their
    partition, since nothing is dealt out after they are made.
    """
    body = F.col(payload).cast("binary")
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.coalesce(F.octet_length(body), F.lit(0)))
    last = F.greatest(F.lit(0), F.call_function("div", size - 1, F.lit(chunk))).cast("int")
    rows = pages.select(*RECORD, body.alias("body"), size.cast("long").alias("content_bytes"), F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_no", "n"))
    return rows.select(
        *RECORD, "content_bytes", "chunk_no",
        F.when(F.col("content_bytes") > 0, F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("data"),
        (F.col("chunk_no") == F.greatest(F.lit(0), F.call_function("div", F.col("content_bytes") - 1, F.lit(chunk)))).alias("last"),
    )


def _record_id(page: object, digest: str) -> str:
    """The same for the same page and payload, so that revisits can name the record they refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {digest}')}>"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: object) -> str:
    """A header value: no line breaks."""
    return "".join(c for c in str(value) if c not in "\r\n")


def _head(row: dict) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_record_id(row['page_id'], row['payload_digest'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"Content-Length: {row['content_bytes']}",
        f"WARC-Payload-Digest: {_b32(row['payload_digest'])}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}")
        lines.append(f"X-Refers-To-Page: {row['refers_to']}")
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, records, size, digest, pack = None, None, 0, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files, root = pafs.FileSystem.from_uri(folder)
                    files.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(name, buffer_size=BLOCK)
                if row["chunk_no"] == 0:
                    digest = hashlib.sha1()
                    pack = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                    size += out.write(pack.compress(_head(row)))
                size += out.write(pack.compress(row["data"]))
                digest.update(row["data"])
                if row["last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"payload of page {row['page_id']} changed on its way to the archive")
                    size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return write


def write_archives(pages: DataFrame, payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write one archive per task; the committed manifest (path, records, bytes)."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = chunked(pages, payload, chunk)
    return stored(rows.mapInArrow(releasing(_writer(folder)), "path string, records long, bytes long"), "warc-manifest")


class _Stream:
    """The bytes of a gzipped or plain archive, read in blocks: heads and pieces of bounded size."""

    def __init__(self, source) -> None:
        self.source, self.held, self.packed, self.unpack = source, b"", b"", None
        self.plain = None

    def more(self) -> bool:
        if not self.packed:
            self.packed = self.source.read(BLOCK)
        if not self.packed:
            if self.unpack is not None:
                raise ValueError("archive ends inside a gzip member")
            return False
        if self.plain is None:
            self.plain = self.packed[:2] != b"\x1f\x8b"
        if self.plain:
            self.held, self.packed = self.held + self.packed, b""
            return True
        self.unpack = self.unpack or zlib.decompressobj(GZIP)
        self.held += self.unpack.decompress(self.packed, BLOCK)
        if self.unpack.eof:
            self.packed, self.unpack = self.unpack.unused_data, None
        else:
            self.packed = self.unpack.unconsumed_tail
        return True

    def head(self) -> bytes | None:
        """Up to and without the next blank line; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record")
                return None
        found, self.held = self.held[:at], self.held[at + 4 :]
        return found

    def piece(self, most: int) -> bytes:
        while len(self.held) < most and self.more():
            pass
        if len(self.held) < most:
            raise ValueError("archive ends inside a payload")
        found, self.held = self.held[:most], self.held[most:]
        return found


def records(source, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of one archive."""
    stream = _Stream(source)
    while (head := stream.head()) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, no, start, digest = int(fields["content-length"]), 0, 0, hashlib.sha1()
        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
        while True:
            data = stream.piece(min(left, chunk))
            left -= len(data)
            digest.update(data)
            revisit = fields["warc-type"] == "revisit"
            yield {
                "record_id": fields["warc-record-id"], "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"),
                "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page"), "chunk_no": no, "chunk_start": start,
                "chunk_bytes": number("x-payload-length") if revisit else len(data),
                "running_digest": base64.b32decode(fields["warc-payload-digest"][5:]).hex() if revisit else digest.hexdigest(),
                "last": left == 0, "data": data,
            }
            no, start = no + 1, start + len(data)
            if not left:
                break
        if stream.piece(4) != b"\r\n\r\n":
            raise ValueError("a record has no end mark")


def _reader(chunk: int, with_data: bool):
    names = ["record_id", "page_id", "url", "record_type", "refers_to", "chunk_no", "chunk_start", "chunk_bytes", "running_digest", "last"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)) + ([("data", pa.binary())] if with_data else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, where in zip(batch["path"].to_pylist(), batch["folder"].to_pylist()):
                files, _ = pafs.FileSystem.from_uri(where)
                with files.open_input_stream(path) as source:
                    held, size = [], 0
                    for row in records(source, chunk):
                        held.append(row)
                        size += 200 + (len(row["data"]) if with_data else 0)
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_archives(manifest: DataFrame, with_data: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in a manifest, one archive to a task."""
    spark = manifest.sparkSession
    root = spark.conf.get("spark.checkpoint.dir")
    files = manifest.select("path", F.lit(root).alias("folder"))
    count = max(1, manifest.count())
    return files.repartition(count, "path").mapInArrow(_reader(chunk, with_data), RECORD_SCHEMA + (", data binary" if with_data else ""))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(roles(pages, "html"), "html")
    ends = read_archives(manifest).filter("last")
    return ends.select(
        "page_id", (F.col("chunk_start") + F.col("chunk_bytes")).alias("payload_bytes"), F.col("running_digest").alias("payload_digest"), "record_type", "refers_to"
    )


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM g
"""
