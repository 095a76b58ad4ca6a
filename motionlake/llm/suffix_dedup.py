"""Suffix-array dedup: bytes covered by long strings that a document with a smaller id has.

The collection is cut so that equal strings of LENGTH bytes always meet: each such string
has an anchor, the least hash of the shorter grams inside it, and neighbouring strings
with the same anchor are one piece of text. Pieces whose anchor occurs in one document
only can hold nothing repeated. All others are dealt out by anchor, and each task builds
the Burrows-Wheeler transform and the common-prefix array of its pieces column by column:
a round inserts one symbol of every piece, from its end on, where the last round's order
puts it, and both arrays go through sequential files in the task's own scratch folder,
one round's file being read while the next one's is written. A collection has at most
about COLLECTION bytes, or one anchor's pieces, so a round's arrays also fit in memory. In
the finished order a run of prefixes of LENGTH or more is one string's places; the
smallest doc_id of a run owns it, and every other document's places are repeats. Where all
pieces of an anchor are equal there is nothing to sort: their smallest doc_id owns them.

Texts are read once into compressed slices in the shared folder, named by the partition
they come from, so that a repeated task writes the same again. What is shuffled are packed
arrays, pre-aggregated per slice: anchors with their least and greatest doc_id, verdicts on
them, distinct pieces with theirs, and the owners of pieces. Where a piece stands is known
to its slice alone, in a second file. So a passage that all documents share sends a few
bytes for each slice, not for each document. An anchor that has more than a share of its
bucket's distinct pieces is dealt out again string by string.

Defined results for odd input: null texts are empty; rows without doc_id lose nothing and
take nothing from others; rows that repeat a doc_id take nothing from each other; texts
under LENGTH bytes stay whole; columns other than the key and the text are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .bytescan import U64
from .common import releasing, shared_dir, table

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1  # grams in a string, and the most strings in a piece
#: A key with more distinct pieces than this, and than this share of its bucket, is dealt out again.
HOT, HOT_SHARE = 1024, 0.25
#: Bytes of text in a slice, in a bucket, windows that are hashed at a time, and suffixes of one collection.
SLICE = 4 << 20
BUCKET = 16 << 20
CHUNK = 1 << 20
COLLECTION = 1 << 18
NOBODY = np.iinfo(np.int64).min

PACKED = "slice string, bucket int, packed binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their first bytes, then their second bytes and so on, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [np.array([len(a), a.dtype.itemsize], np.int64).tobytes(), a.dtype.str.encode().ljust(8), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.int64, 2, at)
        kind = raw[at + 16 : at + 24].decode().strip()
        body = np.frombuffer(raw, np.uint8, n * width, at + 24).reshape(width, n).T
        out.append(np.ascontiguousarray(body).view(kind).ravel())
        at += 24 + int(n * width)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, number of strings) of each piece: neighbouring strings of one text with one anchor."""
    keys, firsts, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[c : c + CHUNK + LENGTH - 1]
        sums = bytescan.Prefix(part)
        n = len(part)
        least = bytescan.mix(sums.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
        span = 1
        while 2 * span <= REACH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < REACH:
            least = np.minimum(least[: len(least) - (REACH - span)], least[REACH - span :])
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, c, c + n)))
        at = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 : LENGTH - 1 + len(least)])
        if not len(at):
            continue
        key, own = least[at], owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
        head = np.flatnonzero(since % REACH == 0)
        keys.append(key[head])
        firsts.append(at[head] + c)
        counts.append(np.diff(head, append=len(at)))
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket and key, [(bucket, first, last)])."""
    bucket = (key % U64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return order, [(int(bucket[order[i]]), int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:])]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _rows(slice_: str, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slice_] * len(found)), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["slice", "bucket", "packed"])


def _passed(name: str, buckets: int) -> tuple[int, bytes]:
    """An empty row for a slice, which takes it through all steps whatever they find in it."""
    return zlib.crc32(name.encode()) % buckets, b""


def _split(group: pa.Table) -> tuple[list[str], list[str], list[list[np.ndarray]]]:
    """(slices that pass, slices that have something packed, what they have)."""
    both = list(zip(group["slice"].to_pylist(), group["packed"].to_pylist()))
    return [n for n, x in both if not x], [n for n, x in both if x], [unpack(x) for _, x in both if x]


def _table(bucket: int, found: list[tuple[str, bytes]]) -> pa.Table:
    return pa.table({"slice": pa.array([n for n, _ in found], pa.string()), "bucket": pa.array([bucket] * len(found), pa.int32()), "packed": pa.array([x for _, x in found], pa.binary())})


class _Slice:
    """A slice's documents as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        ids, texts = batch.column(0), batch.column(1)
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        ((_, _, self.data, self.offsets),) = bytescan.text_slices(texts, 1 << 62)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first string, strings, row) for rows that have an id."""
        key, first, count = anchors(self.data, self.offsets)
        row = np.searchsorted(self.offsets, first, "right") - 1
        ok = self.known[row]
        return key[ok], first[ok], count[ok], row[ok]


def _distinct(key: np.ndarray, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, body and size; whether a piece in that order differs from the one before)."""
    order = np.lexsort((size, body, key))
    new = np.ones(len(order), bool)
    for k, values in enumerate((key, body, size)):
        v = values[order]
        new[1:] = (v[1:] != v[:-1]) if k == 0 else new[1:] | (v[1:] != v[:-1])
    return order, new


def _opened(folder: str):
    files, root = pafs.FileSystem.from_uri(folder)
    return files, root


def _read(folder: str, name: str) -> _Slice:
    files, root = _opened(folder)
    with files.open_input_file(f"{root}/{name}") as f, pa.ipc.open_file(f) as reader:
        return _Slice(reader.get_batch(0))


def _written(folder: str, name: str, write) -> None:
    """A file that appears whole, under its final name; a repeated task puts the same in its place."""
    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    attempt = f"{root}/{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(attempt) as f:
        write(f)
    files.move(attempt, f"{root}/{name}")


def _slicer(folder: str, buckets: int):
    """Write slices; give each slice's anchors by bucket, and a row for the slice itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string())], ["id", "text"])
            for i, j, _, _ in bytescan.text_slices(batch.column(1), SLICE):
                rows = batch.slice(i, j - i)
                name = f"{part:08d}-{number:08d}"
                number += 1

                def write(f, rows=rows) -> None:
                    with pa.ipc.new_file(f, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write(rows)

                _written(folder, name, write)
                docs = _Slice(rows)
                key, first, count, row = docs.pieces()
                size = count + (LENGTH - 1)
                order, new = _distinct(key, bytescan.Prefix(docs.data).of(first, first + size), size)
                key, owner = key[order], docs.ids[row[order]]
                head = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
                if len(head):
                    least, most, kinds = np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head), np.add.reduceat(new.astype(np.int32), head)
                else:
                    least, most, kinds = owner, owner, np.zeros(0, np.int32)
                key = key[head]
                order, parts = _dealt(key, buckets)
                key, least, most, kinds = (v[order] for v in (key, least, most, kinds))
                packed = ((b, pack(key[x:y], least[x:y], most[x:y], kinds[x:y])) for b, x, y in parts)
                yield _rows(name, [_passed(name, buckets), *packed])

    return run


def _judge(group: pa.Table) -> pa.Table:
    """For each slice of a bucket a flag per anchor: 0 one document's, 1 several documents', 2 hot."""
    bucket = group["bucket"][0].as_py()
    passed, names, blobs = _split(group)
    if not names:
        return _table(bucket, [(n, b"") for n in passed])
    key, least, most, kinds = (np.concatenate([b[k] for b in blobs]) for k in range(4))
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    flag = (np.minimum.reduceat(least[order], head) != np.maximum.reduceat(most[order], head)).astype(np.uint8)
    every = np.add.reduceat(kinds[order].astype(np.int64), head)
    flag[(flag > 0) & (every > max(HOT, HOT_SHARE * every.sum()))] = 2
    flags = np.empty(len(key), np.uint8)
    flags[order] = np.repeat(flag, np.diff(head, append=len(key)))
    cuts = np.cumsum([0, *(len(b[0]) for b in blobs)])
    keep = [k for k in range(len(names)) if flags[cuts[k] : cuts[k + 1]].any()]
    return _table(bucket, [*((n, b"") for n in passed), *((names[k], pack(flags[cuts[k] : cuts[k + 1]])) for k in keep)])


def _cutter(folder: str, buckets: int):
    """A slice's verdicts to its distinct pieces by bucket: keys, hashes, lengths, least and greatest doc_ids, bytes.

    Where they stand goes to a file of the slice: bucket, piece (counted within the bucket), row and place.
    """

    def cut(group: pa.Table) -> pa.Table:
        name = group["slice"][0].as_py()
        docs = _read(folder, name)
        key, first, count, row = docs.pieces()
        known, at = np.unique(key, return_inverse=True)
        order, parts = _dealt(known, buckets)
        flag = np.zeros(len(known), np.uint8)
        verdicts = {b: x for b, x in zip(group["bucket"].to_pylist(), group["packed"].to_pylist()) if x}
        for b, x, y in parts:
            if verdicts.get(b):
                (flag[order[x:y]],) = unpack(verdicts[b])
        flags = flag[at]
        sums = bytescan.Prefix(docs.data)
        warm, hot = np.flatnonzero(flags == 1), np.flatnonzero(flags == 2)
        single = _ragged(first[hot], count[hot])
        own = np.repeat(row[hot], count[hot])
        key = np.concatenate([key[warm], bytescan.mix(sums.of(single, single + LENGTH))])
        first, row = np.concatenate([first[warm], single]), np.concatenate([row[warm], own])
        size = np.concatenate([count[warm] + LENGTH - 1, np.full(len(single), LENGTH)])
        body = sums.of(first, first + size)
        order, parts = _dealt(key, buckets)
        out, places = [_passed(name, buckets)], []
        for b, x, y in parts:
            at = order[x:y]
            by, new = _distinct(key[at], body[at], size[at])
            at, head = at[by], np.flatnonzero(new)
            one, ids = at[new], docs.ids[row[at]]
            text = docs.data[_ragged(first[one], size[one])]
            least, most = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
            out.append((b, pack(key[one], body[one], size[one].astype(np.uint8), least, most, text)))
            places.append((np.full(len(at), b, np.int32), (np.cumsum(new) - 1).astype(np.int32), row[at].astype(np.int32), first[at].astype(np.int32)))
        columns = [np.concatenate(c) for c in zip(*places)] if places else [np.zeros(0, np.int32)] * 4
        _written(folder, f"{name}.places", lambda f: f.write(pack(*columns)))
        return pa.Table.from_batches([_rows(name, out)])

    return cut


class _External:
    """The transform and the common prefixes of a collection, each as two files in turn: one is read, the next written."""

    def __init__(self, folder: str, size: int) -> None:
        self.files = [[open(f"{folder}/{what}{k}", "w+b", buffering=0) for k in (0, 1)] for what in ("transform", "prefix")]
        self.round, self.size = 0, size
        self.write(np.zeros(size, np.uint8), np.zeros(size, np.uint8))

    def write(self, transform: np.ndarray, prefix: np.ndarray) -> None:
        self.round += 1
        self.size = len(transform)
        for pair, values in zip(self.files, (transform, prefix)):
            pair[self.round % 2].seek(0)
            view = memoryview(values)
            while len(view):
                view = view[pair[self.round % 2].write(view) :]

    def read(self) -> list[np.ndarray]:
        out = []
        for pair in self.files:
            values = np.empty(self.size, np.uint8)
            pair[self.round % 2].seek(0)
            view = memoryview(values)
            while len(view):
                view = view[pair[self.round % 2].readinto(view) :]
            out.append(values)
        return out

    def close(self) -> None:
        for pair in self.files:
            for f in pair:
                f.close()


def _least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. to]) of each pair; pairs go in falling order, so none overlaps the next."""
    order = np.argsort(-after)
    pairs = np.empty(2 * len(after), np.int64)
    pairs[0::2], pairs[1::2] = after[order] + 1, to[order] + 1
    out = np.empty(len(after), np.uint8)
    out[order] = np.minimum.reduceat(np.append(values, np.uint8(0)), pairs)[0::2]
    return out


def build(text: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, strings before it in its piece, common prefix with the one before) for all
    suffixes in sorted order; piece is -1 for those shorter than LENGTH.

    Round t puts in the suffixes of t symbols. Each is an older suffix with one symbol in
    front, so its place follows from how often that symbol stands in the transform before
    the older one's place.
    """
    m, width = len(size), int(size.max())
    right = np.zeros((m, width), np.uint8)  # symbols from 1 on, pieces end at the right edge
    ends = np.cumsum(size)
    right[np.repeat(np.arange(m), size), width - np.repeat(ends, size) + np.arange(len(text))] = text + np.uint8(1)
    files = _External(folder, m)
    piece = np.full(m, -1, np.int32)
    before = np.zeros(m, np.uint8)
    at, who = np.arange(m), np.arange(m)  # places of the newest suffix of each piece, in order
    for t in range(1, width + 1):
        transform, prefix = files.read()
        going = size[who] >= t
        at, who = at[going], who[going]
        transform[at] = right[who, width - t]
        fresh = np.zeros(len(transform), bool)
        fresh[at] = True
        source = np.argsort(transform, kind="stable")
        source = source[len(source) - np.count_nonzero(transform) :]
        new = fresh[source]
        place = np.flatnonzero(new)
        total = m + len(source)
        old = np.ones(total, bool)
        old[m + place] = False
        who = who[np.searchsorted(at, source[place])]  # in the new order
        grown, common = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
        grown[old] = transform
        common[old] = prefix
        new = np.concatenate([new[:1], new[1:] | new[:-1]])
        touched = np.flatnonzero(new)  # new ones and those behind them
        symbol = transform[source[touched]]
        with_one = (touched > 0) & (transform[source[np.maximum(touched - 1, 0)]] == symbol)
        common[m + touched] = 0
        live = touched[with_one]
        if len(live):
            common[m + live] = _least_between(prefix, source[live - 1], source[live]) + np.uint8(1)
        at = m + place
        grown[at] = 0
        if t >= LENGTH:
            if len(piece) != len(transform):
                piece, before = np.full(len(transform), -1, np.int32), np.zeros(len(transform), np.uint8)
            next_piece, next_before = np.full(total, -1, np.int32), np.zeros(total, np.uint8)
            next_piece[old], next_before[old] = piece, before
            next_piece[at], next_before[at] = who, (size[who] - t).astype(np.uint8)
            piece, before = next_piece, next_before
        files.write(grown, common)
    prefix = files.read()[1]
    files.close()
    return piece, before, prefix


def owners(text: np.ndarray, size: np.ndarray, doc: np.ndarray, folder: str) -> np.ndarray:
    """For all strings of all pieces, piece by piece, the smallest doc_id that has the string."""
    strings = size - (LENGTH - 1)
    first = np.cumsum(strings) - strings
    piece, before, common = build(text, size, folder)
    head = np.flatnonzero(common < LENGTH)
    held = np.where(piece >= 0, doc[piece], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(held, head), np.diff(head, append=len(piece)))
    out = np.empty(int(strings.sum()), np.int64)
    real = piece >= 0
    out[first[piece[real]] + before[real]] = least[real]
    return out


def _settled(key: np.ndarray, size: np.ndarray, text: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For all strings of distinct pieces, sorted by key, the smallest doc_id that has the string."""
    strings = size - (LENGTH - 1)
    owner = np.repeat(least, strings)
    same = key[1:] == key[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some = np.flatnonzero(several)
    if not len(some):
        return owner
    text = text[_ragged((np.cumsum(size) - size)[some], size[some])]
    key, size, least = key[some], size[some], least[some]
    begin = np.concatenate([[0], np.cumsum(size)])
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # collections end between two keys
    found, i = [], 0
    with tempfile.TemporaryDirectory() as folder:
        while i < len(key):
            full = int(np.searchsorted(begin, begin[i] + COLLECTION, "right")) - 1
            j = int(ends[max(np.searchsorted(ends, full, "right") - 1, np.searchsorted(ends, i, "right"))])
            found.append(owners(text[begin[i] : begin[j]], size[i:j], least[i:j], folder))
            i = j
    owner[np.repeat(several, strings)] = np.concatenate(found)
    return owner


def _builder(group: pa.Table) -> pa.Table:
    """A bucket's pieces to what each slice loses: (piece, runs) and (strings, owner) of the runs."""
    bucket = group["bucket"][0].as_py()
    passed, names, blobs = _split(group)
    if not names:
        return _table(bucket, [(n, b"") for n in passed])
    key, body, size, least, most, text = (np.concatenate([b[k] for b in blobs]) for k in range(6))
    size = size.astype(np.int64)
    # equal pieces of several slices are one, held by their smallest doc_id
    order, new = _distinct(key, body, size)
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(new) - 1
    one = order[new]
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))
    text = text[_ragged((np.cumsum(size) - size)[one], size[one])]
    owner = _settled(key[one], size[one], text, first)
    strings = size[one] - (LENGTH - 1)
    begin = np.cumsum(strings) - strings
    # runs of strings of one piece that have one owner
    head = np.ones(len(owner), bool)
    head[1:] = owner[1:] != owner[:-1]
    head[begin] = True
    head = np.flatnonzero(head)
    length, owner = np.diff(head, append=int(strings.sum())).astype(np.uint8), owner[head]
    runs = np.diff(np.searchsorted(head, np.append(begin, int(strings.sum()))))
    at = np.cumsum(runs) - runs
    lost = np.minimum.reduceat(owner, at)[class_of] < most  # else no document of the slice loses any
    cuts = np.cumsum([0, *(len(b[0]) for b in blobs)])
    found = []
    for k, name in enumerate(names):
        piece = np.flatnonzero(lost[cuts[k] : cuts[k + 1]])
        if len(piece):
            c = class_of[cuts[k] + piece]
            r = _ragged(at[c], runs[c])
            found.append((name, pack(piece.astype(np.int32), runs[c].astype(np.uint8), length[r], owner[r])))
    return _table(bucket, [*((n, b"") for n in passed), *found])


def _repeats(docs: _Slice, places: list[np.ndarray], found: list[tuple[int, list[np.ndarray]]]) -> np.ndarray:
    """Whether each byte of a slice starts a string that a smaller doc_id has."""
    starts = np.zeros(len(docs.data) + 1, bool)
    bucket, piece, row, first = places
    for b, (losing, runs, length, owner) in found:
        x, y = np.searchsorted(bucket, (b, b + 1))
        at = np.searchsorted(losing, piece[x:y])
        at[at == len(losing)] = 0
        hit = np.flatnonzero(losing[at] == piece[x:y])
        at, hit = at[hit], hit + x
        n = runs.astype(np.int64)
        r = _ragged((np.cumsum(n) - n)[at], n[at])  # the runs of each place's piece
        width = length[r].astype(np.int64)
        strings = np.add.reduceat(width, np.cumsum(n[at]) - n[at])
        repeat = np.repeat(owner[r], width) < np.repeat(docs.ids[row[hit]], strings)
        starts[_ragged(first[hit].astype(np.int64), strings)[repeat]] = True
    return starts[:-1]


def _remover(folder: str, with_text: bool):
    """A slice's owners to its documents' results."""

    def remove(group: pa.Table) -> pa.Table:
        name = group["slice"][0].as_py()
        docs = _read(folder, name)
        files, root = _opened(folder)
        with files.open_input_stream(f"{root}/{name}.places") as f:
            places = unpack(f.read())
        found = [(b, unpack(x)) for b, x in zip(group["bucket"].to_pylist(), group["packed"].to_pylist()) if x]
        so_far = np.concatenate([np.zeros(LENGTH, np.int32), np.cumsum(_repeats(docs, places, found), dtype=np.int32)])
        gone = so_far[LENGTH:] > so_far[:-LENGTH]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = docs.offsets[:-1][np.diff(docs.offsets) > 0]
        begins[inner] = gone[inner]
        counts = [np.concatenate([[0], np.cumsum(x)])[docs.offsets] for x in (gone, begins)]
        kept = [docs.data[a:b][~gone[a:b]].tobytes() for a, b in zip(docs.offsets[:-1], docs.offsets[1:])]
        out = {
            "id": pa.array([x if k else None for x, k in zip(docs.ids.tolist(), docs.known.tolist())], pa.int64()),
            "n_bytes": pa.array(np.diff(docs.offsets)),
            "n_removed": pa.array(np.diff(counts[0])),
            "n_spans": pa.array(np.diff(counts[1])),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return remove


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), and with_text the kept bytes, per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    folder = shared_dir(spark, "slices")
    sliced = docs.mapInArrow(releasing(_slicer(folder, buckets)), PACKED)
    verdicts = sliced.groupBy("bucket").applyInArrow(_judge, PACKED)
    pieces = verdicts.groupBy("slice").applyInArrow(_cutter(folder, buckets), PACKED)
    spans = pieces.groupBy("bucket").applyInArrow(_builder, PACKED)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return spans.groupBy("slice").applyInArrow(_remover(folder, with_text), schema)


def op5_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - {LENGTH - 1} AS BIGINT))) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS o FROM w),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m WHERE o < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
q AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM s),
k AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
      FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
