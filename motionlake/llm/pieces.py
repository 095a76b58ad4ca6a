"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut where a space follows another character, since no piece of the
vocabulary holds a space behind another character; what two places share is encoded once.
The distinct parts that recent batches did not hold are put end to end and indexed by a suffix array. Every piece of the
vocabulary is searched in it by halving, which gives the range of its occurrences. The
occurrences are edges over the text; sorted by position they are relaxed from left to
right. The vocabulary is of the byte-pair kind, whose encodings are marked by one rule:
any two neighbouring pieces are what merging their joined text gives. An edge is taken if
it obeys that rule with the edge that reached its start, and exactly one does so at each
place, so the path is the encoding that the merges would give.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes and drops
the blank that encoding puts in front of each text.

Defined results for odd input: null and empty texts have no pieces and decode to an empty
text; the mark that stands for a space, where a text holds it, decodes to a space;
columns of the caller stay, other than those named like the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import releasing, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are encoded at a time, bytes of new parts that are indexed at a time,
#: texts that are decoded at a time, slots for judged pairs of pieces in a worker, and parts
#: whose encoding it keeps for the next batches.
BATCH = 1 << 20
INDEXED = 1 << 17
ROWS = 256
PAIRS = 1 << 20
PARTS = 1 << 17
MARK = "▁"
_MARK = MARK.encode()
_STOP = b"\xff"  # in no UTF-8 text, so no piece reaches over it
_MODELS: dict[bytes, Vocabulary] = {}


class Vocabulary:
    """Pieces, their merge order, and the pairs that a worker has judged so far."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.byte = np.full(256, self.unknown)
        self.bytes_of: list[bytes] = []
        self.rank: dict[str, float] = {}
        ids, keys = [], []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.rank[piece] = -sp.get_score(i)
                ids.append(i)
                keys.append(piece.encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} holds a space behind another character")
        self.ids, self.keys = np.array(ids, np.int32), keys
        self.width = np.array([len(k) for k in keys])
        self.columns = self._packed()
        self.text_of = {i: k.decode() for i, k in zip(ids, keys)}
        self.is_text = np.isin(np.arange(size), self.ids)
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.forget()
        self.forget_parts()

    def _packed(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per 8 bytes of a piece the lowest and the highest number that it can begin."""
        out = []
        for c in range(0, int(self.width.max()), 8):
            low = np.array([int.from_bytes(k[c : c + 8].ljust(8, b"\0"), "big") for k in self.keys], np.uint64)
            high = np.array([int.from_bytes(k[c : c + 8].ljust(8, b"\xff"), "big") for k in self.keys], np.uint64)
            out.append((low, high))
        return out

    def forget(self) -> None:
        """An empty table of judged pairs: open addressing, a slot for each pair."""
        self.pair = np.full(PAIRS, -1, np.int64)
        self.pair_joins = np.zeros(PAIRS, bool)
        self.judged = 0

    def forget_parts(self) -> None:
        """No parts of earlier batches, their piece ids and how many each has."""
        self.parts = pa.array([], pa.large_binary())
        self.part_ids, self.part_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of pieces a and b gives these two again."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero(self.is_text[a] & self.is_text[b])
        pair = a[both].astype(np.int64) * len(self.lengths) + b[both]
        slot = self._slots(pair)
        new = self.pair[slot] != pair
        if new.any():
            fresh = np.unique(pair[new])
            if self.judged + len(fresh) > PAIRS // 2:
                self.forget()
                fresh = np.unique(pair)
            found = np.empty(len(fresh), bool)
            for k, p in enumerate(fresh.tolist()):
                x, y = (self.text_of[i] for i in divmod(p, len(self.lengths)))
                found[k] = merged(x + y, self.rank) == [x, y]
            self.judged += len(fresh)
            while len(fresh):  # of pairs that want one slot the first gets it
                at, first = np.unique(self._slots(fresh), return_index=True)
                self.pair[at], self.pair_joins[at] = fresh[first], found[first]
                rest = np.ones(len(fresh), bool)
                rest[first] = False
                fresh, found = fresh[rest], found[rest]
            slot = self._slots(pair)
        out[both] = self.pair_joins[slot]
        return out

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        """The slot that holds each pair, or the free one where it belongs."""
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)  # the top bits, as many as PAIRS needs
        while len(off := np.flatnonzero((self.pair[slot] != pair) & (self.pair[slot] >= 0))):
            slot[off] = (slot[off] + 1) % PAIRS
        return slot


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """Byte-pair merging of a short text: the best pair first, the leftmost of equals."""
    parts, never = list(text), float("inf")
    ranks = [rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) != never:
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        for i in range(max(at - 1, 0), min(at + 1, len(ranks))):
            ranks[i] = rank.get(parts[i] + parts[i + 1], never)
    return parts


def suffixes(data: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array in the order of the first `reach` bytes, 8-byte numbers of all places).

    Nothing behind a stop counts. Suffixes that are alike so far and have met no stop are
    sorted on by their next 8 bytes.
    """
    n = len(data)
    wide = np.concatenate([data, np.full(8, _STOP[0], np.uint8)])
    key = np.lib.stride_tricks.as_strided(wide, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    stops = np.flatnonzero(data == _STOP[0])
    left = np.repeat(stops, np.diff(stops, prepend=-1))[:n] - np.arange(n)  # bytes before the next stop
    over = left < 8
    key[over] &= ~((np.uint64(1) << (np.uint64(56) - np.uint64(8) * left[over].astype(np.uint64))) - np.uint64(1))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = (sorted_[1:] == sorted_[:-1]) & ~over[order[1:]]
    for seen in range(8, reach, 8):
        live = np.flatnonzero(same[:n] | same[1:])
        if not len(live):
            break
        group = np.cumsum(~same[live])
        following = np.minimum(order[live] + seen, n - 1)
        again = np.lexsort((key[following], group))
        order[live] = order[live][again]
        following = following[again]
        now = key[following]
        same = np.zeros(n + 1, bool)
        same[live[1:]] = (group[1:] == group[:-1]) & (now[1:] == now[:-1]) & ~over[following[1:]]
    return order, key


def occurrences(vocabulary: Vocabulary, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) in the suffix array of each piece's range, by halving 8 bytes at a time."""
    n, pieces = len(order), len(vocabulary.keys)
    first, last = np.zeros(pieces, np.int64), np.full(pieces, n, np.int64)
    padded = np.concatenate([key, np.zeros(int(vocabulary.width.max()) + 8, np.uint64)])
    for c, (low, high) in enumerate(vocabulary.columns):
        live = np.flatnonzero((vocabulary.width > 8 * c) & (first < last))
        ends = []
        for goal, side in ((low[live], False), (high[live], True)):
            a, b = first[live].copy(), last[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                got = padded[order[np.minimum(mid, n - 1)] + 8 * c]
                under = (got <= goal) if side else (got < goal)
                a, b = np.where(open_ & under, mid + 1, a), np.where(open_ & ~under, mid, b)
            ends.append(a)
        first[live], last[live] = ends
    return first, last


def edges(vocabulary: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all occurrences of pieces; bytes of characters without a piece are edges too."""
    order, key = suffixes(data, int(vocabulary.width.max()))
    first, last = occurrences(vocabulary, order, key)
    count = last - first
    owner = np.repeat(np.arange(len(count)), count)
    start = order[_ragged(first, count)]
    size = vocabulary.width[owner]
    heads = np.flatnonzero(((data & 0xC0) != 0x80) & (data != _STOP[0]))
    length = np.where(data[heads] < 0x80, 1, np.where(data[heads] < 0xE0, 2, np.where(data[heads] < 0xF0, 3, 4)))
    char = np.zeros(len(data), np.int64)
    char[heads] = length
    has = np.zeros(len(data), bool)
    has[start[size == char[start]]] = True
    lone = ~has[heads]
    bare = _ragged(heads[lone], length[lone])
    return np.concatenate([start, bare]), np.concatenate([start + size, bare + 1]), np.concatenate([vocabulary.ids[owner], vocabulary.byte[data[bare]]])


def relaxed(vocabulary: Vocabulary, found: tuple[np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece that reaches each place, its start), all parts side by side, from left to right.

    A place that nothing reaches has -1, the begin of a part -2.
    """
    start, end, piece = found
    came, back = np.full(size + 1, -1, np.int64), np.zeros(size + 1, np.int64)
    came[begins] = -2
    offset = end - np.repeat(begins, np.diff(begins, append=size))[start]
    if len(offset) and offset.max() < 1 << 16:
        offset = offset.astype(np.uint16)  # sorted by digits
    sort = np.argsort(offset, kind="stable")
    start, end, piece = start[sort], end[sort], piece[sort]
    cuts = np.flatnonzero(np.diff(offset[sort].astype(np.int64), prepend=-1, append=-1))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        a, b, t = start[i:j], end[i:j], piece[i:j]
        before = came[a]
        ok = before != -1
        check = np.flatnonzero(before >= 0)
        ok[check] = vocabulary.joins(before[check], t[check])
        came[b[ok]], back[b[ok]] = t[ok], a[ok]
    return came, back


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets into them) of a large binary column without nulls, as views of its buffers."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _encode_parts(vocabulary: Vocabulary, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all parts, how many each part has)."""
    kind = pa.large_binary()
    data, ends = _bytes_of(pc.binary_join_element_wise(parts, pa.scalar(_STOP, kind), pa.scalar(b"", kind)))
    begins, stops = ends[:-1], ends[1:]
    came, back = relaxed(vocabulary, edges(vocabulary, data), begins, len(data))
    at, part, taken = stops - 1, np.arange(len(parts)), []
    while len(at):
        taken.append((part, came[at]))
        at = back[at]
        going = at > begins[part]
        at, part = at[going], part[going]
    count = np.zeros(len(parts), np.int64)
    for part, _ in taken:
        count[part] += 1
    last = np.cumsum(count)
    ids = np.zeros(int(last[-1]), np.int32)
    for k, (part, came_by) in enumerate(taken):
        ids[last[part] - 1 - k] = came_by
    return ids, count


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs (start, length), one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts, first part of each text and the total); each text gets its leading blank."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), " ", MARK)
    blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(MARK, pa.large_string()))
    data, offsets = _bytes_of(pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())).cast(pa.large_binary()))
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        begin[: n - 2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        begin[3:] &= ~begin[:-3].copy()
    begin[offsets] = True
    begin[n] = False
    starts = np.flatnonzero(begin)
    cuts = np.append(starts, n).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return parts, np.searchsorted(starts, offsets)


def _learn(vocabulary: Vocabulary, every: pa.Array) -> np.ndarray:
    """The place of each part among the vocabulary's known parts; new ones are indexed and encoded."""
    if len(vocabulary.parts) > PARTS:
        vocabulary.forget_parts()
    at = pc.index_in(every, value_set=vocabulary.parts)
    new = every.filter(at.is_null())
    ends = _bytes_of(new)[1] if len(new) else np.zeros(1, np.int64)
    ids, sizes, i = [vocabulary.part_ids], [vocabulary.part_sizes], 0
    while i < len(new):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + INDEXED, "right")) - 1)
        found, count = _encode_parts(vocabulary, new.slice(i, j - i))
        ids.append(found)
        sizes.append(count)
        i = j
    out = at.fill_null(0).to_numpy().astype(np.int64)
    out[np.asarray(at.is_null())] = len(vocabulary.parts) + np.arange(len(new))
    vocabulary.parts = pa.concat_arrays([vocabulary.parts, new])
    vocabulary.part_ids, vocabulary.part_sizes = np.concatenate(ids), np.concatenate(sizes)
    return out


def encode_texts(texts: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """A list of piece ids for each text."""
    parts, first = _parts(texts)
    coded = parts.dictionary_encode()
    place = _learn(vocabulary, coded.dictionary)[coded.indices.to_numpy()] if len(parts) else np.zeros(0, np.int64)
    del parts, coded
    size = vocabulary.part_sizes[place]
    start = (np.cumsum(vocabulary.part_sizes) - vocabulary.part_sizes)[place]
    ends = np.concatenate([[0], np.cumsum(size)])[first]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(vocabulary.part_ids[_ragged(start, size)]))


def decode_ids(ids: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The text of each list of piece ids."""
    flat = ids.flatten().to_numpy()
    lengths = vocabulary.lengths[flat]
    data = vocabulary.flat[_ragged(vocabulary.starts[flat], lengths)]
    counts = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    raw = data.tobytes()
    return pa.array([raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())


def _vocabulary(model: bytes) -> Vocabulary:
    if model not in _MODELS:
        _MODELS[model] = Vocabulary(model)
    return _MODELS[model]


def _encoder(model: bytes, text_at: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            for i, j, _, _ in bytescan.text_slices(batch.column(text_at), BATCH):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, encode_texts(part.column(text_at), vocabulary)], [*batch.schema.names, "pieces"])

    return encode


def _checker(model: bytes, text_at: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            for i, j, _, _ in bytescan.text_slices(batch.column(text_at), BATCH):
                part = batch.slice(i, j - i)
                texts = part.column(text_at)
                ids = encode_texts(texts, vocabulary)
                same = pc.equal(decode_ids(ids, vocabulary), pc.replace_substring(texts.fill_null(""), MARK, " "))
                rest = [(c, n) for k, (c, n) in enumerate(zip(part.columns, batch.schema.names)) if k != text_at]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), ids, same], [*(n for _, n in rest), "pieces", "round_trip"])

    return check


def _decoder(model: bytes, at: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_ids(part.column(at), vocabulary)], [*batch.schema.names, "decoded"])

    return decode


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} {kind}"


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """df with `pieces`, the piece ids of the text."""
    small_batches(df.sparkSession)
    df = df.drop("pieces")
    return df.mapInArrow(releasing(_encoder(model_bytes(model), df.columns.index(text))), _with(df, "pieces", "array<int>"))


def coded(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """df without the text, with `pieces` and whether decoding these gives the text again (`round_trip`)."""
    small_batches(df.sparkSession)
    df = df.drop("pieces", "round_trip")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(text).schema.fields)
    return df.mapInArrow(releasing(_checker(model_bytes(model), df.columns.index(text))), f"{kept}{', ' if kept else ''}pieces array<int>, round_trip boolean")


def decoded(df: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """df with `decoded`, the text of the piece ids."""
    df = df.drop("decoded")
    return df.mapInArrow(releasing(_decoder(model_bytes(model), df.columns.index(pieces))), _with(df, "decoded", "string"))


def op7_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decoded(encoded(docs))
    return out.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_xxhash64"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("round_trip"),
    )
