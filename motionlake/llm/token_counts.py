"""Token counts: the tokenizer compiled into a deterministic transducer, chunks composed by their state maps.

The vocabulary is of the byte-pair kind. An encoding is marked by one rule: any two
neighbouring pieces are what merging their joined text gives. So at each place of a text
exactly one piece ends that belongs to the encoding of the text up to there, and which one
depends on the places in front of it alone. Only places from which a longer piece can
still start matter for what follows; they are at most as far back as the longest piece is
long. What such a place is followed by, the piece that ends there and by how many tokens it
differs from the oldest of them is a state. There are finitely many, a character moves from
one to the next, and each move settles a number of tokens. Of a state, the characters since
the oldest place are compiled: their moves, with the pieces that may end there, are made when
a text first needs them and kept, up to a number, by a worker. Pieces and tokens of the
places are its registers, which a move only compares and adds to. Whether two pieces may be
neighbours is told by going through the merges that make them in their common order.

A text is cut into chunks. A chunk's map says for each state in which it may be entered how
many tokens it settles and in which state it is left. The maps of neighbours compose to one
of the same kind, which is associative: they are composed by FAN neighbours at a time,
level by level, until one is left for each text. The states in which a chunk can be entered
come from the characters in front of it: two of them that no piece holds side by side allow
only one, since no piece reaches over; else every place there within a piece's length is
tried as the start of a piece. A text whose maps don't fit together is counted in one chunk.

Characters without a piece become as many byte pieces as they have bytes.

Defined results for odd input: null and empty texts have no tokens; the mark that stands
for a space counts as one; names of special tokens within texts are ordinary text; rows
that repeat a key are counted each by its own text; empty tables give no rows; columns of
the caller stay, other than one named n_tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_column, releasing, scratch, small_batches, stored, table
from .pieces import MARK, MODEL, model_bytes

LIMIT = 4096
#: Characters of a chunk, of what is looked at in front of it, and neighbours composed at a time.
CHUNK = 1 << 16
CONTEXT = 256
FAN = 64
#: Compiled tails, judged pairs of pieces and parts between spaces that a worker keeps.
STATES = 1 << 17
PAIRS = 1 << 18
PARTS = 1 << 19
#: Characters of the longest part that is kept, so that texts without spaces take no memory.
PART = 64
MAP = "array<struct<entry:string, leave:string, settled:long, open:long>>"
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MACHINES: dict[bytes, Transducer] = {}


def _bytes(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


class State(NamedTuple):
    """Where a text stands.

    `live` are the places from which a piece can still start: (characters since, piece that
    ends there or nothing, tokens up to there less those of the first), the oldest first.
    `tail` are the characters since the oldest.
    """

    tail: str
    live: tuple[tuple[int, str, int], ...]

    @property
    def open(self) -> int:
        """Tokens of the text so far that no move has settled."""
        return self.live[-1][2]

    def name(self) -> str:
        """The same for the same state in every worker."""
        return json.dumps([self.tail, self.live])


class Tail(dict):
    """The compiled moves of all states with this tail: by character (next tail, pieces that may end with it as (length, text, piece), the longest first)."""

    __slots__ = ("machine", "text")

    def __init__(self, machine: Transducer, text: str) -> None:
        super().__init__()
        self.machine, self.text = machine, text

    def __missing__(self, char: str) -> tuple[Tail, tuple[tuple[int, str, Piece], ...]]:
        move = self.machine.move(self.text, char)
        self[char] = move
        return move


class Piece(dict):
    """A piece, or nothing; by the text of another piece, whether that may follow."""

    __slots__ = ("machine", "text")

    def __init__(self, machine: Transducer, text: str) -> None:
        super().__init__()
        self.machine, self.text = machine, text

    def __missing__(self, after: str) -> bool:
        self.machine.judge()
        found = self[after] = self.machine.joins(self.text, after)
        return found


class Parts(dict):
    """The tokens of parts that are encoded on their own."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, part: str) -> int:
        found = self.machine.whole(part)
        if len(part) <= PART:
            if len(self) >= PARTS:
                self.clear()
            self[part] = found
        return found


class Transducer:
    """The states of one vocabulary, compiled as they are met."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ordinary = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ordinary}
        self.heads = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.beside = {p[n : n + 2] for p in self.rank for n in range(len(p) - 1)}  # neighbouring characters within pieces
        self.longest = max(map(len, self.rank), default=1)
        self.spaced = any(MARK in p.lstrip(MARK) for p in self.rank)  # then a space says nothing about what is before it
        self.merges: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pieces = {p: Piece(self, p) for p in ("", *self.rank)}
        self.judged = 0
        self.tails: dict[str, Tail] = {}
        self.parts = Parts(self)

    def tail(self, text: str) -> Tail:
        found = self.tails.get(text)
        if found is None:
            if len(self.tails) >= STATES:
                for t in self.tails.values():
                    t.clear()
                self.tails.clear()
            found = self.tails[text] = Tail(self, text)
        return found

    def start(self) -> State:
        return State("", ((0, "", 0),))

    def made(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters: (rank, first part, last part) after each; None if they don't."""
        if piece not in self.merges:
            parts, never, found = list(piece), float("inf"), []
            while found is not None and len(parts) > 1:
                ranks = [self.rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found = None if best == never else [*found, (best, parts[0], parts[-1])]
            self.merges[piece] = found
        return self.merges[piece]

    def joins(self, a: str, b: str) -> bool:
        """Whether merging the joined text of a and b gives these two; nothing in front of b asks the same of b alone.

        The merges of both come in their common order, the best first and the leftmost of
        equals; one over the border may never be before the next of them.
        """
        left, right = self.made(a), self.made(b)
        if left is None or right is None:
            return False
        if not a or a[-1] + b[0] not in self.beside:
            return True
        never, i, j, end, begin = float("inf"), 0, 0, a[-1], b[0]
        while True:
            x = left[i][0] if i < len(left) else never
            y = right[j][0] if j < len(right) else never
            over = self.rank.get(end + begin, never)
            if over < x and over <= y:
                return False
            if x == y == never:
                return True
            if x <= y:
                end = left[i][2]
                i += 1
            else:
                begin = right[j][1]
                j += 1

    def judge(self) -> None:
        """Counts pairs that are judged; when there are many, they go."""
        if self.judged >= PAIRS:
            self.judged = 0
            for p in self.pieces.values():
                p.clear()
        self.judged += 1

    def move(self, tail: str, char: str) -> tuple[Tail, tuple[tuple[int, str, Piece], ...]]:
        text, n = tail + char, len(tail) + 1
        may = [text[at:] for at in range(n) if (at == n - 1 or text[at:-1] in self.heads) and text[at:] in self.rank]
        head = next((at for at in range(n) if text[at:] in self.heads), n)
        return self.tail(text[head:]), tuple((len(p), p, self.pieces[p]) for p in may)

    def walk(self, tail: Tail, ends: list[Piece], text: str) -> Tail:
        """The tail after the text; appends the piece that ends at each place, nothing behind a character without one."""
        at = len(ends)
        for char in text:
            tail, may = tail[char]
            for n, own, piece in may:
                if ends[at - n][own]:
                    ends.append(piece)
                    break
            else:
                if char in self.rank:
                    raise ValueError(f"no piece that ends at {tail.text!r} can follow")
                ends.append(self.pieces[""])  # bytes, and no piece reaches over them
            at += 1
        return tail

    def whole(self, text: str) -> int:
        """Tokens of a text on its own."""
        ends = [self.pieces[""]]
        self.walk(self.tail(""), ends, text)
        at, found = len(text), 0
        while at:
            n = len(ends[at].text)
            found += 1 if n else _bytes(text[at - 1])
            at -= n or 1
        return found

    def entries(self, context: str) -> list[State]:
        """The states in which a text that ends with `context` can stand."""
        for at in range(len(context) - 1, 0, -1):
            if context[at - 1 : at + 1] not in self.beside:
                return [self.run(self.start(), context[at:])[0]]
        found = [self.run(self.start(), context[at:])[0] for at in range(min(self.longest, len(context)))]
        return list({s.name(): s for s in found}.values())

    def run(self, s: State, text: str) -> tuple[State, int]:
        """(state, tokens settled) after the text, character by character."""
        size = len(s.tail)
        ends, tokens = [self.pieces[""]] * (size + 1), [0] * (size + 1)
        for n, piece, before in s.live:
            ends[size - n], tokens[size - n] = self.pieces[piece], before
        tail = self.walk(self.tail(s.tail), ends, text).text
        for at, char in enumerate(text, size + 1):
            n = len(ends[at].text)
            tokens.append(tokens[at - n] + 1 if n else tokens[at - 1] + _bytes(char))
        live = []
        for n in range(len(tail), -1, -1):
            since, piece = tail[len(tail) - n :], ends[-1 - n].text
            if n and since not in self.heads:
                continue
            if n and piece and piece[-1] + since[0] not in self.beside:
                piece = ""  # what no piece reaches over does not matter to what starts there
            live.append((n, piece, tokens[-1 - n]))
        zero = live[0][2]
        return State(tail, tuple((n, piece, t - zero) for n, piece, t in live)), zero

    def read(self, s: State, text: str) -> tuple[State, int]:
        """The same; what lies between two spaces is one move, kept for when it comes again.

        A space behind another character leaves nothing open, so each such part settles a
        number of its own.
        """
        parts = [text] if self.spaced else _PARTS.findall(text)
        if len(parts) < 2:
            return self.run(s, text)
        s, settled = self.run(s, parts[0])
        settled += s.open + sum(map(self.parts.__getitem__, parts[1:-1]))
        s, n = self.run(self.start(), parts[-1])
        return s, settled + n

    def mapped(self, context: str | None, text: str) -> list[tuple[str, str, int, int]]:
        """The map of a chunk: (entry, leave, settled, open) for each state in which it may be entered."""
        text = text.replace(" ", MARK)
        if context is None:
            entries, text = [self.start()], MARK + text if text else text
        else:
            entries = self.entries(context.replace(" ", MARK))
        out = []
        for entry in entries:
            name = entry.name()
            leave, settled = self.read(entry, text)
            out.append((name, leave.name(), settled, leave.open))
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        s, settled = self.read(self.start(), MARK + text.replace(" ", MARK))
        return settled + s.open


def _machine(model: bytes) -> Transducer:
    if model not in _MACHINES:
        _MACHINES[model] = Transducer(model)
    return _MACHINES[model]


def _counter(model: bytes, keep: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            found = pa.array([machine.count(t.as_py()) for t in batch.column(keep)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], found], [*batch.schema.names[:keep], "n_tokens"])

    return count


def _mapper(model: bytes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        kind = pa.list_(pa.struct([("entry", pa.string()), ("leave", pa.string()), ("settled", pa.int64()), ("open", pa.int64())]))
        for batch in batches:
            texts, places, contexts, chunks = batch.columns
            maps = [machine.mapped(a.as_py(), b.as_py()) for a, b in zip(contexts, chunks)]
            maps = pa.array([[dict(zip(("entry", "leave", "settled", "open"), m)) for m in ms] for ms in maps], kind)
            yield pa.RecordBatch.from_arrays([texts, places, maps], ["text_id", "chunk", "map"])

    return work


def chunk_maps(texts: DataFrame, model: bytes, chunk: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """(text_id, chunk, map) from (text_id, text); chunks are dealt out evenly, however long one text is."""
    parts = texts.select("text_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("parts"))
    before = F.when(F.col("chunk") > 0, F.right(F.get("parts", F.col("chunk") - 1), F.lit(context)))
    each = parts.select("text_id", "parts", F.posexplode("parts").alias("chunk", "body")).select("text_id", "chunk", before.alias("context"), "body")
    maps = each.repartition("text_id", "chunk").mapInArrow(releasing(_mapper(model)), f"text_id string, chunk int, map {MAP}")
    return maps.groupBy("text_id", "chunk").agg(F.first("map").alias("map"))


def followed(before: Column, after: Column) -> Column:
    """One entry of a map, and then the map of the next chunk; without a fitting entry all but its own is null."""
    hit = F.get(F.filter(after, lambda x: x["entry"] == before["leave"]), F.lit(0))
    return F.struct(
        before["entry"].alias("entry"), hit["leave"].alias("leave"),
        (before["settled"] + hit["settled"]).alias("settled"), hit["open"].alias("open"),
    )


def composed(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(text_id, map) of whole texts: neighbours are composed, then what they gave, until one is left."""
    most = maps.agg(F.max("chunk")).first()[0] or 0
    while most > 0:
        near = maps.groupBy("text_id", F.call_function("div", F.col("chunk"), F.lit(fan)).cast("int").alias("chunk"))
        near = near.agg(F.array_sort(F.collect_list(F.struct("chunk", "map"))).alias("parts"))
        rest = F.slice("parts", F.lit(2), F.size("parts"))
        one = F.transform(F.col("parts")[0]["map"], lambda e: F.aggregate(rest, e, lambda acc, p: followed(acc, p["map"])))
        maps, most = near.select("text_id", "chunk", one.alias("map")), most // fan
    return maps.select("text_id", "map")


def counted(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The columns `keep` (all that df has) with n_tokens, the number of pieces of the text."""
    spark, code = df.sparkSession, model_bytes(model)
    small_batches(spark)
    df = df.drop("n_tokens")
    keep = df.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    own = lambda rows: rows.select(*keep, F.coalesce(text, F.lit("")).alias(digest_column("_whole", df.columns))).mapInArrow(
        releasing(_counter(code, len(keep))), f"{kinds}, n_tokens long" if kinds else "n_tokens long")
    size = F.coalesce(F.char_length(text), F.lit(0))
    short, long = df.filter(size <= chunk), df.filter(size > chunk)
    mark = digest_column("_text_id", df.columns)
    with scratch(spark) as hold:
        texts = long.select(F.sha2(F.col(text), 256).alias("text_id"), F.col(text).alias("text"))
        whole = composed(chunk_maps(texts, code, chunk), fan)
        total = F.col("map")[0]["settled"] + F.col("map")[0]["open"]
        totals = stored(whole.select(F.col("text_id").alias(mark), total.alias("n_tokens")), "totals")
        named = long.withColumn(mark, F.sha2(F.col(text), 256))
        out = own(short).unionByName(named.join(totals.filter("n_tokens IS NOT NULL"), mark).select(*keep, "n_tokens"))
        stuck = totals.filter("n_tokens IS NULL").select(mark)
        if not stuck.isEmpty():
            out = out.unionByName(own(named.join(stuck, mark, "left_semi")))
        return hold(out, "counted")


def op12_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return counted(docs, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
