"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

The index is a table. Each task inverts the documents it reads, a bounded number of
postings at a time, into shards: one row for each term of a shard with its documents and
frequencies, and one with the shard's keys and lengths. So building it shuffles nothing,
and any set of items can be answered from the stored table.

A search asks the index for its own terms only. What they find comes together by shard and
block of items; neither grows with the corpus. Within a shard an item's terms have upper
bounds: their weight times the best impact of their postings there. The terms with the
smallest bounds, as many as together stay below the tenth best score so far, are not
essential: a document with no other term cannot qualify. The postings of the essential
terms are read in blocks of documents; the others are only probed, from the largest bound
down, for the documents that can still qualify. The best of all shards are merged.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's norm
10 + (90 n N) div L, and each term adds weight * (10^9 tf div (1000 tf + 8 norm)).

Defined results for odd input: null and empty texts have no terms and are not counted; rows
that repeat a key are ranked each by its own text; keys that are null come last among equal
scores; items that repeat an id count as one with the terms of all; items without terms, or
with none that any document holds, find nothing; columns other than key and text play no
part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import lower_ascii, releasing, scratch, small_batches, split_words, stored, table

BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BEST = 10
#: Postings of a shard, rows of the index written at a time, items and documents of a block.
POSTINGS = 1 << 21
ROWS = 1 << 14
ITEMS = 1024
BLOCK = 1024
#: Rows of (item, term) up to which the terms are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
# Fixed values of the score.
SCALE, GAIN, NORM, BASE, SLOPE = 1_000_000_000, 1000, 8, 10, 90


class Shard:
    """Documents that are being inverted: postings (document, term, frequency) with terms by slice."""

    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.slices: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.documents = self.postings = 0

    def add(self, keys: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        data = bytescan.lower(data)
        starts, ends, first = bytescan.words(data, offsets, bytescan.TERM_BREAKS)
        length = np.diff(first)
        keep = np.flatnonzero(length)
        if not len(keep):
            return
        document = np.repeat(np.arange(len(keep)), length[keep])
        solid = data[~bytescan.TERM_BREAKS[data]]
        cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        terms = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(solid)]).dictionary_encode()
        pair = document * np.int64(len(terms.dictionary)) + terms.indices.to_numpy()
        pair, count = np.unique(pair, return_counts=True)
        at, term = np.divmod(pair, len(terms.dictionary))
        self.slices.append(((at + self.documents).astype(np.int32), term.astype(np.int32), count.astype(np.int32), terms.dictionary))
        self.keys.append(keys.take(pa.array(keep)))
        self.lengths.append(length[keep].astype(np.int32))
        self.documents += len(keep)
        self.postings += len(pair)

    def rows(self, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard's rows: its documents, then its terms."""
        ints = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        names = ["shard", "term", "rows", "counts", "keys"]
        numbers = np.concatenate(self.lengths)
        ends = [0, len(numbers)]
        head = [pa.array([name]), pa.array([None], pa.string()), ints(ends, np.arange(len(numbers), dtype=np.int32)), ints(ends, numbers)]
        yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(self.keys))], names)
        every = pa.concat_arrays([s[3] for s in self.slices]).dictionary_encode()
        begins = np.cumsum([0, *(len(s[3]) for s in self.slices)])
        code = every.indices.to_numpy()
        term = np.concatenate([code[b + s[1]] for b, s in zip(begins, self.slices)])
        order = np.argsort(term, kind="stable")  # documents stay in order
        rows = np.concatenate([s[0] for s in self.slices])[order]
        counts = np.concatenate([s[2] for s in self.slices])[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(every.dictionary)))]).astype(np.int32)
        for i in range(0, len(ends) - 1, ROWS):
            cut = ends[i : i + ROWS + 1]
            a, b = int(cut[0]), int(cut[-1])
            n = len(cut) - 1
            part = [pa.array([name] * n), every.dictionary.slice(i, n).cast(pa.string()), ints(cut - a, rows[a:b]), ints(cut - a, counts[a:b])]
            yield pa.RecordBatch.from_arrays([*part, pa.nulls(n, pa.list_(kind))], names)


def _inverter(postings: int, step: int):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard, kind = TaskContext.get().partitionId(), 0, Shard(), None
        for batch in batches:
            keys, kind = batch.column(0), batch.schema.field(0).type
            for i, j, data, offsets in bytescan.text_slices(batch.column(1), step):
                shard.add(keys.slice(i, j - i), data, offsets)
                if shard.postings >= postings:
                    yield from shard.rows(f"{task}-{made}", kind)
                    shard, made = Shard(), made + 1
        if shard.documents:
            yield from shard.rows(f"{task}-{made}", kind)

    return invert


def inverted(docs: DataFrame, key: str = "doc_id", text: str = "text", postings: int = POSTINGS, step: int = bytescan.SLICE) -> DataFrame:
    """The index: (shard, term, rows, counts, keys). A shard ends with the `step` bytes of text that reach `postings`.

    A row with a term has the documents of the shard that hold it, numbered from 0, and how
    often; the row without a term has all documents' lengths as counts, and their keys.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(releasing(_inverter(postings, step)), f"shard string, term string, rows array<int>, counts array<int>, keys array<{kind}>")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each once."""
    words = split_words(lower_ascii(F.col(text)), BREAKS)
    return items.select(F.col(key).alias("item"), F.explode(F.array_distinct(words)).alias("term")).distinct()


class List:
    """A term's postings in a shard: documents in order, and what each adds before the weight."""

    def __init__(self, rows: np.ndarray, impact: np.ndarray, blocks: np.ndarray) -> None:
        self.rows, self.impact, self.most = rows, impact, int(impact.max())
        self.cuts = np.searchsorted(rows, blocks).tolist()


def best_of(terms: list[tuple[List, int]], order: np.ndarray, size: int, k: int = BEST) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents probed) of the k highest scores above 0 by MaxScore.

    terms: postings with weights; `order` has each document's place among equal scores.
    """
    terms = sorted((t for t in terms if t[1] > 0), key=lambda t: t[0].most * t[1])
    bound = np.cumsum([0, *(t.most * w for t, w in terms)])  # of the first 0, 1, 2 ... terms together
    found, scores, least, probed = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
    for block in range(-(-size // BLOCK)):
        essential = int(np.searchsorted(bound, least, "left")) - 1  # so many terms stay below the least score
        if essential == len(terms):
            break
        begin = block * BLOCK
        total = np.zeros(BLOCK, np.int64)
        for t, w in terms[essential:]:
            a, b = t.cuts[block], t.cuts[block + 1]
            total[t.rows[a:b] - begin] += t.impact[a:b] * w
        near = np.flatnonzero(total)
        total = total[near]
        for i in range(essential - 1, -2, -1):
            able = total + bound[i + 1] >= least
            near, total = near[able], total[able]
            if i < 0 or not len(near):
                break
            t, w = terms[i]
            a, b = t.cuts[block], t.cuts[block + 1]
            if a == b:
                continue
            probed += len(near)
            own = t.rows[a:b] - begin
            at = np.minimum(np.searchsorted(own, near), len(own) - 1)
            total += np.where(own[at] == near, t.impact[a:b][at], 0) * w
        if len(near):
            found, scores = np.concatenate([found, near + begin]), np.concatenate([scores, total])
            keep = np.lexsort([order[found], -scores])[:k]
            found, scores = found[keep], scores[keep]
            if len(scores) == k:
                least = int(scores[-1])
    return found, scores, probed


def _searcher(n: int, length: int, k: int):
    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        head = group.filter(pc.is_null(group["term"]))
        lists = group.filter(pc.is_valid(group["term"]))
        kinds = [("item", group.schema.field("asks").type.value_type.field("item").type), ("key", group.schema.field("keys").type.value_type), ("score", pa.int64())]
        if not head.num_rows or not lists.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds})
        keys = head["keys"].chunk(0).flatten()
        lengths = head["counts"].chunk(0).flatten().to_numpy().astype(np.int64)
        order = np.empty(len(keys), np.int64)
        order[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))  # nulls last
        norm = NORM * (BASE + SLOPE * lengths * n // length)
        blocks = np.arange(-(-len(keys) // BLOCK) + 1) * BLOCK
        flat = {c: lists[c].chunk(0) for c in ("rows", "counts", "asks")}
        ends = {c: flat[c].offsets.to_numpy() for c in flat}
        rows, counts = flat["rows"].values.to_numpy(), flat["counts"].values.to_numpy().astype(np.int64)
        items, weights = flat["asks"].values.field("item"), flat["asks"].values.field("weight").to_numpy()
        coded = items.dictionary_encode()
        codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        terms: dict[int, list[tuple[List, int]]] = {}
        for j in range(lists.num_rows):
            a, b = ends["rows"][j], ends["rows"][j + 1]
            tf = counts[ends["counts"][j] : ends["counts"][j + 1]]
            one = List(rows[a:b], SCALE * tf // (GAIN * tf + norm[rows[a:b]]), blocks)
            for i in range(ends["asks"][j], ends["asks"][j + 1]):
                terms.setdefault(int(codes[i]), []).append((one, int(weights[i])))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for code, asked in terms.items():
            found, scores, _ = best_of(asked, order, len(keys), k)
            out.append((np.full(len(found), code), found, scores))
        code, found, scores = (np.concatenate(x) for x in zip(*out))
        names = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
        return pa.table([names.take(pa.array(code)), keys.take(pa.array(found)), pa.array(scores)], names=["item", "key", "score"])

    return search


def searched(index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", k: int = BEST) -> DataFrame:
    """(item, rank, key, score): each item's k highest-scoring documents of the stored index."""
    spark = index.sparkSession
    heads = index.filter("term IS NULL")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    n, length = heads.agg(F.sum(F.size("counts")), F.sum(size)).first()
    terms = stored(item_terms(items, item_key, item_text), "terms")
    asked = terms.count()
    blocks = max(1, -(-terms.select("item").distinct().count() // ITEMS))
    hint = F.broadcast if asked <= BROADCAST_ROWS else lambda df: df
    lists = index.filter("term IS NOT NULL").join(hint(terms.select("term").distinct()), "term", "left_semi")
    lists = stored(lists.select("shard", "term", "rows", "counts"), "lists")
    df = lists.groupBy("term").agg(F.sum(F.size("rows")).alias("df"))
    weight = F.floor(GAIN * F.ln((2 * F.lit(n or 0) + 2).cast("double") / (2 * F.col("df") + 1)))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asks = terms.join(df, "term").select("term", block.alias("block"), F.struct("item", weight.alias("weight")).alias("ask"))
    asks = stored(asks.groupBy("term", "block").agg(F.collect_list("ask").alias("asks")), "asks")  # at most about ITEMS of them
    kind, item = heads.schema["keys"].dataType, terms.schema["item"].dataType.simpleString()
    found = lists.join(hint(asks), "term").select("shard", "block", "term", "rows", "counts", F.lit(None).cast(kind).alias("keys"), "asks")
    each = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "rows", "counts", "keys", F.lit(None).cast(asks.schema["asks"].dataType).alias("asks"))
    both = found.unionByName(each)
    own = both.groupBy("shard", "block").applyInArrow(_searcher(n or 0, length or 1, k), f"item {item}, key {kind.elementType.simpleString()}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "key", "score")


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark) as hold:
        index = stored(inverted(docs), "index")
        best = searched(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
        out = hold(best, "best")
    return out.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def oracle() -> str:
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BREAKS}]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({terms}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
z AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
w AS (SELECT t, CAST(floor({GAIN} * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z GROUP BY t),
i AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark)),
m AS (SELECT doc_id, {100 - SLOPE} + ({SLOPE} * n * nn) // ll AS m FROM n, z),
s AS (SELECT item_id, doc_id, sum(w * (({SCALE} * tf) // ({GAIN} * tf + {NORM} * m)))::BIGINT AS score FROM i JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {BEST}
"""
