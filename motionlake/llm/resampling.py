"""Importance resampling: documents are drawn in proportion to how much they look like target texts.

A feature is a run of one or two neighbouring words, and its bucket the CRC-32 of its bytes
modulo BUCKETS. The CRC of each word is computed once, from its bytes. CRCs of longer runs
are composed from those of their words: putting n bytes behind a text is a linear map over
GF(2) of its CRC, given by a 32 x 32 matrix to the power of n, and the CRC of what follows is
then added. So no run of words is ever made as a string.

The buckets of both tables are counted within each task and summed, which leaves BUCKETS
numbers whatever the input. They give each bucket a gain, and a second scan gives each
document the mean gain of its features. A fixed number drawn from the doc_id turns that
into a Gumbel draw, so that the highest scores are a sample without replacement.

Defined results for odd input: null and empty texts have no features and weight 0; a null
doc_id draws like an empty one; rows that repeat a doc_id share its draw and are judged
each by its own text; equal rows take neighbouring ranks; an empty target gives every
bucket the gain of no target features; empty tables give no rows; columns of the caller
stay, other than those named like the operator's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import digest_column, releasing, scratch, small_batches, stored, table
from .sharding import numbered

BUCKETS = 10_000
MOST = 2
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Words of more bytes are few, and take their CRC one by one.
LONG_WORD = 48
SPACE = 0x20
# Fixed value: the polynomial of CRC-32, bits turned round.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


_TABLE = _byte_table()


def _added(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The running CRC after one more byte."""
    return _TABLE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))


def mapped(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The matrix times each CRC. A matrix is kept as what it makes of each value of each of the 4 bytes."""
    return matrix[..., 0, crc & 0xFF] ^ matrix[..., 1, (crc >> 8) & 0xFF] ^ matrix[..., 2, (crc >> 16) & 0xFF] ^ matrix[..., 3, crc >> 24]


@lru_cache(maxsize=2048)
def shift(length: int) -> np.ndarray:
    """The matrix that puts `length` zero bytes behind a text: squares of the matrix for one."""
    if length == 0:
        return np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    if length == 1:
        return _added(shift(0), 0)
    half = mapped(shift(length // 2), shift(length // 2))
    return mapped(shift(1), half) if length % 2 else half


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of each word, all words side by side, byte by byte."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, long = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for p in range(min(LONG_WORD, int(long[0])) if len(long) else 0):
        live = int(np.searchsorted(-long, -p, "left"))  # so many words have more than p bytes
        crc[:live] = _added(crc[:live], data[at[:live] + p])
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-long, -LONG_WORD, "left"))):
        crc[k] = zlib.crc32(data[at[k] : at[k] + long[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def run_crcs(crc: np.ndarray, lengths: np.ndarray, most: int = MOST) -> Iterator[np.ndarray]:
    """The CRCs of the runs of 1, 2 ... `most` words, joined by one space, from each word on.

    Runs over the end of a text are among them; it is for the caller to leave them out.
    """
    kinds, kind = np.unique(lengths, return_inverse=True)
    matrices = np.stack([shift(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    run = crc
    yield run
    for _ in range(1, most):
        head = _added(run[:-1] ^ np.uint32(0xFFFFFFFF), SPACE) ^ np.uint32(0xFFFFFFFF)
        last = len(crc) - len(head)
        k = kind[last:]
        moved = matrices[k, 0, head & 0xFF] ^ matrices[k, 1, (head >> 8) & 0xFF] ^ matrices[k, 2, (head >> 16) & 0xFF] ^ matrices[k, 3, head >> 24]
        run = moved ^ crc[last:]
        yield run


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of the run from each word, whether it stays in its text, first word of each text), for each length of run."""
    data = bytescan.lower(data)
    starts, ends, first = bytescan.words(data, offsets, bytescan.TERM_BREAKS)
    stop = np.repeat(first[1:], np.diff(first))
    for size, crc in enumerate(run_crcs(word_crcs(data, starts, ends), ends - starts, most), 1):
        yield (crc % np.uint32(buckets)).astype(np.int64), np.arange(len(crc)) + size <= stop[: len(crc)], first


def _counter(buckets: int, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in bytescan.text_slices(batch.column(0)):
                for bucket, inside, _ in features(data, offsets, buckets, most):
                    total += np.bincount(bucket[inside], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return count


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds."""
    small_batches(df.sparkSession)
    each = df.select(text).mapInArrow(releasing(_counter(buckets, most)), "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts of the features of both sides."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("sources"), F.sum("t").alias("targets"))
    plus = lambda c, k: (F.col(c) + k).cast("double")
    ratio = plus("t", 1) * plus("sources", buckets) / (plus("s", 1) * plus("targets", buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # sums is one row


def _weigher(gain: np.ndarray, keep: int, most: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in bytescan.text_slices(batch.column(keep)):
                count, total, n_words = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for k, (bucket, inside, first) in enumerate(features(data, offsets, len(gain), most)):
                    ends = np.minimum(first, len(bucket))
                    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])  # noqa: B023, E731
                    total += sums(np.where(inside, gain[bucket], 0))
                    count += sums(inside)
                    n_words = np.diff(first) if k == 0 else n_words
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                made = [pa.array(x.astype(np.int64)) for x in (n_words, count, weight)]
                rest = [batch.column(c).slice(i, j - i) for c in range(keep)]
                yield pa.RecordBatch.from_arrays([*rest, *made], [*batch.schema.names[:keep], "n_words", "n_features", "weight"])

    return weigh


def weighed(df: DataFrame, gain: DataFrame, text: str = "text", keep: list[str] | None = None, most: int = MOST) -> DataFrame:
    """The columns `keep` (all that df has) with n_words, n_features and weight, the floored mean gain."""
    small_batches(df.sparkSession)
    df = df.drop("n_words", "n_features", "weight")
    keep = df.columns if keep is None else keep
    table_ = np.array([r.gain for r in gain.orderBy("bucket").collect()], np.int64)  # one number for each bucket
    source = df.select(*keep, F.col(text).alias(digest_column("_text", df.columns)))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(releasing(_weigher(table_, len(keep), most)), f"{kinds}n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A whole number of thousandths, drawn from the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.ln(-F.ln(u)))


def drawn(df: DataFrame, key: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """df, as weighed, with score and rank: 1, 2, 3 ... for the highest scores, null for rows not drawn.

    Ranks come from ranges of the scores, each of which is one task's; rows alike in
    everything are told apart by where they stand, so they fall into several ranges.
    """
    df = df.drop("score", "rank")
    down, no_key, tie = (digest_column(c, df.columns) for c in ("_down", "_no_key", "_tie"))
    scored = df.withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    scored = stored(scored.withColumns({down: -F.col("score"), no_key: F.col(key).isNull(), tie: F.monotonically_increasing_id()}), "scored")
    pool = scored.filter(F.col("n_words") >= least)
    ranked, n = numbered(pool, [down, no_key, key, "n_features", tie], "rank")
    rank = F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1)
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest).drop(down, no_key, tie)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The columns `keep` (all that docs has) with n_words, n_features, weight, score and rank; rows with a rank are the sample."""
    with scratch(docs.sparkSession) as hold:
        gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
        return hold(drawn(weighed(docs, gain, text, keep), key, percent, least, seed), "resampled")


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resampled(docs, table(spark, sf_dir, "benchmark").select("text"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    breaks = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{breaks}]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT doc_id, unnest({runs}) AS f FROM d),
bf AS (SELECT unnest({runs}) AS f FROM b),
c AS (
  SELECT f, CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                                 lambda a, v: xor(a >> 8, tab[CAST(xor(a, v) & 255 AS INT) + 1])), 4294967295) AS BIGINT) % {BUCKETS} AS k
  FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
dk AS (SELECT doc_id, k, count(*) AS n FROM df JOIN c USING (f) GROUP BY doc_id, k),
s AS (SELECT k, sum(n)::BIGINT AS s FROM dk GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN c USING (f) GROUP BY k),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (tt + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.k = s.k, z),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM dk JOIN g USING (k) GROUP BY doc_id),
e AS (SELECT doc_id, len(w) >= {LEAST_WORDS} AS pool, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        (CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY pool) AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN pool AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r
"""
