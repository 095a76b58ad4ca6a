"""Sharding: a Feistel permutation over global row numbers, with cycle walking.

Rows are numbered once in a total order, the number is permuted by a keyed bijection on
0..n-1, and shard and slot follow from the permuted place alone: place mod shards and
place div shards. Anyone who knows n, the seed and a row's number can compute both.

Only the order columns, never the texts, are dealt out; a range shuffle splits even a
hot key, since size and checksum take part in the order.

Defined results for odd input: null keys come first; rows that are alike in all order
columns take neighbouring numbers in either order, which gives the same set of rows; an
empty table gives no rows; a null text counts as empty.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_column, stored, table

SHARDS = 8
SEED = 20240607
ROUNDS = 6
ROWS_PER_RANGE = 1_000_000
# Two primes below 2**31, so products stay within a long.
PRIME_A, PRIME_B = 2147483647, 2147483629


def sides(n: int) -> tuple[int, int]:
    """The smallest near-square grid a x b that holds 0..n-1; fewer than a cells are left over."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    rng = random.Random(seed)
    return [tuple(rng.randrange(1, 2**31 - 2) for _ in range(4)) for _ in range(rounds)]


def scramble(x: Column, n: int, keys: list[tuple[int, int, int, int]]) -> Column:
    """One pass of the permutation of the grid; may land on a cell of n or more."""
    a, b = sides(n)
    left, right = F.call_function("div", x, F.lit(b)), x % b

    def mixed(v: Column, k: tuple[int, int, int, int]) -> Column:
        return (((v * k[0] + k[1]) % PRIME_A) * k[2] + k[3]) % PRIME_B

    for i, k in enumerate(keys):
        if i % 2:
            right = (right + mixed(left, k)) % b
        else:
            left = (left + mixed(right, k)) % a
    return left * b + right


def permuted(x: Column, n: int, keys: list[tuple[int, int, int, int]]) -> Column:
    """Walk on from cells outside 0..n-1 until one inside is met.

    A walk leaves the grid's spare cells after at most as many steps as there are of
    them, so the loop has that bound; it runs for those rows only.
    """
    a, b = sides(n)
    if a * b == n:
        return x
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    walk = F.aggregate(steps, x, lambda at, _: F.when(at < n, at).otherwise(scramble(at, n, keys)))
    return F.when(x < n, x).otherwise(walk)


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with its rows' numbers 0..n-1 in the given order, and n.

    The ranges are written once, so that counting and numbering see the same cut; the
    driver holds one count for each range of about a million rows.
    """
    spark = df.sparkSession
    part, seq = digest_column("_part", df.columns), digest_column("_seq", df.columns)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_RANGE))
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    cut = stored(cut.withColumns({part: F.spark_partition_id(), seq: F.monotonically_increasing_id()}), "ranges")
    offsets, n = [], 0
    for p, first, rows in sorted(cut.groupBy(part).agg(F.min(seq), F.count("*")).collect()):
        offsets.append((p, n - first))
        n += rows
    shift = spark.createDataFrame(offsets, f"{part} int, {name} long")
    out = cut.join(F.broadcast(shift), part).withColumn(name, F.col(name) + F.col(seq))
    return out.drop(part, seq), n


def shards(df: DataFrame, order: list[str], count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (int) and slot (long): counts differ by one at most, slots have no gaps."""
    row = digest_column("_row", df.columns)
    rows, n = numbered(df, order, row)
    keys = round_keys(seed)
    rows = rows.withColumn(row, scramble(F.col(row), n, keys)).withColumn(row, permuted(F.col(row), n, keys))
    return rows.withColumns({
        "shard": (F.col(row) % count).cast("int"),
        "slot": F.call_function("div", F.col(row), F.lit(count)).cast("long"),
    }).drop(row)


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shards(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def oracle() -> str:
    at = "SELECT *, (CAST(x AS BIGINT) // b) AS l, (CAST(x AS BIGINT) % b) AS r FROM inp"
    for i, (k0, k1, k2, k3) in enumerate(round_keys(SEED)):
        src, dst, m = ("l", "r", "b") if i % 2 else ("r", "l", "a")
        mixed = f"((({src} * {k0}::BIGINT + {k1}) % {PRIME_A}) * {k2}::BIGINT + {k3}) % {PRIME_B}"
        at = f"SELECT * REPLACE (({dst} + {mixed}) % {m} AS {dst}) FROM ({at})"
    step = lambda source: f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS x) FROM ({at.replace('FROM inp', f'FROM ({source})')})"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         hex(encode(coalesce(text, ''))) AS h, tab
  FROM documents, crc_table),
c AS (
  SELECT doc_id, size,
         CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                              lambda a, v: xor(a >> 8, tab[CAST(xor(a, v) & 255 AS INT) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM d),
g AS (SELECT n, a, CAST((n + a - 1) // a AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
s AS (SELECT c.*, g.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM c, g),
w AS ({step('SELECT * FROM s')} UNION ALL {step('SELECT * FROM w WHERE x >= n')})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM w WHERE x < n
"""
