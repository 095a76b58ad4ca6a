"""Scans along long keys: last values, next values, rows before and running sums in many tasks.

A key's rows are cut into ranges of their order, so a key of any length is worked on by as
many tasks as it has ranges. Each range tells its last and first values and its sums; a
scan over the ranges of a key, which are few, gives what is carried into each; and within a
range ordinary windows do the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

RANGE = "_range"
#: Rows of a key beyond which it is cut into ranges.
LONG_KEY = 1_000_000


def has_long_key(df: DataFrame, key: Sequence[str], rows: int = LONG_KEY) -> bool:
    """Whether some key has more rows than that; only counted where the input's estimated size allows for it."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 * rows:
        return False
    return (df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > rows


def ranged(df: DataFrame, key: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """df with the number of the range that each row fell into, written once so that all later steps see the same cut."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(ranges, *key, *order).withColumn(RANGE, F.spark_partition_id()))


def scanned(
    df: DataFrame, key: Sequence[str], order: Sequence[str], before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, ranges: int | None = None,
) -> DataFrame:
    """df with new columns along the order of each key.

    before: the last value that is not null up to the row; after: the first one from the
    row on; previous: the value of the row in front; sums: the sum up to the row. The order
    must tell rows apart. A df that is `ranged` already is not cut again.
    """
    before, after, previous, sums = before or {}, after or {}, previous or {}, sums or {}
    rows = df if RANGE in df.columns else ranged(df, key, order, ranges)
    at = F.struct(*order)
    where = lambda c: F.when(c.isNotNull(), at)
    number = {n: i for i, n in enumerate([*before, *after, *previous, *sums])}
    edge, carried = (lambda n: f"_edge{number[n]}"), (lambda n: f"_carry{number[n]}")  # a new column may be named like the key
    edges = rows.groupBy(RANGE, *key).agg(
        F.count("*").alias("_rows"),
        *(F.max_by(c, where(c)).alias(edge(n)) for n, c in before.items()), *(F.min_by(c, where(c)).alias(edge(n)) for n, c in after.items()),
        *(F.max_by(c, at).alias(edge(n)) for n, c in previous.items()), *(F.sum(c).alias(edge(n)) for n, c in sums.items()),
    )
    along = Window.partitionBy(*key).orderBy(RANGE)
    back = Window.partitionBy(*key).orderBy(F.desc(RANGE))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.withColumn("_ranges", F.count("*").over(Window.partitionBy(*key))).filter("_ranges > 1").select(
        F.col(RANGE).alias("_at"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)),
        *(F.last(edge(n), True).over(earlier(along)).alias(carried(n)) for n in before), *(F.last(edge(n), True).over(earlier(back)).alias(carried(n)) for n in after),
        *(F.lag(edge(n)).over(along).alias(carried(n)) for n in previous), *(F.sum(edge(n)).over(earlier(along)).alias(carried(n)) for n in sums),
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)), F.col(RANGE) == F.col("_at"))
    out = rows.join(F.broadcast(carry), same, "left")  # a range holds parts of at most two keys that reach beyond it
    inside = Window.partitionBy(RANGE, *key)
    w, b = inside.orderBy(*order), inside.orderBy(*(F.desc(c) for c in order))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    made = {n: F.coalesce(F.last(c, True).over(so_far(w)), F.col(carried(n))) for n, c in before.items()}
    made |= {n: F.coalesce(F.last(c, True).over(so_far(b)), F.col(carried(n))) for n, c in after.items()}
    made |= {n: F.when(first, F.col(carried(n))).otherwise(F.lag(c).over(w)) for n, c in previous.items()}
    for n, c in sums.items():
        own, carry_in = F.sum(c).over(so_far(w)), F.col(carried(n))
        made[n] = F.coalesce(own + carry_in, own, carry_in)
    return out.select(*(c for c in rows.columns if c not in made), *(v.alias(n) for n, v in made.items()))
