"""Exact percentiles of a whole table by histograms that narrow to the wanted ranks.

Each round counts, for each wanted rank, the values of its range in BINS bins with the
least and greatest value of each; the bin that holds the rank is the next range. Ends are
values of the table and fall into different bins, so every round narrows, and a range that
holds one value, or few rows, is the end. A task holds BINS counts, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Rows of a range that are sorted on the driver.
FEW = 1024


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value between low and high, in the order of values; 0 for low and the last for high."""
    if math.isfinite(low) and math.isfinite(high) and math.isfinite(high - low):
        at = (value - F.lit(low)) / F.lit(high - low)
    else:
        at = (F.atan(value) - F.lit(math.atan(low))) / F.lit(math.atan(high) - math.atan(low))
    inner = F.least(F.lit(bins - 2), F.greatest(F.lit(1), F.floor(at * bins)))
    return F.when(value <= low, 0).when(value >= high, bins - 1).otherwise(inner).cast("int")


def order_statistics(df: DataFrame, value: Column, ranks: Sequence[int], bins: int = BINS, few: int = FEW) -> dict[int, float]:
    """The values of the given ranks, from 0; df must have so many values that are neither null nor NaN."""
    values = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    ranges = {r: (low, high, 0, n) for r in ranks}  # least and greatest value, rows in front, rows within
    found: dict[int, float] = {}
    while len(found) < len(ranges):
        for r, (a, b, _, _) in ranges.items():
            if a == b:
                found[r] = a
        open_ = sorted({v for r, v in ranges.items() if r not in found})
        small = [v for v in open_ if v[3] <= few]
        wide = [v for v in open_ if v[3] > few]
        within = lambda v: F.col("v").between(v[0], v[1])
        if small:
            each = F.array(*(F.when(within(v), F.lit(i)) for i, v in enumerate(small)))
            rows = values.select("v", F.explode(F.filter(each, lambda i: i.isNotNull())).alias("i")).collect()  # at most `few` for each rank
            for i, v in enumerate(small):
                own = sorted(x.v for x in rows if x.i == i)
                found |= {r: own[r - v[2]] for r, w in ranges.items() if w == v}
        if wide:
            each = F.array(*(F.when(within(v), F.struct(F.lit(i).alias("i"), _bin(F.col("v"), v[0], v[1], bins).alias("bin"))) for i, v in enumerate(wide)))
            counts = values.select("v", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.bin").agg(F.count("*"), F.min("v"), F.max("v")).collect()
            for i, v in enumerate(wide):
                before = v[2]
                for _, _, count, a, b in sorted(c for c in map(tuple, counts) if c[0] == i):
                    ranges |= {r: (a, b, before, count) for r, w in ranges.items() if w == v and before <= r < before + count}
                    before += count
    return found


def percentiles(df: DataFrame, value: Column, parts: Sequence[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The same as the exact percentile function gives, interpolated between neighbours; NaN counts as the greatest."""
    v = value.cast("double")
    n, odd = df.agg(F.count(v), F.count_if(F.isnan(v))).first()
    if not n:
        return [None] * len(parts)
    places = [p * (n - 1) for p in parts]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = order_statistics(df, value, [r for r in ranks if r < n - odd], bins, few)
    at = lambda r: found.get(r, math.nan)
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        low, high = at(a), at(b)
        out.append(low if a == b or low == high else (b - p) * low + (p - a) * high)
    return out
