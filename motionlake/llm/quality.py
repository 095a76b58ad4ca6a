"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is computed inside the row by built-in functions, so a scan of the
text column is the only input and nothing is shuffled.

Defined results for odd input: a null or empty text has no words, so all counts are
0 and it fails the base rule; columns that the caller already has are kept, and a
measure of the same name replaces them only in the output of `score`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, digest_column, opaque, split_words, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages served.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ne pas par pour que qui sur un une "
    "als auch auf aus das dem den der die ein eine er es für ich ist mit nicht sich sie und von zu "
    "al como con del el los más no para por se su una y"
).split()


class Rule(NamedTuple):
    """low * den <= 100 * num <= high * den; None leaves a side open."""

    name: str
    num: str
    den: str
    low: int | None
    high: int | None


RULES: Sequence[Rule] = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("open_lines", "n_open_lines", "n_lines", None, 60),
)


def _twins(pairs: str) -> Column:
    """From sorted (hash, place): the places, in order, of windows that the text holds at least twice.

    Equal windows are neighbours in `pairs`, which must be a stored column: read inside
    the function it would otherwise be sorted again for each element.
    """
    p = F.col(pairs)
    same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    return F.array_sort(F.array_compact(F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one column per measure, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, hashes, paired, twins = (digest_column(c, df.columns) for c in ("_words", "_lines", "_hashes", "_pairs", "_twins"))
    stop = [x for w in STOP_WORDS for x in (w, w.capitalize())]
    blank = f"[^{SPACE}]"
    df = df.withColumns({
        words: split_words(F.col(text)),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(blank)),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).cast("long"),
        "n_open_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)$"))).cast("long"),
        hashes: F.when(
            F.size(words) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
        ),
    })
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(paired, F.when(repeats, pairs)).withColumn(twins, _twins(paired))
    gain = F.transform(twins, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(twins), k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", opaque(F.coalesce(total, F.lit(0).cast("long"))))
    return df.drop(words, lines, hashes, paired, twins)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The table as one boolean: every rule holds."""
    ok = F.lit(True)
    for r in rules:
        num, den = 100 * F.col(r.num), F.col(r.den)
        if r.low is not None:
            ok = ok & (num >= r.low * den)
        if r.high is not None:
            ok = ok & (num <= r.high * den)
    return ok


def score(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with the measures, base_failed and kept."""
    out = measures(df, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_stop_words", "n_lines", "base_failed", "kept",
    )


def oracle() -> str:
    stop = ", ".join(f"'{x}'" for w in STOP_WORDS for x in (w, w.capitalize()))
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"100 * {r.num} >= {r.low} * {r.den}")
        if r.high is not None:
            tests.append(f"100 * {r.num} <= {r.high} * {r.den}")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls
  FROM documents),
u AS (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+{WINDOW - 1}]) AS c FROM u),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, range({WINDOW}) r(o) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[{SPACE}]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) AS BIGINT) AS n_open_lines
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept
FROM b
"""
