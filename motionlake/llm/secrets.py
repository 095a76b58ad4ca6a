"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

The patterns find assignments, access keys and long hexadecimal runs. Every other long
token whose characters fit an encoding (hex, base32, base64) is held against the null
hypothesis "drawn uniformly from that alphabet" by three tests: chi-squared on the
alphabet, runs about the middle, serial correlation. The corpus-wide Benjamini-Hochberg
step rejects the hypothesis for tokens that are text after all, each p-value being
weighted by the token's length, since longer tokens carry more evidence; the tokens it
does not reject are reported as `random`.

All of it is built-in functions. Per document only spans and p-values are kept; the
control step needs one histogram of a fixed number of bins.

Defined results for odd input: null and empty texts have no spans; positions are code
points; equal spans of several kinds are all listed; repeated rows each get the same
result, and each counts in the control step; `scanned` replaces columns of the caller
named assign, access, hex or tokens, `cleaned` keeps all; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import opaque, stored, table

# The patterns of the three base kinds, in the order in which equal starts are listed.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run holds no longer one, so the bound can stand in the pattern
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
# Alphabets by encoding, each with the form of its tokens.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("hex", "0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])[A-Z2-7]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$"),
)
FALSE_DISCOVERY = 0.1
BINS = 1024
#: Parts of a text that are gone through at a time; even, so that each block begins outside a match.
BLOCK = 256
MARK, OTHER = "\ue000", "\ue001"

SPAN = "array<struct<s:int,e:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str, keep: Callable[[Column], Column], found: Callable, kind: str) -> Column:
    """The leftmost non-overlapping matches that `keep` accepts, as an array of type `kind`.

    Matches are put between marks and the text is split there: odd parts are the matches,
    and the lengths of the parts before one add up to its place. That is done block by
    block, so that no array grows part by part. The mark's own character, where a text has
    it, is first changed to another that no pattern takes.
    """
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(safe, f"({pattern})", f"{MARK}$1{MARK}"), MARK)

    def cut(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.call_function("div", F.size(whole) - 1, F.lit(BLOCK)).cast("int"))
        return F.transform(numbers, lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)))

    def offsets(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(widths, start, step, lambda acc: acc["out"])

    def within(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(kind).alias("found"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            more = F.concat(acc["found"], F.array(found(acc["at"], end, part)).cast(kind))
            return F.struct(
                end.alias("at"),
                (~acc["hit"]).alias("hit"),
                F.when(acc["hit"] & keep(part), more).otherwise(acc["found"]).alias("found"),
            )

        return F.aggregate(block, start, step, lambda acc: acc["found"])

    spans = let(let(parts, cut), lambda blocks: let(offsets(blocks), lambda at: F.flatten(F.transform(blocks, lambda p, i: within(p, F.get(at, i))))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def _span(s: Column, e: Column, _: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


def tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a logistic of a cubic."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def battery(token: Column, alphabet: str) -> Column:
    """Simes' combination of the three tests' p-values; small means not random."""
    size = len(alphabet)
    values = F.transform(F.split(token, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))

    def chi(v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
        x2 = F.lit(float(size)) / n * _sum(F.transform(counts, lambda c: c * c)) - n
        df = size - 1.0
        return tail((F.pow(F.greatest(x2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)

    def runs(v: Column) -> Column:
        n = F.size(v).cast("double")
        turns = F.filter(v, lambda x, i: (i > 0) & ((x >= size / 2) != (F.get(v, i - 1) >= size / 2)))
        high = F.size(F.filter(v, lambda x: x >= size / 2)).cast("double")
        mean = 2.0 * high * (n - high) / n + 1.0
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        r = F.size(turns).cast("double") + 1.0
        return F.when(var > 0, 2.0 * tail(F.abs(r - mean) / F.sqrt(var))).otherwise(F.lit(0.0))

    def serial(v: Column) -> Column:
        n = F.size(v).cast("double")
        return let(_sum(v) / n, lambda m: let(
            _sum(F.transform(v, lambda x: (x - m) * (x - m))),
            lambda ss: F.when(ss > 0, 2.0 * tail(F.abs(_sum(F.transform(v, lambda x, i: F.when(i > 0, (x - m) * (F.get(v, i - 1) - m)).otherwise(F.lit(0.0)))) / ss) * F.sqrt(n))).otherwise(F.lit(0.0)),
        ))

    ps = let(values, lambda v: F.array_sort(F.array(chi(v), runs(v), serial(v))))
    return let(ps, lambda p: F.least(3.0 * F.get(p, F.lit(0)), 1.5 * F.get(p, F.lit(1)), F.get(p, F.lit(2))))


def randomness(token: Column) -> Column:
    """p-value of the token under its inferred encoding; null if it fits none."""
    core = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("double")
    for _, alphabet, form in reversed(ENCODINGS):
        out = F.when(core.rlike(form), battery(core, alphabet)).otherwise(out)
    return out


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """df with assign, access, hex (spans) and tokens (spans with p-values)."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    anything = lambda m: F.length(m) > 0
    token = "array<struct<s:int,e:int,p:double>>"
    with_p = lambda s, e, m: F.struct(s.alias("s"), e.alias("e"), randomness(m).alias("p"))
    df = df.withColumns({
        "assign": located(t, ASSIGN, value, _span, SPAN),
        "access": located(t, ACCESS, anything, _span, SPAN),
        "hex": located(t, HEX, anything, _span, SPAN),
        "tokens": opaque(located(t, TOKEN, lambda m: m.rlike("[0-9]"), with_p, token)),
    })
    return df.withColumn("tokens", opaque(F.filter("tokens", lambda c: c["p"].isNotNull())))


def cutoff(found: DataFrame, level: float = FALSE_DISCOVERY) -> tuple[float, float]:
    """The weighted p-value up to which "random" is rejected, and the mean token length.

    Benjamini-Hochberg on the edges of BINS bins of -log(p): at most BINS rows come to
    the driver whatever the corpus size.
    """
    tokens = found.select(F.explode("tokens").alias("c")).select((F.col("c.e") - F.col("c.s")).alias("n"), F.col("c.p").alias("p"))
    total, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return 0.0, 1.0
    q = F.greatest(F.col("p") * mean / F.col("n"), F.lit(1e-30))
    bins = tokens.groupBy(F.least(F.floor(-F.log(q) * 16), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("k"))
    best, below = 0.0, 0
    for b, k in sorted(bins.collect(), reverse=True):
        below += k
        edge = math.exp(-b / 16)
        if edge * total <= level * below:
            best = edge
    return best, mean


def spans(found: DataFrame, level: float = FALSE_DISCOVERY) -> DataFrame:
    """found with `spans`: array of (s, rank, e) of all kinds in order."""
    limit, mean = cutoff(found, level)
    base = F.concat("assign", "access", "hex")
    fresh = F.filter(
        "tokens",
        lambda c: (c["p"] * mean / (c["e"] - c["s"]) > limit) & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])),
    )
    def ranked(kind: str, found_spans: Column) -> Column:
        rank = KINDS.index(kind)
        return F.transform(found_spans, lambda c: F.struct(c["s"].alias("s"), F.lit(rank).alias("rank"), c["e"].alias("e")))

    every = [ranked(k, F.col(k)) for k in KINDS[:3]] + [ranked("random", fresh)]
    return found.withColumn("spans", opaque(F.array_sort(F.concat(*every))))


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, found: Column, by: str = "[secret]") -> Column:
    """text with its spans replaced; spans that touch or overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(by))).alias("out"),
    )
    done = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans of the text replaced; the columns stay as they are."""
    work = docs.select(F.struct(*docs.columns).alias("_all"), F.col(text).alias("_text"))
    found = spans(stored(scanned(work, "_text"), "secrets"))
    clean = F.when(F.col("_text").isNotNull(), redacted(F.col("_text"), F.col("spans"))).alias(text)
    return found.select(*(clean if c == text else F.col("_all")[c].alias(c) for c in docs.columns))


def op9_randomness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(scanned(docs).drop("text"), "secrets")
    out = spans(found).withColumn("base", F.filter("spans", lambda x: x["rank"] < 3))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
