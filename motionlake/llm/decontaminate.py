"""Benchmark decontamination: a positional inverted index in Spark tables.

The index is stored once: each row's postings in the order of their places. A test item is
searched segment by segment. Each of its windows asks the index from its rarest terms, two
more than a proximity match may miss; what several windows of a segment ask is asked once.
The postings of those terms, moved back by their offsets, are sorted together, and only
places where two of them agree are held against the whole segment. A window costs as much
as its rarest terms have postings, not as there are documents.

All steps after the index work row by row of the corpus, so it is dealt out by row, and
the windows, joins and sums on top of that stay where they are. What is broadcast
is made from the items alone, and only if its own size is below BROADCAST_BYTES.

Exact phrases have every word of the window in its place; proximity matches have at
least NEAR percent of its terms within SLOP words of their places, from a common start.

Defined results for odd input: null and empty texts have no words; rows that repeat a
doc_id with another text are judged apart; equal rows each get the same result; items
without words match nothing; items that repeat an id count as one; columns of the caller
stay, whatever their names; empty tables give no rows or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digest_column, lower_ascii, scratch, split_words, stored, table

#: What separates words: ASCII other than digits and lower-case letters.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WINDOW = 10
SLOP = 5
NEAR = 80
SEGMENT = 32
SLOTS = 1 << 16
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS)


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def row_of(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart, also those that repeat a key."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def indexed(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(row, key, terms): the terms of each row in the order of their places.

    Terms that share no slot of a table of SLOTS with a term of the items are null; the
    table, of one byte a slot, is all that the driver gets from the items.
    """
    slot = lambda h: F.pmod(h, F.lit(SLOTS))
    used = bytearray(SLOTS)
    for r in items.select(F.explode(hashed(F.col(item_text))).alias("h")).select(slot(F.col("h")).alias("s")).distinct().collect():
        used[r.s] = 1
    known = lambda h: F.substring(F.lit(bytes(used)), (slot(h) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    return docs.select(row_of(key, text).alias("row"), F.col(key).alias("key"), F.transform(hashed(F.col(text)), lambda h: F.when(known(h), h)).alias("terms"))


def postings(index: DataFrame) -> DataFrame:
    """(row, place, term)."""
    return index.select("row", F.posexplode("terms").alias("place", "term")).filter("term IS NOT NULL")


def segments(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW, stride: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(segment, first, terms, least) and (segment, window, at, length, distinct).

    A segment is the words of `stride` neighbouring windows of an item, from place `first`
    on; `least` is the fewest distinct terms of one of them. `at` counts from there too. An
    item of fewer words than a window is one window.
    """
    words = items.select(F.col(key).alias("item"), hashed(F.col(text)).alias("h")).filter(F.size("h") > 0).distinct()
    words = words.withColumn("length", F.least(F.size("h"), F.lit(size)))
    count = F.size("h") - F.col("length") + 1
    cut = words.withColumn("first", F.explode(F.sequence(F.lit(0), count - 1, F.lit(stride))))
    cut = cut.withColumns({"windows": F.least(F.lit(stride), count - F.col("first")), "terms": F.slice("h", F.col("first") + 1, F.col("length") + stride - 1)})
    cut = cut.withColumn("segment", F.xxhash64("item", "h", "first"))
    spans = cut.select("segment", "item", "length", "terms", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at"))
    spans = spans.withColumn("own", F.slice("terms", F.col("at") + 1, F.col("length")))
    spans = spans.select("segment", "item", F.xxhash64("own").alias("window"), "at", "length", "own", F.size(F.array_distinct("own")).alias("distinct"))
    least = spans.groupBy("segment").agg(F.min("distinct").alias("least"))
    return cut.select("segment", "terms").join(least, "segment"), spans


def asked(index: DataFrame, parts: DataFrame, spans: DataFrame, near: int = NEAR) -> DataFrame:
    """(segment, term, offset, single): the rarest terms of all windows, at their places in the segment."""
    used = small(parts.select(F.explode("terms").alias("term")).distinct())
    counts = postings(index).join(used, "term").groupBy("term").agg(F.count("*").alias("n"))
    each = spans.select("window", "own", "distinct").dropDuplicates(["window"]).withColumn("term", F.explode(F.array_distinct("own"))).join(counts, "term", "left")
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")))
    # of so many at least two are there, also if all that a match may miss are among them
    lists = F.call_function("div", F.col("distinct") * (100 - near), F.lit(100)).cast("int") + 2
    rare = each.groupBy("window", "distinct").agg(by.alias("by")).select("window", F.explode(F.slice("by", 1, lists)).alias("by"))
    rare = rare.filter("by.n > 0").select("window", "by.term")
    places = spans.select("segment", "window", "at", (F.col("distinct") == 1).alias("single"), F.posexplode("own").alias("o", "term"))
    places = places.join(rare, ["window", "term"]).withColumn("offset", F.col("at") + F.col("o"))
    return places.groupBy("segment", "term", "offset").agg(F.max("single").alias("single"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is below BROADCAST_BYTES; it is stored to know its size."""
    df = stored(df, "small")
    widths = F.lit(0)
    for f in df.schema.fields:
        widths = widths + (F.size(f.name) * 8 + 24 if f.dataType.typeName() == "array" else F.lit(8))
    size = df.agg(F.sum(widths + 32)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def matches(index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", slop: int = SLOP, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(row, window, start, length, phrase, near) of all matches, and (window, item)."""
    parts, spans = segments(items, item_key, item_text)
    parts, spans = small(parts), small(spans)
    asks = small(asked(index, parts, spans, near))
    dealt = index.filter("size(terms) > 0 AND terms IS NOT NULL AND row IS NOT NULL").select("row", "terms").repartition("row")
    at = postings(dealt).join(asks, "term").select("row", "segment", "term", "single", (F.col("place") - F.col("offset")).alias("start"))
    # between two that agree, there are also two next to each other that do
    by = Window.partitionBy("row", "segment").orderBy("start", "term")
    found = at.withColumns({"other": F.lag("start").over(by), "second": F.lag("term").over(by)})
    two = F.col("single") | ((F.col("term") != F.col("second")) & (F.col("start") - F.col("other") <= 2 * slop))
    found = stored(found.filter(two).groupBy("row").agg(F.collect_set(F.struct("segment", "start")).alias("found")), "found")
    # the row's words around each such place, held against all words of the segment
    looked = index.select("row", "terms").join(found, "row").select("row", "terms", F.explode("found").alias("f")).select("row", "terms", "f.segment", "f.start")
    looked = looked.join(parts.select("segment", F.size("terms").alias("long"), "least"), "segment")
    first = F.greatest(F.lit(0), F.col("start") - 2 * slop)
    after = F.col("start") + F.col("long") + 2 * slop
    looked = looked.select("row", "segment", "start", "least", first.alias("first"), F.slice("terms", first + 1, F.greatest(F.lit(0), after - first)).alias("near"))
    seen = looked.select("row", "segment", "start", "least", "first", F.posexplode("near").alias("p", "term"))
    occurs = small(parts.select("segment", F.posexplode("terms").alias("offset", "term")))
    seen = seen.join(occurs, ["segment", "term"]).withColumn("from", F.col("first") + F.col("p") - F.col("offset"))
    seen = seen.filter(F.abs(F.col("from") - F.col("start")) <= 2 * slop)
    spots = seen.groupBy("row", "segment", "start", "least").agg(F.collect_set(F.struct("from", "offset", "term")).alias("spots"), F.count_distinct("term").alias("terms"))
    spots = spots.filter(100 * F.col("terms") >= near * F.col("least")).drop("terms", "least")
    each = spots.join(spans.select("segment", "window", "at", "length", "distinct"), "segment")
    inside = (lambda s: (s["offset"] >= F.col("at")) & (s["offset"] < F.col("at") + F.col("length")))
    each = each.withColumn("spots", F.filter("spots", inside)).filter(100 * F.size("spots") >= near * F.col("distinct"))
    begins = F.array_distinct(F.transform(F.filter("spots", lambda s: (s["from"] <= F.col("start")) & (s["from"] >= F.col("start") - 2 * slop)), lambda s: s["from"]))
    within = lambda y: F.filter("spots", lambda o: (o["from"] >= y) & (o["from"] <= y + 2 * slop))
    most = F.array_max(F.transform(begins, lambda y: F.size(F.array_distinct(F.transform(within(y), lambda o: o["term"])))))
    right = F.size(F.array_distinct(F.transform(F.filter("spots", lambda s: s["from"] == F.col("start")), lambda s: s["offset"])))
    each = each.withColumns({"phrase": right == F.col("length"), "near": F.coalesce(100 * most >= near * F.col("distinct"), F.lit(False))})
    each = each.filter(F.col("phrase") | F.col("near"))
    out = each.select("row", "window", (F.col("start") + F.col("at")).alias("start"), "length", "phrase", "near")
    return stored(out, "matches"), spans.select("window", "item").distinct()


def judged(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per document row: row, key, n_words, n_hit, n_items, items (sorted), n_near, near_items (sorted), contaminated."""
    with scratch(docs.sparkSession) as keep:
        index = stored(indexed(docs, items, key, text), "index")
        found, owned = matches(index, items, item_key)
        phrases = found.filter("phrase")
        hit = phrases.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")).distinct()
        hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
        owners = phrases.select("row", "window").distinct().join(owned, "window")
        owners = owners.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
        close = found.select("row", "window").distinct().join(phrases.select("row", "window").distinct(), ["row", "window"], "left_anti").join(owned, "window")
        close = close.groupBy("row").agg(F.count_distinct("window").alias("n_near"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("near_items"))
        ends = index.select("row", "key", F.size("terms").cast("long").alias("n_words"))
        zero = F.lit(0).cast("long")
        out = ends.join(hit, "row", "left").join(owners, "row", "left").join(close, "row", "left")
        out = out.select(
            "row", "key", "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.when(F.col("items").isNull(), zero).otherwise(F.size("items").cast("long")).alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("n_near", zero).alias("n_near"),
            F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )
        return keep(out, "judged")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of an item."""
    mark = digest_column("_row", docs.columns)
    hit = judged(docs.select(key, text), items, key, text).filter("contaminated").select(F.col("row").alias(mark))
    return docs.withColumn(mark, row_of(key, text)).join(hit, mark, "left_anti").select(*docs.columns)


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases and proximity matches; n_near counts windows that are near and nowhere exact."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.drop("row").withColumnRenamed("key", "doc_id")


def oracle() -> str:
    words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BREAKS}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w, least(len({words}), {WINDOW}) AS k FROM benchmark),
bw AS (SELECT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
       FROM d, (SELECT DISTINCT k FROM bw)),
m AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
