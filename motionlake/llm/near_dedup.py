"""MinHash near-dedup by an LSH forest.

Each text's set of word shingles gives one MinHash signature. The forest's trees are
sorted orders of that signature, each read from another position on; texts that share a
prefix of an order are a region. A region that holds many texts is cut by a longer prefix
(adaptive depth). Small regions offer all their pairs, large ones the neighbours in their
sorted order, which have the longest common prefixes. Offered pairs are confirmed on the
full sets: first each text's two best, then every pair whose ends are still apart. Cutting
and neighbours may miss links, so all members of the shortest-prefix regions that are not
of one component then meet on their rarest shingles: first neighbours by size, which
settle most of a large group, then all that are still apart, in an exact join. Of texts
that share a shortest prefix only links inside a component, which change nothing, are left
unlooked at; texts that share none are never compared, which over TREES prefixes of
DEPTHS[0] values has a chance below one in ten million at 80 per cent.

Equal word sequences are one node, so a group of copies costs one row. Nodes are numbered
in the order of their smallest doc_id. Components come from alternating star contraction
over confirmed links, in Spark, with written tables between rounds.

Defined results for odd input: texts without words have an empty set and no links; a row
without doc_id is its own component, with a null component_id; rows that repeat a doc_id
are judged each by its own text, so two that are not linked can both bear their doc_id as
component_id; of kept rows that are linked and repeat a doc_id `deduplicated` keeps one;
columns of the caller stay, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import digest_column, releasing, scratch, small_batches, stored, table

SHINGLE = 4
SIMILARITY = 80  # per cent
PERMUTATIONS = 128
TREES = 32
DEPTHS = (4, 8, 16, 32)
LARGE_REGION = 2048
ALL_PAIRS = 16
NEIGHBOURS = 2
BEST = 2
SEED = 11
TALLY_BITS = 20
SPLIT = 2000
TURNS = 2
BITS = ("bits0", "bits1", "bits2", "bits3")
RARE = ("shingle", "place", "id", "n", *BITS)

SIGNED = "id long, mark long, n_shingles long, class binary, signature binary, body binary"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 2**63, (2, PERMUTATIONS), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def _signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Big-endian, so that bytes sort as numbers."""
    least = np.full(PERMUTATIONS, 2**32 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        h = (found[i : i + 1024, None] * a + b) >> np.uint64(32)
        least = np.minimum(least, h.min(axis=0))
    return least.astype(">u4").tobytes()


def _signer(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            ids, marks, texts = batch.columns
            for i, j, data, offsets in bytescan.text_slices(texts):
                data = bytescan.lower(data)
                starts, ends, first = bytescan.words(data, offsets)
                hashes, _ = bytescan.word_hashes(data, offsets)
                sizes, classes, signatures, bodies = [], [], [], []
                raw = data.tobytes()
                for k in range(j - i):
                    own = hashes[first[k] : first[k + 1]]
                    found = bytescan.shingles(own, shingle)
                    sizes.append(len(found))
                    classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    signatures.append(_signature(found, a, b) if len(found) else None)
                    bodies.append(pack.compress(raw[offsets[k] : offsets[k + 1]]) if len(found) else None)
                made = [pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (classes, signatures, bodies))]
                names = ["id", "mark", "n_shingles", "class", "signature", "body"]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), marks.slice(i, j - i), *made], names)

    return sign


def signed(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, mark, n_shingles, class, signature, body): mark tells texts apart, class word sequences."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return source.mapInArrow(releasing(_signer(shingle)), SIGNED)


def _found(body: bytes, shingle: int) -> np.ndarray:
    """The shingles of a stored text."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(body), np.uint8)
    return bytescan.shingles(bytescan.word_hashes(data, np.array([0, len(data)]))[0], shingle)


def _confirmer(shingle: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def found(key: int, body: bytes) -> np.ndarray:
            if key not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[key] = _found(body, shingle)
            return kept[key]

        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                p, q = found(a[i], x[i]), found(b[i], y[i])
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def confirmed(pairs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links on their full sets; nodes has id and body."""
    left, right = nodes.select(F.col("id").alias("a"), F.col("body").alias("x")), nodes.select(F.col("id").alias("b"), F.col("body").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(releasing(_confirmer(shingle, percent)), "a long, b long")


def _prefix(depth: int):
    """Hash of tree number and the first `depth` values of its order."""
    width = 4 * PERMUTATIONS
    start = F.col("tree") * (width // TREES)
    turned = F.concat("signature", "signature")
    return F.xxhash64("tree", F.substring(turned, start + 1, F.lit(4 * depth)))


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, id, size): regions of 2 to LARGE_REGION nodes, or the deepest ones whatever their size.

    And (region, id) of the shortest-prefix regions that don't offer all their pairs.
    """
    rows = nodes.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    parts, large, above = [], None, 0
    for depth in DEPTHS:
        keyed = rows.withColumn("region", _prefix(depth))
        if large is not None:
            keyed = keyed.withColumn("above", _prefix(above)).join(large, "above", "left_semi")
        keyed = keyed.select("region", "id")
        sizes = stored(keyed.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1"), f"sizes{depth}")
        final = sizes if depth == DEPTHS[-1] else sizes.filter(F.col("size") <= LARGE_REGION)
        parts.append(keyed.join(final, "region"))
        if large is None:
            wide = stored(keyed.join(sizes.filter(F.col("size") > ALL_PAIRS).select("region"), "region", "left_semi"), "wide")
        large = sizes.filter(F.col("size") > LARGE_REGION).select(F.col("region").alias("above"))
        above = depth
        if large.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out, "regions"), wide


def offered(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, weight): candidate pairs and how many trees offer them."""

    def ahead(rows: DataFrame, by: Window, most: int) -> DataFrame:
        rows = rows.select("id", *(F.lead("id", k).over(by).alias(f"n{k}") for k in range(1, most + 1)))
        return rows.select("id", F.explode(F.array_compact(F.array(*(f"n{k}" for k in range(1, most + 1))))).alias("other"))

    small = Window.partitionBy("region").orderBy("id")
    few = members.filter(F.col("size") <= ALL_PAIRS)
    few = ahead(few, small, ALL_PAIRS - 1)
    many = members.filter(F.col("size") > ALL_PAIRS).join(nodes.select("id", "signature", "n_shingles"), "id")
    # the deepest regions can be of any size: their orders are cut into parts, other ones in each tree
    cut = F.when(F.col("size") > LARGE_REGION, F.pmod(F.xxhash64("region", "id"), F.ceil(F.col("size") / LARGE_REGION))).otherwise(F.lit(0))
    many = many.withColumn("part", cut)
    sort = Window.partitionBy("region", "part").orderBy("signature", "n_shingles", "id")
    many = ahead(many, sort, NEIGHBOURS)
    both = few.unionByName(many).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("weight"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): each node with a link, and the smallest node it reaches.

    Alternating large-star and small-star rounds; a round is a minimum per node and a
    join back, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        star = star.filter("a <> b").distinct()
        down = star.groupBy("b").agg(F.min("a").alias("m"))
        next_ = star.join(down, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = stored(next_.filter("a <> b").distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels."""
    a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("p")), labels.select(F.col("id").alias("b"), F.col("label").alias("q"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def _tally(shingle: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TALLY_BITS, np.int64)
        for batch in batches:
            found = [_found(body, shingle) for body in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - TALLY_BITS)).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        for i in range(0, len(some), 1 << 16):
            at = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return tally


def _rarest(shingle: int, percent: int, counts):
    """The shingles of which two texts that are links share at least one, rarest first by their slot's count."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = (c.to_pylist() for c in batch.columns)
            out: list[list[np.ndarray]] = [[] for _ in RARE]
            for id_, body in zip(ids, bodies):
                found = _found(body, shingle)
                n = len(found)
                rank = counts.value[(found >> np.uint64(64 - TALLY_BITS)).astype(np.int64)]
                first = np.lexsort((found, rank))[: n - (percent * n + 99) // 100 + 1]
                place = np.flatnonzero(rank[first] > 1)  # no other text has one that counts once
                odd = np.packbits(np.bincount((found >> np.uint64(16)).astype(np.int64) % (64 * len(BITS)), minlength=64 * len(BITS)) % 2 == 1).view(np.int64)
                for to, column in zip(out, (found[first[place]].view(np.int64), place, *(np.full(len(place), v) for v in (id_, n, *odd)))):
                    to.append(column)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], list(RARE))

    return rarest


def rarest(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of each member (id, body) the shingles of which it shares one with any text that it is linked with.

    With the place of the shingle, the number of all and the parities of how many fall on
    each of some bits: as many bits as differ between two texts, so many shingles do at least.
    """
    spark = members.sparkSession
    slots = members.select("body").mapInArrow(releasing(_tally(shingle)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << TALLY_BITS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    kernel = releasing(_rarest(shingle, percent, spark.sparkContext.broadcast(counts)))
    return stored(members.select("id", "body").mapInArrow(kernel, ", ".join(f"{c} long" for c in RARE)), "rarest")


def _room(percent: int) -> Column:
    """How far a row's place leaves room for a link: of two rows that meet for a link, the sum is not below 0."""
    return (100 - percent) * F.col("n") - (100 + percent) * F.col("place")


def _mixed(rare: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """rare with the label of each id, for shingles with several labels; their commonest label, and into how many parts to deal them.

    Rows that leave no room for a link with any row of their shingle are left out. None if there is no such shingle.
    """
    rare = rare.join(labels, "id", "left").withColumns({"label": F.coalesce("label", "id"), "room": _room(percent)})
    per = rare.groupBy("shingle", "label").agg(F.count("*").alias("rows"), F.max("room").alias("most"), F.min("n").alias("least"))
    per = per.groupBy("shingle").agg(
        F.max_by("label", F.struct("rows", "label")).alias("common"), F.sum("rows").alias("rows"), F.count("*").alias("labels"), F.max("most").alias("most"), F.min("least").alias("least"),
    ).filter("labels > 1 AND most >= 0")
    per = stored(per.select("shingle", "common", "most", "least", F.ceil(F.col("rows") / SPLIT).cast("int").alias("parts")), "shared")
    if per.isEmpty():
        return None
    enough = (100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("least"))
    return rare.join(per, "shingle").filter(enough & (F.col("room") + F.col("most") >= 0)).drop("most", "least")


def _fits(percent: int) -> Column:
    """Whether two texts, whose i-th and j-th rarest shingle is the first shared one, can be linked at all."""
    n, m, i, j = F.col("n"), F.col("n_"), F.col("place"), F.col("place_")
    apart = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in BITS)
    sizes = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))
    return (F.col("label") != F.col("label_")) & sizes & ((100 + percent) * apart <= (100 - percent) * (n + m))


def adjacent(mixed: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): of the texts with a shingle, those next to each other by size that have different labels; at most one per text and shingle."""
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts"))
    by = Window.partitionBy("shingle", "part").orderBy(*(("n", "place", "id") if turn % 2 else ("place", "n", "id")))
    other = {f"{c}_": F.lag(c).over(by) for c in ("id", "label", "n", "place", *BITS)}
    found = mixed.withColumn("part", part).withColumns(other).filter(_fits(percent))
    return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def meetings(mixed: DataFrame) -> DataFrame:
    """The rows of each shingle that meet: those outside its commonest label with all that leave room together with them.

    Two rows without room of their own never do, so they don't meet at all. All are dealt
    out to parts if there are many.
    """
    columns = ["id", "label", "n", "place", *BITS]
    sides = F.when(F.col("room") >= 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    x = mixed.filter("label <> common").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("side", F.explode(sides)).select("shingle", "part", "side", *columns)
    y = mixed.withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "side": (F.col("room") >= 0).cast("int")})
    return x.join(y.select("shingle", "part", "side", *(F.col(c).alias(f"{c}_") for c in columns)), ["shingle", "part", "side"])


def crossing(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of texts of different labels, among them all that are links.

    Texts are links only if they share one of their rarest shingles, in any order of all
    shingles that is the same for both; the place of the first shared one and the bits
    bound how much they can share.
    """
    return meetings(mixed).filter(_fits(percent)).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def linked(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(id, label) for the nodes that have links. nodes has id, owner (a doc_id), class, n_shingles
    and signature; texts has id, class and body of the owners at least."""
    members, wide = regions(nodes)
    pairs = stored(offered(members, nodes), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(wide.select(F.col("id").alias("node"))).distinct()
    ends = ends.join(nodes.select(F.col("id").alias("node"), F.col("owner").alias("id"), "class", "n_shingles"), "node")
    bodies = texts.select("id", "class", "body").join(ends, ["id", "class"]).dropDuplicates(["id", "class"])
    bodies = stored(bodies.select(F.col("node").alias("id"), "n_shingles", "body"), "bodies")

    ways = pairs.select(F.col("a").alias("from"), F.col("b").alias("to"), "weight").unionByName(pairs.select(F.col("b").alias("from"), F.col("a").alias("to"), "weight"))
    rank = F.row_number().over(Window.partitionBy("from").orderBy(F.desc("weight"), "to"))
    best = ways.withColumn("r", rank).filter(F.col("r") <= BEST).select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
    best = stored(best, "best")
    links = stored(confirmed(best, bodies, shingle, percent), "links")
    labels = stored(components(links), "labels")

    def added(candidates: DataFrame, name: str) -> None:
        """Links among the candidates join the others; where there are none, the components stay."""
        nonlocal labels
        candidates = stored(candidates, name)
        if candidates.isEmpty():
            return
        more = stored(confirmed(candidates, bodies, shingle, percent), "links")
        if not more.isEmpty():
            known = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
            labels = stored(components(known.unionByName(more)), "labels")

    added(_apart(pairs.join(best, ["a", "b"], "left_anti"), labels), "rest")
    wide = wide.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = stored(wide.groupBy("region").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("region"), "mixed")
    if not mixed.isEmpty():
        apart = stored(wide.join(mixed, "region", "left_semi").select("id").distinct().join(bodies.select("id", "body"), "id"), "apart")
        rare = rarest(apart, shingle, percent)
        # neighbours first: what they merge need not meet pair by pair
        for turn in range(TURNS + 1):
            left = _mixed(rare, labels, percent)
            if left is None:
                break
            if turn < TURNS:
                added(adjacent(left, percent, turn), "adjacent")
            else:
                added(crossing(left, percent).join(pairs, ["a", "b"], "left_anti"), "last")
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(id, mark, n_shingles, component, component_id, kept), one row per row of docs.

    mark is xxhash64 of the text; component numbers the groups of linked texts and is null
    for rows that can have no links.
    """
    with scratch(docs.sparkSession) as keep:
        every = stored(signed(docs, key, text, shingle), "signed")
        first = every.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("class").agg(F.min("id").alias("id"))
        first = stored(first.orderBy("id", "class").withColumn("node", F.monotonically_increasing_id()), "classes")
        nodes = every.select("id", "class", "n_shingles", "signature").join(first, ["id", "class"]).dropDuplicates(["id", "class"])
        nodes = stored(nodes.select(F.col("node").alias("id"), F.col("id").alias("owner"), "class", "n_shingles", "signature"), "nodes")
        labels = linked(nodes, every, shingle, percent)
        classes = first.select("class", "node").join(labels.select(F.col("id").alias("node"), "label"), "node", "left")
        classes = classes.select("class", F.coalesce("label", "node").alias("component"))
        classes = classes.join(first.select(F.col("node").alias("component"), F.col("id").alias("component_id")), "component")
        out = every.select("id", "mark", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("class")).alias("class"))
        out = out.join(classes, "class", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
        return keep(out.select("id", "mark", "n_shingles", "component", "component_id", kept), "near-duplicates")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """One row of docs of each component, that with the smallest key, and all rows that have no links."""
    found = near_duplicates(docs.select(key, text), key, text, shingle, percent)
    mark = digest_column("_mark", docs.columns)
    gone = found.filter(~F.col("kept")).select(F.col("id").alias(key), F.col("mark").alias(mark))
    # kept rows that repeat a key within a component: one text stays, and one row of it
    heads = found.filter("kept AND component IS NOT NULL").groupBy("component", "id").agg(F.count("*").alias("n"), F.min("mark").alias("least"))
    heads = stored(heads.filter("n > 1"), "heads")
    again = not heads.isEmpty()
    if again:
        more = found.filter("kept").join(heads, ["component", "id"]).filter(F.col("mark") != F.col("least"))
        gone = gone.unionByName(more.select(F.col("id").alias(key), F.col("mark").alias(mark)))
    out = docs.withColumn(mark, F.xxhash64(text)).join(gone.distinct(), [key, mark], "left_anti")
    if again:
        twice = heads.select(F.col("id").alias(key), F.col("least").alias(mark)).distinct()
        once = out.join(twice, [key, mark], "left_semi").dropDuplicates([key, mark])
        out = out.join(twice, [key, mark], "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def oracle() -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SIMILARITY} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.c AS component_id, doc_id = c.c AS kept
FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = s.doc_id
"""
