"""Ranked search against brute force, what MaxScore leaves unread, an index that is asked again, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from motionlake.llm import search
from motionlake.llm.common import stored
from motionlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k=10):
    """(item, rank, key, score) by scoring every document for every item."""
    own = [(key, Counter(terms_of(text))) for key, text in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for key, c, size in own:
            m = 10 + (90 * size * n) // length
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item, r["rank"], r.key, r.score) for r in df.collect()), key=repr)


def zipf(rng, n, most):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(n, most)))


def test_search_equals_brute_force(spark, monkeypatch):
    """Many shards, blocks of documents and of items."""
    rng = random.Random(2)
    docs = [(i, zipf(rng, 0, 120)) for i in range(600)] + [(600 + i, "same words for all of these") for i in range(40)]
    items = [(f"i{i}", zipf(rng, 1, 30)) for i in range(25)] + [("none", "zzz"), ("same", "words of these")]
    df, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = plain(docs, items)
    index = stored(search.inverted(df, postings=900, step=2000), "index")
    assert index.filter("term IS NULL").count() > 8
    assert rows(search.searched(index, queries)) == want
    monkeypatch.setattr(search, "ITEMS", 4)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert rows(search.searched(index, queries)) == want
    again = [("other", zipf(rng, 5, 9)), ("i3", "w1 w2")]  # other items, the same index
    assert rows(search.searched(index, spark.createDataFrame(again, "item_id string, text string"), k=3)) == plain(docs, again, 3)


def test_lists_that_are_not_essential_are_only_probed(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 100)
    rng = np.random.default_rng(0)
    size, blocks = 10_000, np.arange(101) * 100
    common = search.List(np.arange(size), rng.integers(1, 50, size), blocks)
    rare_rows = np.sort(rng.choice(size, 300, replace=False))
    rare = search.List(rare_rows, rng.integers(900, 1000, 300), blocks)
    order = np.arange(size)
    found, scores, probed = search.best_of([(common, 1), (rare, 10)], order, size)
    total = common.impact.copy()
    total[rare_rows] += rare.impact * 10
    want = np.lexsort([order, -total])[:10]
    assert found.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert 0 < probed < 400  # of ten thousand postings of the common term


def test_ties_go_to_smaller_ids_over_shards(spark):
    docs = [(i, "one two") for i in (9, 3, 7, 1, 5, 2, 8, 4, 6, 0, 11, 10)] + [(99, "three")]
    index = search.inverted(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), postings=2, step=8)
    got = search.searched(stored(index, "index"), spark.createDataFrame([("q", "two")], "item_id string, text string"))
    assert [r.key for r in got.orderBy("rank").collect()] == list(range(10))


def test_odd_rows(spark):
    docs = [(None, None), (None, "Alpha beta"), (1, ""), (2, "...!"), (3, "alpha"), (3, "alpha"), (3, "beta BETA é_é"), (4, "x" * 100_000), (5, "alpha " * 5000)]
    items = [("a", "ALPHA"), ("a", "é"), ("empty", ""), ("null", None), (None, "beta"), ("b", "x" * 100_000)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, term int, Keys string")
    queries = spark.createDataFrame([(*i, 2) for i in items], "item_id string, text string, ask int")
    assert rows(search.searched(stored(search.inverted(df), "index"), queries)) == plain(docs, items)
    empty = stored(search.inverted(df.limit(0)), "index")
    assert search.searched(empty, queries).count() == 0
    assert search.searched(stored(search.inverted(df), "index"), queries.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_keys_of_both_kinds(spark, kind):
    df = spark.createDataFrame([(str(i), "word " * i) for i in range(1, 15)], "k string, body string").selectExpr(f"CAST(k AS {kind}) AS k", "body")
    got = search.searched(stored(search.inverted(df, "k", "body"), "index"), spark.createDataFrame([(1, "word")], "n long, t string"), "n", "t")
    assert got.schema["key"].dataType.simpleString() == {"string": "string", "long": "bigint"}[kind] and got.count() == 10 and got.schema["item"].dataType.simpleString() == "bigint"


def test_op11_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op11_maxscore_search"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items)
