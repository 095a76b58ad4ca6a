"""Token counts against the tokenizer's library, resampling against plain Python, odd rows of both."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from motionlake.llm import resampling, token_counts
from motionlake.llm.pieces import MODEL, merged, model_bytes
from motionlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    found = ["", " ", "  ", "a", " hello  world ", "a" * 333, "日本語テキスト と中文", "😀😀 é\n\n\tx\x00y", "▁▁a ▁b", "<s> </s> <unk> <0x0A>", " " * 50 + "x" + " " * 33, "ab" * 500]
    for _ in range(n):
        found.append("".join(rng.choice("abcdeinrst  ▁.=-_0123ABé日😀\n") for _ in range(rng.randrange(60))))
        found.append("".join(rng.choice(["the", "ing", " ", "er", "a", "  ", "=", "==", "0", "00", "\n", "in", "ed", "tion"]) for _ in range(rng.randrange(40))))
    return found


def test_transducer_counts_as_the_library(library):
    machine = token_counts.Transducer(model_bytes(MODEL))
    texts = odd_texts(500)
    assert [machine.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_forgetting_states_changes_nothing(library, monkeypatch):
    for name in ("STATES", "PAIRS", "PARTS"):
        monkeypatch.setattr(token_counts, name, 7)
    machine = token_counts.Transducer(model_bytes(MODEL))
    texts = odd_texts(60, 4)
    assert [machine.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_new_words_need_few_new_moves(library, monkeypatch):
    """Invented words, none seen before: their moves are those that earlier ones have compiled."""
    rng = random.Random(7)
    parts = "the in er on an re ed sch ung tion ció os ent ich eau que ó ß ly he at ar zz".split()
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(2, 7))) for _ in range(12_000)})
    rng.shuffle(words)
    made, move = [], token_counts.Transducer.move
    monkeypatch.setattr(token_counts.Transducer, "move", lambda *args: made.append(1) or move(*args))
    machine = token_counts.Transducer(model_bytes(MODEL))
    half = len(words) // 2
    machine.count(" ".join(words[:half]))
    made.clear()
    assert machine.count(" ".join(words[half:])) == len(library.encode(" ".join(words[half:])))
    assert len(made) < half / 10


def test_long_parts_are_not_kept(library):
    machine = token_counts.Transducer(model_bytes(MODEL))
    text = f"a {'日本' * 5000} b {'ab' * 30} {'xy' * 900} c"
    assert machine.count(text) == len(library.encode(text))
    assert len(machine.parts) == 2 and max(map(len, machine.parts)) <= 64


def test_joins_as_merging_does():
    """Pairs of pieces of random vocabularies, with equal ranks and merges better than those they build on."""
    rng = random.Random(8)
    machine = token_counts.Transducer(model_bytes(MODEL))
    for _ in range(60):
        machine.rank = {c: 0.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))): float(rng.randrange(12)) for _ in range(25)}
        machine.beside, machine.merges = {p[n : n + 2] for p in machine.rank for n in range(len(p) - 1)}, {}
        for b in machine.rank:
            assert machine.joins("", b) == (merged(b, machine.rank) == [b])
            for a in machine.rank:
                assert machine.joins(a, b) == (merged(a + b, machine.rank) == [a, b]), (a, b, machine.rank)


def test_chunk_maps_compose(spark, library):
    """Texts with and without spaces, cut far below their length, in three levels of composition."""
    rng = random.Random(5)
    texts = [t for t in odd_texts(20, 6) if t] + ["a" * 3001, "xyz日本" * 700, "".join(rng.choice("abcde") for _ in range(4000)), "one two  three " * 300, "=" * 999 + " " + "0" * 999]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = token_counts.counted(df, chunk=50, fan=3)
    assert {r.id: r.n_tokens for r in out.collect()} == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_maps_that_do_not_fit_are_counted_whole(spark, library, monkeypatch):
    maps = token_counts.chunk_maps

    def broken(*args):
        return maps(*args).withColumn("map", F.when(F.col("chunk") == 1, F.array().cast(token_counts.MAP)).otherwise(F.col("map")))

    monkeypatch.setattr(token_counts, "chunk_maps", broken)
    df = spark.createDataFrame([(1, "word " * 100), (2, "x"), (3, "y" * 90)], "id long, text string")
    assert {r.id: r.n_tokens for r in token_counts.counted(df, chunk=40).collect()} == {1: len(library.encode("word " * 100)), 2: 1, 3: len(library.encode("y" * 90))}


def test_op12_counts_every_document(spark, library):
    got = {r.doc_id: r for r in QUERIES["op12_transducer_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or ""))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 4096)


def test_counts_of_odd_rows(spark, library):
    rows = [(None, None, "x", 9), (1, "", "x", 9), (1, "two words", None, 9), (1, "two words", None, 9), (1, "other", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _whole string, N_Tokens int")
    out = token_counts.counted(df)
    assert out.columns == ["doc_id", "text", "_whole", "n_tokens"]
    assert sorted((r.text or "", r.n_tokens) for r in out.collect()) == sorted((t or "", len(library.encode(t or ""))) for _, t, _, _ in rows)
    assert token_counts.counted(df.limit(0)).count() == 0
    assert token_counts.counted(df, keep=[]).columns == ["n_tokens"]


# -- resampling ------------------------------------------------------------------------------


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def runs_of(words):
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, percent, least, seed, buckets):
    """(id, n_features, weight, score, rank) of each (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs_of(words_of(text))))
    for text in target:
        t.update(map(bucket, runs_of(words_of(text))))
    all_s, all_t, rows = sum(s.values()), sum(t.values()), []
    for key, text in docs:
        words = words_of(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, runs_of(words))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([key, len(gains), weight, score, None, len(words)])
    pool = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("length", [0, 1, 2, 7, 8, 63, 1000, 65537])
def test_shift_is_as_many_zero_bytes(length):
    before, after = b"some text", b"x" * length
    crc = np.array([zlib.crc32(before)], np.uint32)
    assert int(resampling.mapped(resampling.shift(length), crc)[0]) ^ zlib.crc32(after) == zlib.crc32(before + after)


def test_composed_crcs_are_those_of_the_strings():
    rng = random.Random(1)
    texts = ["", "one", "Two words", "é日 " + "q" * 200 + " r" + "s" * 47 + " " + "t" * 48, *(" ".join("".join(rng.choice("abÉz09") for _ in range(rng.randrange(1, 60))) for _ in range(50)) for _ in range(5))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for size, (bucket, inside, _) in enumerate(resampling.features(data, offsets, 10_000, 4), 1):
        want = [zlib.crc32(" ".join(w[i : i + size]).encode()) % 10_000 for w in map(words_of, texts) for i in range(len(w) - size + 1)]
        assert bucket[inside].tolist() == want


def test_resampling_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op13_crc_resampling"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, target, 25, 20, 7, 10_000))


def test_resampling_of_odd_rows(spark):
    long = "Some words " * 40
    rows = [(None, None), (None, long), (1, ""), (2, "..."), (3, long), (3, long), (3, long), (4, long + "more"), (5, "é " * 19), (6, "é " * 20)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, text string, _tie int, N_Words string")
    target = spark.createDataFrame([("some words",), (None,)], "text string")
    out = resampling.resampled(df, target, "id", percent=60)
    assert out.columns[:3] == ["id", "text", "_tie"] and set(out.columns[3:]) == {"n_words", "n_features", "weight", "score", "rank"}
    got = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(plain(rows, ["some words", None], 60, 20, 7, 10_000), key=key)
    assert resampling.resampled(df.limit(0), target, "id").count() == 0
    assert {r.weight for r in resampling.resampled(df.filter("id = 1"), target.limit(0), "id").collect()} == {0}
