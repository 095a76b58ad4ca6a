"""Operators that SQL can't express against plain Python, and rows that are odd in every way."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionlake.llm import decontaminate, langid, near_dedup, pieces, quality, secrets, sharding, suffix_dedup, url_filters, warc

SF = "/root/testdata/sf0.001"


def plain_tail(z):
    z = max(-8.0, min(8.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def plain_p(token):
    """p-value of a token under the first encoding that it fits."""
    core = token.rstrip("=")
    alphabet = next((a for _, a, form in secrets.ENCODINGS if re.search(form, core)), None)
    if alphabet is None:
        return None
    size, n, v = len(alphabet), len(core), [float(alphabet.index(c)) for c in core]
    x2, df = size / n * sum(v.count(x) ** 2 for x in set(v)) - n, size - 1
    chi = plain_tail(((max(x2, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    up = [x >= size / 2 for x in v]
    mean = 2 * sum(up) * (n - sum(up)) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    turns = 1 + sum(a != b for a, b in zip(up, up[1:]))
    runs = 2 * plain_tail(abs(turns - mean) / math.sqrt(var)) if var > 0 else 0.0
    m = sum(v) / n
    ss = sum((x - m) ** 2 for x in v)
    serial = 2 * plain_tail(abs(sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / ss) * math.sqrt(n)) if ss else 0.0
    a, b, c = sorted((chi, runs, serial))
    return min(3 * a, 1.5 * b, c)


def plain_spans(texts):
    """Per text (start, kind, end) of all spans."""
    base, tokens = [], []
    for t in texts:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m.group(2)) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
        base.append(found)
        tokens.append([(m.start(), m.end(), plain_p(m.group())) for m in re.finditer(secrets.TOKEN, t) if re.search("[0-9]", m.group())])
        tokens[-1] = [x for x in tokens[-1] if x[2] is not None]
    every = [x for ts in tokens for x in ts]
    mean = sum(e - s for s, e, _ in every) / len(every) if every else 1.0
    bins = sorted((min(math.floor(-math.log(max(p * mean / (e - s), 1e-30)) * 16), secrets.BINS - 1) for s, e, p in every), reverse=True)
    limit = 0.0
    for k, b in enumerate(bins):
        if (k + 1 == len(bins) or bins[k + 1] != b) and math.exp(-b / 16) * len(bins) <= secrets.FALSE_DISCOVERY * (k + 1):
            limit = math.exp(-b / 16)
    out = []
    for found, ts in zip(base, tokens):
        fresh = [(s, 3, e) for s, e, p in ts if p * mean / (e - s) > limit and not any(a < e and s < z for a, _, z in found)]
        out.append(sorted(found + fresh))
    return out


def secret_texts():
    rng = random.Random(21)
    b64, b32 = secrets.ENCODINGS[3][1], secrets.ENCODINGS[2][1]
    out = [None, "", "plain words only", "xy password: hunter22 "]
    for k in range(120):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            words.append(rng.choice([
                "".join(rng.choice(b64) for _ in range(rng.randrange(24, 70))),
                "".join(rng.choice(b32) for _ in range(rng.randrange(26, 60))),
                "".join(rng.choice("0123456789ABCDEF") for _ in range(40)),
                "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(20, 50))),
                "TheQuickBrownFoxJumpsOverTheLazyDog" + str(k), "aB1" * rng.randrange(9, 20), "abcdefghijklmnopqrstuvwxyzABCDEFGH1234",
                'api_key = "' + "".join(rng.choice(b64) for _ in range(30)) + '"', "token:short", "AKIA" + "Z9" * rng.randrange(5, 12),
            ]))
        rng.shuffle(words)
        out.append(" ".join(words))
    out.append(" ".join("secret=abcdef%d" % i for i in range(700)))  # more parts than a block holds
    return out


def test_secrets_against_brute_force(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.spans(secrets.scanned(docs))
    got = {r.doc_id: [(x.s, x["rank"], x.e) for x in r.spans] for r in found.collect()}
    want = plain_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    kinds = [k for spans in want for _, k, _ in spans]
    tokens = sum(len(re.findall(secrets.TOKEN, t or "")) for t in texts)
    assert all(kinds.count(k) > 3 for k in range(4)) and kinds.count(3) < tokens


def plain_language(model, text):
    """(index of the language, score) by loops over the text's n-grams."""
    raw = [int(langid._CLASS[b]) for b in text.encode()]
    x = [0.0] * langid.DIMENSIONS
    for n in langid.GRAMS:
        for i in range(len(raw) - n + 1):
            code = 0
            for b in raw[i : i + n]:
                code = (code * 257 + b + 1) % 2**32
            x[((code * 2654435761 + n * 40503) % 2**32 >> 7) % langid.DIMENSIONS] += 1
    x = [math.sqrt(c) for c in x]
    length = math.sqrt(sum(c * c for c in x))
    margins = [sum(c / length * float(w) for c, w in zip(x, model.weights[:, b])) + float(model.bias[b]) for b in range(model.code.shape[1])]
    loss = [sum(float(t) * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust[k], margins, model.code[k])) for k in range(len(model.languages))]
    near = [math.exp(-(v - min(loss)) * len(margins)) for v in loss]
    return loss.index(min(loss)), max(near) / sum(near)


def test_language_decoding_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    rows = docs.filter(F.length("text").between(20, 600)).orderBy("doc_id").limit(12)
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r for r in langid.predicted(rows, model, keep=["doc_id"]).collect()}
    assert len(got) == 12
    for k, text in texts.items():
        best, score = plain_language(model, text)
        if got[k].lang_pred != langid.UNKNOWN:
            assert got[k].lang_pred == model.languages[best] and got[k].score == pytest.approx(score, abs=1e-3)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_kept(rows, size, percent=near_dedup.SIMILARITY):
    """The rows (id, text) of which one stays for each component of linked texts."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    kept = {}
    for k, row in enumerate(rows):
        kept.setdefault(find(k) if sets[k] else (k, "alone"), row)
        kept[find(k) if sets[k] else (k, "alone")] = min(kept[find(k) if sets[k] else (k, "alone")], row, key=lambda r: r[0])
    return sorted(kept.values())


def in_benchmark(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    own = words(text)
    for item in items:
        w = words(item)
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        if any(tuple(own[i : i + n]) in wins for i in range(len(own) - n + 1)):
            return True
    return False


def hidden(text, spans):
    out, at = "", 0
    for s, _, e in spans:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_against_plain_python(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    long_ = [r for r in rows if r.text and len(r.text.split()) > 40]
    more = [(10_000 + k, r.text + " tail", r.lang, r.source, 0) for k, r in enumerate(long_[:15])]
    more += [(rows[0].doc_id, long_[20].text[::-1], "en", "x", 0), (20_000, long_[21].text, "en", "x", 0), (20_000, long_[21].text, "en", "x", 0)]
    more += [(30_000, long_[22].text + " secret = abcdef123456", "en", "x", 0), (-5, "", None, None, None), (-6, None, None, None, None), (-7, "12 34", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    known = langid.predicted(docs, langid.train(docs)).filter(f"NOT ambiguous AND lang_pred <> '{langid.UNKNOWN}'").select("row.doc_id", "row.text").collect()
    left = near_kept([(r.doc_id, r.text) for r in known], corpus_pipeline.SHINGLE)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(k, t) for k, t in left if not in_benchmark(t, items)]
    spans = plain_spans([t for _, t in left])
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((k, sp.encode(hidden(t, s))) for (k, t), s in zip(left, spans))
    got = sorted((r.doc_id, r.pieces) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert got == want and len(want) < len(known) - 15


def test_near_recall_with_boilerplate(spark):
    """Every component of a table in which most of each text is the same few passages."""
    rng = random.Random(31)
    blocks = [[f"b{k}x{i}" for i in range(40)] for k in range(6)]
    rows = []
    for k in range(900):
        own = [f"u{k}y{i}" for i in range(rng.randrange(4, 40))]
        rows.append((k, " ".join([w for b in rng.sample(blocks, rng.randrange(1, 6)) for w in b] + own)))
    want = {}
    for a, b in ((k, t) for k, t in rows):
        want[a] = b
    kept = [k for k, _ in near_kept(rows, near_dedup.SHINGLE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["id"] for r in near_dedup.near_duplicates(docs).filter("kept").collect())
    assert got == kept and 10 < len(kept) < 890


CLASH = [
    "_words", "_lines", "_hashes", "row", "key", "_row", "mark", "_mark", "terms", "_text", "_letter", "_all", "k", "d", "segment", "text_crc32", "_part", "_seq", "component", "id", "class",
]


@pytest.fixture(scope="module")
def clash(spark):
    """Null and repeated doc_ids, repeated rows, a text of half a million bytes, and columns named like ours."""
    rows = [
        (None, "some words that have no number and are read like all others here", "en"), (None, None, None), (1, "one two three four five", "en"), (1, "one two three four five", "en"),
        (1, "another text of the same number", "en"), (2, "", "de"), (3, "Größe über alles " * 30_000, "de"), (4, "password = abcdef123456", None),
    ]
    return spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH))


def same(df, clash, columns=CLASH):
    return sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, clash.select(*columns).collect()))


def test_clashing_columns_stay(spark, clash):
    assert same(quality.score(clash), clash)
    assert same(sharding.shards(clash, ["doc_id", "_seq"]), clash)
    assert same(pieces.decoded(pieces.encoded(clash)), clash)
    assert same(secrets.cleaned(clash), clash) and secrets.cleaned(clash).columns == clash.columns
    items = spark.createDataFrame([(1, "one two three four five"), (None, None)], "item_id long, text string")
    clean = decontaminate.clean(clash, items)
    assert clean.columns == clash.columns and clean.count() == 6
    near = near_dedup.deduplicated(clash)
    assert near.columns == clash.columns and near.count() == 7
    found = langid.predicted(clash, langid.train(clash), keep=["_text", "_letter", "doc_id"])
    assert same(found, clash, ["_text", "_letter"])
    assert langid.predicted(clash, langid.train(clash)).select("row.*").columns == clash.columns


def test_odd_rows_of_suffix_dedup(clash):
    got = suffix_dedup.deduplicated(clash).collect()
    assert len(got) == 8 and {r.n_removed for r in got if r["id"] != 3} == {0}
    assert all(r.n_bytes == r.n_removed == 0 for r in got if r["id"] == 2)


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.org/es/x", "p" * 2000), (None, None, "p" * 2000), (3, "http://b.net/de/", "p" * 2000), (3, "http://b.net/de/", "p" * 2000), (4, "x", None)]
    names = ["host", "trust", "rule", "data", "chunk_no", "last", "k", "d", "_response", "_least"]
    pages = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in names))
    judged = url_filters.judged(pages)
    assert judged.count() == 5 and {r["k"] for r in judged.collect()} == {f"k{i}" for i in range(5)}
    ends = warc.read_archives(warc.write_archives(warc.roles(pages, "html"))).filter("last").collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in ends) == [(0, "revisit", 3), (1, "revisit", 3), (3, "response", 0), (3, "response", 0), (4, "response", 0)]
    assert {r.record_id for r in ends if r.page_id == 3} != {r.record_id for r in ends if r.page_id == 1}


def test_long_payload_round_trip(spark):
    text = "".join(chr(97 + i % 26) for i in range(9_000)) * 400
    pages = spark.createDataFrame([(1, None, text)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(warc.roles(pages, "html")), with_data=True).orderBy("chunk_no").collect()
    assert len(rows) == -(-len(text) // warc.CHUNK) and b"".join(bytes(r.data) for r in rows).decode() == text


def test_stored_tables_go(spark, clash):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    near_dedup.near_duplicates(clash).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"near-duplicates"}


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    from motionlake.llm import common

    with pytest.raises(ValueError):
        common.shared_dir(Session(), "x")


def test_codewords_are_far_apart():
    code = langid.codewords(4)
    assert min(np.sum(code[a] != code[b]) for a in range(4) for b in range(a)) >= 4
