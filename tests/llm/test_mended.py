"""What grew with the square of a group, lost shares of links, thresholds in step, columns that the pipeline keeps."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionlake.llm import near_dedup, pieces, url_filters
from motionlake.llm.common import stored

SF = "/root/testdata/sf0.001"


def family(n, changed, words=120, seed=1):
    """Texts that each differ from one base in `changed` words of their own."""
    rng = random.Random(seed)
    base = [f"base{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(2, words - 2, 5), changed):
            text[at] = f"own{k}x{at}"
        out.append((k, " ".join(text)))
    return out


def met(spark, rows):
    """(rows that can be looked up, pairs that meet) when all of a family are apart."""
    every = stored(near_dedup.signed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", near_dedup.SHINGLE), "signed")
    rare = near_dedup.rarest(every.select("id", "body"), near_dedup.SHINGLE, near_dedup.SIMILARITY)
    labels = every.select("id", F.col("id").alias("label"))
    mixed = near_dedup._mixed(rare, labels, near_dedup.SIMILARITY)
    return rare.count(), 0 if mixed is None else near_dedup.meetings(mixed).count()


def test_a_family_without_links_does_not_meet_pair_by_pair(spark):
    few, pairs = met(spark, family(500, 4))
    many, more = met(spark, family(2000, 4))
    assert many > 3 * few > 0
    assert more <= 1.5 * max(pairs, 1) * many / few and more < 4 * many


def test_families_keep_their_links(spark, monkeypatch):
    """Links of texts at all distances from a base, some above and some below the bound, found by the exact join too."""
    monkeypatch.setattr(near_dedup, "LARGE_REGION", 8)
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", 2)
    rows = [r for c in range(1, 5) for r in family(25, c, words=100, seed=c)]
    rows = [(i, t if i % 3 else t + " " + " ".join(f"tail{i}w{j}" for j in range(i % 30))) for i, (_, t) in enumerate(rows)]
    sets = {}
    for k, t in rows:
        w = t.split()
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert links > 50 and {r["id"]: r.component_id for r in got} == {k: root(k) for k in sets}


def test_shares_of_hubs_are_not_lost(spark):
    """One link beside three millions hands on its part of the rank."""
    edges = spark.createDataFrame([("hub", "many", 3_000_000), ("hub", "one", 1)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("trust", "hub")], "kind string, host string")
    got = {r.host: r["rank"] for r in url_filters.ranks(edges, seeds, rounds=1).collect()}
    assert got["one"] == url_filters.SCALE // 3_000_001 * 85 // 100 and got["many"] > 0.84 * url_filters.SCALE


@pytest.mark.parametrize("blocked", [30, 2000])
def test_op8_query_and_sql_agree_for_any_number_of_blocked_hosts(spark, tmp_path, blocked):
    rows = [(i, f"http://b{i}.org/es/{i}", "") for i in range(blocked)]
    rows += [(10_000 + i, f"http://friend{i}.info/x", f'<a href="http://b{i}.org/es/{i}">b</a>') for i in range(blocked)]
    rows += [(30_000, "http://lone.info/", '<a href="//friend1.info/x">a</a>'), (30_001, None, None), (30_002, "http://good.net/de/1", '<a href="http://friend2.info/x">g</a>')]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = sorted(map(tuple, url_filters.op8_link_trust(spark, folder).select("page_id", "host", "path", "rule", "trust", "distrust", "verdict").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, trust, distrust, verdict FROM ({url_filters.oracle()})").fetchall())
    assert got == want
    by = {r[0]: r[-1] for r in got}
    assert by[10_005] == "block" and by[30_002] == "allow" and by[0] == "block"


def test_pieces_say_whether_they_decode_to_the_text(spark):
    rows = [(1, "hello  world", "a"), (2, "", None), (3, None, "c"), (4, "▁mark é日\n😀", "d")]
    out = pieces.coded(spark.createDataFrame([(*r, 7) for r in rows], "id long, text string, extra string, PIECES int"))
    assert out.columns == ["id", "extra", "pieces", "round_trip"]
    got = {r.id: r for r in out.collect()}
    assert all(r.round_trip for r in got.values()) and got[2].pieces == [] and got[1].extra == "a"


def test_the_pipeline_keeps_columns_of_the_caller(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"note": F.concat(F.lit("n"), "doc_id"), "Row": F.lit(1), "terms": F.lit("t"), "round_trip": F.lit(5)})
    docs.drop("source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "lang", "n_chars", "note", "Row", "terms", "pieces", "round_trip"}
    rows = out.collect()
    assert rows and all(r.note == f"n{r.doc_id}" and r.round_trip is True and r.pieces for r in rows)
