"""URL filters: rules on host and path, and trust propagated over the host link graph.

Hosts that an allow rule names are trusted seeds, hosts that a block rule names are
blocked seeds. Trust is personalised PageRank from the trusted seeds along links; distrust
is the same from the blocked seeds along reversed links, so hosts that link to blocked
ones take their share. A page without a rule is blocked if its host's distrust is at
least THRESHOLD, or with many blocked seeds a SEED_PART of what one of them starts with,
and more than its trust.

Ranks are whole numbers (shares of SCALE), so sums don't depend on their order and every
run gives the same verdicts. Links are counted per pair of hosts before anything is
joined; both walks are one join and one sum each round, and the ranks are written every
few rounds to cut their lineage.

Defined results for odd input: a null url or one without `://` has an empty host and
path, fits no rule, is no node of the graph and is allowed; null html has no links; pages
that repeat count each with their links; columns of the caller stay, other than those
named like results; an empty table gives no rows; without seeds everything without a rule
is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, digest_column, lower_ascii, scratch, stored, table

ROUNDS = 10
WRITE_EVERY = 5
DAMPING = 85  # per cent
SCALE = 10**12
#: A ten-thousandth of all distrust.
THRESHOLD = SCALE // 10_000
#: Seeds share SCALE, so that a fixed part of all is out of reach once there are many of them.
SEED_PART = 100
LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES: Sequence[Rule] = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """df (with host and path) and its longest fitting rule and that rule's verdict."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        rule = F.when(fits(r, host, path), r.text).otherwise(rule)
        verdict = F.when(fits(r, host, path), r.verdict).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): links between hosts; relative links stay on their host."""
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1)).alias("to")).filter("src <> ''")
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    dst = F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(full)).when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("src"))
    return found.select("src", dst.alias("dst")).filter("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def walks(edges: DataFrame) -> DataFrame:
    """(kind, a, b, links, total): of the `total` links that leave a, so many go to b."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "links")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "links"))
    total = both.groupBy("kind", "a").agg(F.sum("links").alias("total"))
    return both.join(total, ["kind", "a"]).select("kind", "a", "b", "links", "total")


def ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host); mass that finds no link is lost."""
    moves = stored(walks(edges).withColumnRenamed("a", "host"), "walks")
    counted = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    start = seeds.join(counted, "kind").select("kind", "host", F.call_function("div", F.lit(SCALE), F.col("n")).cast("long").alias("rank"))
    start = stored(start, "seeds")
    restart = start.select("kind", "host", F.call_function("div", F.col("rank") * (100 - damping), F.lit(100)).cast("long").alias("rank"))
    now = start
    for i in range(1, rounds + 1):
        wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  the product of a rank and its links needs more than a long
        part = F.call_function("div", wide("rank") * F.col("links").cast("decimal(19,0)"), wide("total")).cast("long")
        gone = now.join(moves, ["kind", "host"]).select("kind", F.col("b").alias("host"), F.call_function("div", part * damping, F.lit(100)).cast("long").alias("rank"))
        now = gone.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).filter("rank > 0")
        if i % WRITE_EVERY == 0 or i == rounds:
            now = stored(now, "ranks")
    return now


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", html: str = "html", threshold: int = THRESHOLD) -> DataFrame:
    """pages (without html) with host, path, rule, trust, distrust and verdict."""
    own = {"host", "path", "rule", "ruled", "trust", "distrust", "verdict"}
    named = pages.drop(html, *(c for c in pages.columns if c.lower() in own)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    named = ruled(named, rules)
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = named.filter(F.col("ruled").isNotNull() & (F.col("host") != "")).select(kind.alias("kind"), "host").distinct()
    rank = ranks(host_edges(pages, url, html), seeds)
    rank = rank.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0)).alias(k) for k in ("trust", "distrust")))
    least = digest_column("_least", named.columns)
    blocked = seeds.filter("kind = 'distrust'").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    blocked = blocked.select(F.least(F.lit(threshold), F.call_function("div", F.lit(SCALE), F.col("n") * SEED_PART)).alias(least))
    out = named.join(rank, "host", "left").fillna(0, ["trust", "distrust"]).crossJoin(F.broadcast(blocked))
    bad = (F.col("distrust") >= F.col(least)) & (F.col("distrust") > F.col("trust"))
    return out.withColumn("verdict", F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))).drop("ruled", least)


def op8_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    with scratch(spark) as keep:
        return keep(judged(pages).select("page_id", "host", "path", "rule", "trust", "distrust", "verdict"), "judged")


def oracle() -> str:
    rest = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract({rest(u)}, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"
    rules = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{i}}}"
        for i, r in sorted(enumerate(RULES), key=lambda x: (len(x[1].text), x[1].text), reverse=True)
    )
    case = lambda what: "CASE " + rules.format(*(f"'{what(r)}'" for r in RULES)) + " END"
    steps, last = [], "s"
    for i in range(1, ROUNDS + 1):
        steps.append(f"""r{i} AS (SELECT kind, host, CAST(sum(rank) AS BIGINT) AS rank FROM (
          SELECT w.kind, b AS host, CAST(rank * links // total AS BIGINT) * {DAMPING} // 100 AS rank FROM {last} JOIN w ON w.kind = {last}.kind AND a = host
          UNION ALL SELECT kind, host, rank * {100 - DAMPING} // 100 FROM s) GROUP BY kind, host HAVING sum(rank) > 0)""")
        last = f"r{i}"
    link = LINK.replace("'", "''")
    return rf"""
WITH n AS (SELECT page_id, {host("coalesce(url, '')")} AS host, regexp_extract({rest("coalesce(url, '')")}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM n),
l AS (SELECT {host("coalesce(url, '')")} AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS too FROM pages),
f AS (SELECT src, CASE WHEN starts_with(too, '//') THEN 'http:' || too ELSE too END AS too FROM l WHERE src <> ''),
e AS (SELECT src, CASE WHEN regexp_matches(too, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host('too')} WHEN regexp_matches(too, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM f),
g AS (SELECT src, dst, count(*) AS links FROM e WHERE dst <> '' GROUP BY src, dst),
h AS (SELECT 'trust' AS kind, src AS a, dst AS b, links FROM g UNION ALL SELECT 'distrust', dst, src, links FROM g),
w AS (SELECT kind, a, b, CAST(links AS HUGEINT) AS links, CAST(sum(links) OVER (PARTITION BY kind, a) AS HUGEINT) AS total FROM h),
s0 AS (SELECT DISTINCT CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host FROM q WHERE ruled IS NOT NULL AND host <> ''),
s AS (SELECT kind, host, {SCALE} // count(*) OVER (PARTITION BY kind) AS rank FROM s0),
{', '.join(steps)},
k AS (SELECT least({THRESHOLD}, {SCALE} // (greatest(count(*), 1) * {SEED_PART})) AS least_rank FROM s0 WHERE kind = 'distrust'),
t AS (SELECT host, CAST(sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS BIGINT) AS trust, CAST(sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS BIGINT) AS distrust FROM {last} GROUP BY host)
SELECT page_id, q.host, path, rule, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) >= least_rank AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM q CROSS JOIN k LEFT JOIN t ON t.host = q.host
"""
