"""Verdicts on urls: rules first, then trust and distrust over the host graph.

Pages link hosts.  Personalised PageRank spreads trust along the links from
hosts that an allow rule covers, and distrust against them from hosts that a
block rule covers: who links to blocked hosts is suspect.  A host whose share
of distrust exceeds its share of trust is blocked.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Ranks have settled when those of a side change by this in all in five rounds, of a sum of one.
SETTLED = 1e-6
#: Block a host if distrust > THRESHOLD * trust, each relative to its largest.
THRESHOLD = 1.0
#: Broadcast ranks and verdicts of hosts up to this many rows of about 60 bytes.
BROADCAST_HOSTS = 200_000
#: What no reader sees: comments, scripts, styles; what isn't closed goes to the end.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # begins with a slash

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, rest, 1), UPPER, LOWER), F.regexp_extract(url, rest, 2)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, the first of equals; null
    if none does.  For a list of rules that fits into an expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        yes = fits(rule, host, path)
        name, verdict = F.when(yes, rule.name).otherwise(name), F.when(yes, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts: links in the pages, relative ones
    and those in comments, scripts and styles left out, and between a host and its parent domain if both have pages."""
    host, _ = host_path(F.col(url))
    target, _ = host_path(F.col("href"))
    page = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), _UNSEEN, " ")
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(page, F.lit(_LINK), F.lit(1))).alias("href"))
    found = found.where(F.col("href").contains("://") | F.col("href").startswith("//")).withColumn("href", F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))
    links = found.select("src", target.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host.alias("host")).distinct()
    parents = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
    parents = parents.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    family = parents.union(parents.select("dst", "src")).select("src", "dst", F.lit(1).cast("long").alias("n"))
    both = links.union(family).where("src <> dst and src <> '' and dst <> ''")
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def personalised_pagerank(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """links(side, src, dst, n), seeds(side, host, seed) -> side, host, rank.

    Sides are walks of their own, in one loop.  A side's seeds add up to one of
    rank, which flows along its links in proportion to n; what reaches a host
    without links is lost.  Hosts that nothing reaches have no row; a side
    without seeds has none.  Every fifth round is written, so plans stay short;
    rounds go on until ranks have SETTLED, which the damping brings about in
    ninety or fewer, or are as many as asked for.
    Ranks of few hosts are broadcast to the links, those of more are joined.
    """
    total = seeds.groupBy("side").agg(F.sum("seed").alias("total"))
    start = written(seeds.groupBy("side", "host").agg(F.sum("seed").alias("seed")).join(total, "side").select("side", "host", (F.col("seed") / F.col("total")).alias("seed")), "seeds")
    out = links.groupBy("side", "src").agg(F.sum("n").alias("all"))
    shares = written(links.join(out, ["side", "src"]).select("side", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    few = shares.count() + start.count() <= BROADCAST_HOSTS
    back = start.select("side", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    rank = start.select("side", "host", F.col("seed").alias("rank"))
    last = start.select("side", "host", F.col("seed").alias("rank"))
    for i in count(1):
        flow = shares.join(F.broadcast(rank) if few else rank, ["side", "host"]).select("side", F.col("dst").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
        rank = flow.union(back).groupBy("side", "host").agg(F.sum("rank").alias("rank"))
        if i == rounds:
            return written(rank, "rank")
        if i % 5 == 0:
            rank = written(rank, "rank")
            if rounds is None:
                both = rank.unionByName(last.withColumn("rank", -F.col("rank"))).groupBy("side", "host").agg(F.sum("rank").alias("change"))
                moved = both.groupBy("side").agg(F.sum(F.abs("change")).alias("moved")).agg(F.max("moved")).first()[0]
                if moved is None or moved < SETTLED:
                    return rank
                last = rank


def host_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust, verdict of every host of the pages.

    A host is a seed by how many of its pages a rule decides: allowed ones of
    trust, blocked ones of distrust.  Hosts that neither reaches are allowed.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    _, verdict = by_rule(rules, F.col("host"), F.col("path"))
    hosts = written(rows.groupBy("host").agg(F.count_if(verdict == "allow").alias("allowed"), F.count_if(verdict == "block").alias("blocked")), "hosts")
    links = written(host_links(pages), "links")
    sides = (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src"))  # distrust goes against links
    seeds = [hosts.where(F.col(c) > 0).select(F.lit(side).alias("side"), "host", F.col(c).cast("double").alias("seed")) for side, c, _, _ in sides]
    edges = [links.select(F.lit(side).alias("side"), F.col(a).alias("src"), F.col(b).alias("dst"), "n") for side, _, a, b in sides]
    rank = personalised_pagerank(edges[0].union(edges[1]), seeds[0].union(seeds[1]), rounds)
    both = rank.groupBy("host").agg(*[F.sum(F.when(F.col("side") == side, F.col("rank"))).alias(side) for side, *_ in sides])
    found = hosts.select("host").join(both, "host", "left").fillna(0.0, ["trust", "distrust"])
    most = found.agg(F.max("trust").alias("t"), F.max("distrust").alias("d"))
    both = found.crossJoin(F.broadcast(most)).select("host", F.coalesce(F.col("trust") / F.nullif("t", F.lit(0.0)), F.lit(0.0)).alias("trust"), F.coalesce(F.col("distrust") / F.nullif("d", F.lit(0.0)), F.lit(0.0)).alias("distrust"))
    return both.withColumn("verdict", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Null urls and urls without `://` have empty host and path, which no rule
    fits and no link reaches: they are allowed.  Repeated rows are judged each.
    """
    hosts = written(host_verdicts(pages, rules, rounds).withColumnRenamed("verdict", "by_graph"), "verdicts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = by_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", name.alias("rule"), verdict.alias("by_rule")).join(hosts, "host", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph").alias("verdict"), "trust", "distrust")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the four rules and the host graph."""
    from .common import table

    return judge(table(spark, sf_dir, "pages"))
