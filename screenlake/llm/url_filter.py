"""URL verdicts from rules and from trust that spreads over the link graph of hosts.

Rules (host, path prefix) judge the urls they fit; the longest wins. Every other url takes its host's
verdict from the pages' links: personalised PageRank spreads trust along links from hosts with allowed
pages, and distrust against the links' direction from hosts with blocked pages; a host is blocked
when its share of distrust is above ``threshold``. Host edges, seeds and ranks are Spark tables; a host's
links are counted before they are joined, so a hub is a row for each different neighbour.

Cases: a url that is null or has no ``://`` has an empty host and path and is allowed; null html has no
links; relative links stay on their host and count for nothing; hosts that no seed reaches are allowed;
repeated pages count again as seeds and links; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, taken

DAMPING, ITERATIONS, THRESHOLD = 0.85, 20, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The value of a link's href, with or without quotes.
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` ((verdict, host/path)) that fits, as text; null if none does."""
    fits = []
    for _, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest if rest else ""), F.lit(text)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): numbers of links between different hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))).alias("href"))
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href"))
    absolute = links.where("src <> ''").where(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    return absolute.select("src", host_of(target).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, rank): personalised PageRank over ``edges`` (src, dst, n) from ``seeds`` (host, seed summing to 1).

    What hosts without links hold flows back to the seeds. Ranks are written every other round.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = staged(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    if shares.isEmpty():  # all of it flows back in every round
        return ranks
    for k in range(iterations):
        flow = ranks.join(shares, ranks["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("x"))
        # all flow is at most ``damping``; what is missing to 1 starts again from the seeds
        arrived = flow.groupBy("host").agg(F.sum("x").alias("x"))
        moved = arrived.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("moved"))
        restart = seeds.crossJoin(F.broadcast(moved)).select("host", (F.col("seed") * (1 - F.col("moved"))).alias("x"))  # one row on the right
        ranks = arrived.unionByName(restart).groupBy("host").agg(F.sum("x").alias("rank"))
        if k % 2 or k == iterations - 1:
            ranks = staged(ranks, "ranks")
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, iterations: int = ITERATIONS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of ``pages``."""
    pages = taken(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    verdict = F.lit(None).cast("string")
    for v, text in rules:
        verdict = F.when(F.col("rule") == text, F.lit(v)).otherwise(verdict)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict)
    counts = staged(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "hosts")
    edges = staged(host_links(pages, "url", "html"), "edges")
    both = {}
    for name, column, links in (("trust", "allowed", edges), ("distrust", "blocked", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        total = counts.agg(F.sum(column)).first()[0] or 0
        seeds = counts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(max(1, total)))).alias("seed"))
        both[name] = spread(links, seeds, iterations=iterations).select("host", F.col("rank").alias(name))
    scores = staged(both["trust"].join(both["distrust"], "host", "full").select("host", *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust"))), "trust")
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    by_host = F.when((F.col("trust") + F.col("distrust") > 0) & (share > threshold), F.lit("block")).otherwise(F.lit("allow"))
    out = judged.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")
