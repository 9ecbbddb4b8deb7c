"""URL filters by link-graph propagation: rules first, then trust and distrust of hosts over the links of the pages.

* ``split_url``: host and path of a URL. ``rules``: (verdict, host, path) triples; a rule fits its host and all subdomains of it if
  the URL's path starts with the rule's path; of those that fit, the longest (as host and path in one string) decides.
  Rules meet hosts, not pages: the distinct hosts' suffixes are joined with the rules' hosts, and a page looks only at the
  rules of its host.
* Host graph: an edge u -> v if a page of host u links (``<a href>``, outside comments, scripts and styles) to host v.
* Trust is personalised PageRank along the links from trusted seeds: a host is a seed to the share of its pages that rules
  allow. Distrust is the same along the reversed links from the share of its pages that rules block: who links to blocked
  hosts inherits their distrust.
* A page without a rule is blocked if its host's distrust is larger than its trust and than ``THRESHOLD``, what a host has
  of itself if half of its pages are blocked. Hosts without evidence are allowed.

Propagation is by residuals: each step adds what arrived and passes ``DAMPING`` of it on, in equal parts, by one join of the
residuals with the edges and one aggregation, both by host; it ends when no host got a ten-thousandth of a seed (``SCALE`` units of a
seed, integers, so the result does not depend on the order of sums). A host's residual meets its edges once per step, so a hub
is split like any skewed join; every step is staged in the shared folder. What hosts without links receive stays there.

Defined cases: null URLs and those without ``://`` have an empty host and path, no rule, and are allowed; null html has no links;
repeated pages count as often as they occur; empty tables give no rows; null ids stay. Only id, URL and html are read, so
that other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import UPPER, broadcast_if_small, stage

#: (verdict, host, path), as the contract of the query states them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SCALE = 1_000_000_000
DAMPING = 85  # per cent
THRESHOLD = SCALE // 2
SMALLEST = SCALE // 10_000
#: What is no markup of the page: comments, scripts and styles, to the end if they are not closed.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*(?:>|\z).*?(?:</(?:script|style)|\z)"
LINK = r"(?i)<a\x20[^<>]*?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\x22\x27]?[\x20\x09-\x0D]*((?:https?:)?//[^\x00-\x20\x22\x27<>/?#]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null and for URLs without ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    return _lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those (verdict, rule, path) whose host is the host or a parent domain of it, longest rule first. Hosts
    without one are left out. ``rules`` has verdict, host and path; equal rules count once, and of two rules for the
    same host and path with different verdicts the block stands."""
    rule = rules.groupBy(_lower(F.col("host")).alias("at"), "path").agg(F.max("verdict").alias("verdict"))
    rule = rule.select("at", F.struct((F.length("at") + F.length("path")).alias("size"), F.length("at").alias("host_size"),
                                      F.concat("at", "path").alias("rule"), "path", "verdict").alias("r"))
    found = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("at")).join(rule, "at")
    return found.groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst: the distinct pairs of different hosts that ``pages`` (with a column ``host``) link."""
    seen = F.regexp_replace(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), HIDDEN, " ")
    to = F.array_distinct(F.transform(F.regexp_extract_all(seen, F.lit(LINK), 1), lambda x: _lower(F.regexp_replace(x, r"(?i)^(https?:)?//", ""))))
    return (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(to).alias("dst")).where("src <> dst").distinct())


def propagate(edges: DataFrame, seeds: DataFrame, damping: int = DAMPING) -> DataFrame:
    """kind, host, score: personalised PageRank without normalisation, from ``seeds`` (kind, host, score in ``SCALE`` units)
    over the distinct ``edges`` (kind, src, dst); several kinds go in the same steps."""
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    edges = stage(edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", "degree"), "url-edges")
    residual = stage(seeds.where(F.col("score") > 0).select("kind", "host", F.col("score").cast("bigint").alias("score")), "url-residual")
    parts = [residual]
    passed = F.expr(f"((score div degree) * {damping}) div 100")
    while True:
        residual = stage(residual.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), passed.alias("score"))
                         .groupBy("kind", "host").agg(F.sum("score").alias("score")).where(F.col("score") >= SMALLEST), "url-residual")
        if residual.isEmpty():
            break
        parts.append(residual)
        if len(parts) == 16:  # one staged sum instead of a plan that grows with the steps
            parts = [stage(_summed(parts), "url-score")]
    return stage(_summed(parts), "url-score")


def _summed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, key: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, trust and distrust (in ``SCALE`` units) of every page."""
    spark = pages.sparkSession
    host, path = split_url(F.col(f"`{url}`"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    split = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"))
    by_host = stage(host_rules(split.where("host <> ''").select("host").distinct(), rules), "url-rules")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    ruled = stage(split.join(broadcast_if_small(by_host, 500), "host", "left").select("key", "host", "path", first.alias("r"))
                  .select("key", "host", "path", "r.rule", "r.verdict"), "url-pages")
    seen = stage(ruled.where("host <> ''").groupBy("host").agg(
        F.expr(f"(count_if(verdict = 'allow') * {SCALE}) div count(*)").alias("good"),
        F.expr(f"(count_if(verdict = 'block') * {SCALE}) div count(*)").alias("bad")), "url-hosts")
    edges = stage(page_links(pages.select(host.alias("host"), F.col(f"`{html}`").alias("html"))), "url-links")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = seen.select("host", F.explode(F.create_map(F.lit("trust"), "good", F.lit("distrust"), "bad")).alias("kind", "score"))
    scores = stage(propagate(both, seeds).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust")]), "url-scores")
    out = ruled.join(broadcast_if_small(scores, 100), "host", "left").select(
        "key", "host", "path", "rule", "verdict", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    own = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") > THRESHOLD), "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")


def url_report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
