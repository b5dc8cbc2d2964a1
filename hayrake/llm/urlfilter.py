"""URL filters: address rules, and link-graph propagation of trust and distrust between hosts.

Each page's address is judged by the longest fitting rule. Where none fits,
the host decides: personalised PageRank carries trust from hosts with allowed
pages along links, and distrust from hosts with blocked pages against links
(to those that link to them). A host whose share of distrust is above the
threshold is blocked.

Defined results: a null address, or one without `://`, has an empty host and
path and no rule, and is allowed; an address whose path does not begin with a
rule's path does not fit it; null html has no links; hosts without seeds or
links, and empty tables, are allowed and empty; repeated rows are judged
alike; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrake.session import drop, materialise, prepare

DAMPING = 0.85
#: Largest relative change of any host's score in the last step.
TOLERANCE = 1e-3
#: Share of distrust in a host's trust and distrust above which it is blocked.
MAX_DISTRUST = 0.5
#: Tables of at most so many hosts are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def _folded(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the hosts that its html links to (its own left out)."""
    pages = pages.select("page_id", "url", "html").withColumn("rest", _rest(F.col("url")))
    pages = pages.withColumn("host", _folded(F.regexp_extract("rest", r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)
    target = lambda x: _folded(F.regexp_extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    hosts = F.filter(F.transform(links, target), lambda h: (h != "") & (h != F.col("host")))
    return pages.select("page_id", "host", "path", hosts.alias("links"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def host_rules(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules of each host and its parent domains: host, rules (longest first)."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffix).alias("suffix")).join(_bounded(table), "suffix")
    key = F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "verdict")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list(key)).alias("rules"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: seeds (host, seed) and edges (src, dst, weight) to host, score.

    Rank at hosts without links returns to the seeds in proportion. Steps go
    on until no host is newly reached and none changes by more than tolerance
    of its own score, however small that is beside the seeds. A host's change
    is a mean of those of its sources, so the largest never grows again.
    """
    edges = materialise(edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "edges")
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    if edges.isEmpty() or not total:
        return seeds.select("host", F.col("seed").cast("double").alias("score"))
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).union(seeds.select("host")).distinct()
    sources = edges.select(F.col("src").alias("host")).distinct().withColumn("has_links", F.lit(True))
    base = materialise(ends.join(seeds, "host", "left").join(sources, "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).cast("double").alias("seed"), F.coalesce("has_links", F.lit(False)).alias("has_links")), "hosts")
    now, spent = base.withColumn("score", F.col("seed")), base
    at_ends = F.sum(F.when(~F.col("has_links"), F.col("score")))
    lost, change = now.agg(at_ends).first()[0] or 0.0, 1.0
    while change > tolerance:
        moved = now.join(edges, now.host == edges.src).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = F.col("seed") * ((1 - damping) + damping * lost / total) + damping * F.coalesce("got", F.lit(0.0))
        after = materialise(now.withColumnRenamed("score", "old").join(moved, "host", "left").select("host", "seed", "has_links", "old", score.alias("score")), "rank")
        most = F.greatest("score", "old")
        lost, change = after.agg(at_ends, F.max(F.when(most > 0, F.abs(F.col("score") - F.col("old")) / most))).first()
        lost, change = lost or 0.0, change or 0.0
        drop(spent)
        now, spent = after.drop("old"), after
    return now.select("host", "score")


def judge(pages: DataFrame, rules: list[Rule], max_distrust: float = MAX_DISTRUST, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    prepare(pages.sparkSession)
    every = materialise(parsed(pages), "pages")
    hosts = every.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    own = _bounded(materialise(host_rules(hosts, rules), "rules"))
    fit = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r.rule_path)), F.lit(1))
    every = every.join(own, "host", "left").withColumn("fit", fit)
    ruled = materialise(every.select("page_id", "host", "path", "links", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")), "ruled")
    seeds = ruled.filter("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    seeds = materialise(seeds, "seeds")
    edges = ruled.filter(F.size("links") > 0).select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    edges = materialise(edges, "links")
    trust = propagate(seeds.filter("allowed > 0").select("host", F.col("allowed").alias("seed")), edges)
    distrust = propagate(seeds.filter("blocked > 0").select("host", F.col("blocked").alias("seed")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full_outer").na.fill(0.0)
    scores = _bounded(materialise(scores, "scores"))
    doubt = F.col("distrust") / F.when(F.col("trust") + F.col("distrust") > 0, F.col("trust") + F.col("distrust"))
    by_host = F.when(doubt > max_distrust, F.lit("block")).otherwise(F.lit(default))
    out = ruled.join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
