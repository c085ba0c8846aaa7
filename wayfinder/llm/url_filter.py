"""URL filters: rules on hosts and paths, and link-graph propagation for pages that no rule fits.

Host edges come from the pages' links and from the domain tree (a host and its parent domain link to each other).
Trust flows from hosts whose pages the rules allow along edges, distrust from hosts whose pages they block against
edges, each as a personalised PageRank; a host is blocked if its share of distrust exceeds its share of trust times a
threshold.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed; null html has
no links; repeated pages each get a row and count each as a seed and as links; hosts that neither walk reaches are
allowed; an empty table gives no row.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import ascii_lower
from wayfinder.shared import BROADCAST_ROWS, materialize

#: Host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

DAMPING, THRESHOLD = 0.85, 1.0
#: A walk has settled when the shares of a side move by less than this in EVERY steps; it must settle within MOST steps.
SETTLED, EVERY, MOST = 1e-3, 8, 400
#: A link names a host only if it begins with a scheme or with //; an address within a query is none.
ABSOLUTE = r"^(?i)([a-z][a-z0-9+.-]*:)?//"
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>#]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones a block wins. Rules are a short list in the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight: links between different hosts, and each host with its parent domain both ways."""
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), 1))).alias("link"))
    links = linked.where(F.col("link").rlike(ABSOLUTE)).select("src", F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("x:"), "link"))).otherwise(host_of(F.col("link"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    above = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")))).alias("e")).select("e.*").where("src like '%.%' and dst like '%.%'").distinct().withColumn("weight", F.lit(1.0))
    back = above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return links.unionByName(above).unionByName(back).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED, every: int = EVERY, most: int = MOST) -> DataFrame:
    """side, host, share. seeds: side (trust or distrust), host, weight. Walks restart at their side's seeds; mass that
    reaches a host without edges restarts too, which normalising at the end amounts to. Written out every few steps, until
    the shares have settled."""
    both = edges.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = both.groupBy("side", "src").agg(F.sum("weight").alias("out"))
    moves = materialize(both.join(total, ["side", "src"]).select("side", "src", "dst", (F.col("weight") / F.col("out")).alias("p")), "moves")
    sums = seeds.groupBy("side").agg(F.sum("weight").alias("all"))
    start = materialize(seeds.join(sums, "side").select("side", "host", (F.col("weight") / F.col("all")).alias("share")), "seeds")
    rank = start
    for _ in range(0, most, every):
        before = rank
        for _ in range(every):
            moved = rank.join(moves, (rank["side"] == moves["side"]) & (rank["host"] == moves["src"])).select(rank["side"], F.col("dst").alias("host"), (damping * F.col("share") * F.col("p")).alias("share"))
            rank = moved.unionByName(start.withColumn("share", (1 - damping) * F.col("share"))).groupBy("side", "host").agg(F.sum("share").alias("share"))
        rank = materialize(rank, "rank")
        change = rank.unionByName(before.withColumn("share", -F.col("share"))).groupBy("side", "host").agg(F.abs(F.sum("share")).alias("x")).groupBy("side").agg(F.sum("x").alias("x")).agg(F.max("x")).head()[0]
        if (change or 0.0) < settled:
            break
    else:
        raise RuntimeError(f"shares still move by {change} after {most} steps")
    whole = rank.groupBy("side").agg(F.sum("share").alias("all"))
    return rank.join(whole, "side").select("side", "host", (F.col("share") / F.col("all")).alias("share"))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's shares of trust and distrust."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    seeds = judged.where("hit is not null and host <> ''").groupBy(F.when(F.col("hit.verdict") == "allow", "trust").otherwise("distrust").alias("side"), "host").agg(F.count("*").cast("double").alias("weight"))
    shares = propagate(host_edges(pages, url_col, html_col), seeds)
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("share"))), F.lit(0.0))
    hosts = shares.groupBy("host").agg(side("trust").alias("trust"), side("distrust").alias("distrust"))
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    hosts = materialize(hosts.withColumnRenamed("host", "known"), "hosts")
    # pages without a host have a key of their own each, so that they don't meet in one task
    key = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("\0"), F.spark_partition_id(), F.lit(" "), F.monotonically_increasing_id()))
    listed = F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts
    return judged.withColumn("key", key).join(listed, F.col("key") == F.col("known"), "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
