"""URL filter: rules first, else what the link graph says about the host.

Rules name a host and a path; one fits its host and all subdomains if the path starts with the rule's, and the
longest rule wins. Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are
blocked seeds, each weighted by its number of such pages.

Host edges are the hyperlinks between different hosts, weighted by the number of linking pages, and one edge each
way between a host and its parent domain. Trust is a personalised PageRank from the trusted seeds along the
edges; distrust is one from the blocked seeds against them: who links to a blocked host earns distrust. The number
of rounds follows from the damping and the error allowed. A host is blocked if its distrust is above both its trust
and ``threshold`` times the mean over all hosts.

Everything is DataFrame work on one row a host and one an edge: a join and a sum by host each round. A host with a
third of all pages or links is summed in the tasks first, and its join partition is split by adaptive execution.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Pages
without html have no links. Without seeds nothing is blocked. Rows are judged one by one, repeated ones too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, ERROR, THRESHOLD = 0.8, 0.02, 1.0
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
#: rounds between two stored tables
STRIDE = 3


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The winning rule as ``struct(rule, verdict)``, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(source, target, weight)`` between different hosts."""
    host = host_of(F.col(url_col))
    linked = F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(host.alias("source"), F.explode(linked).alias("target")).where("source <> '' and source <> target")
    links = links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct().unionByName(links.select(F.col("target").alias("host"))).distinct()
    parts = F.split("host", r"\.")
    # every ancestor domain of two labels or more with its child
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("child"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("parent")),
    )
    family = hosts.where(F.size(parts) > 2).select(F.explode(chain).alias("x")).select("x.child", "x.parent").distinct()
    up = family.select(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit(1.0).alias("weight"))
    down = family.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit(1.0).alias("weight"))
    return links.unionByName(up).unionByName(down).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def _steps(edges: DataFrame) -> DataFrame:
    """``(from, to, trust_share, distrust_share)``: edges as they are for trust, reversed for distrust."""
    forward = edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "weight", F.lit(True).alias("ahead"))
    back = edges.select(F.col("target").alias("from"), F.col("source").alias("to"), "weight", F.lit(False).alias("ahead"))
    both = stored(forward.unionByName(back), "steps")
    sums = stored(both.groupBy("from", "ahead").agg(F.sum("weight").alias("all")), "degrees")
    share = F.col("weight") / F.col("all")
    return both.join(sums, ["from", "ahead"]).select(
        "from", "to", F.when(F.col("ahead"), share).otherwise(0.0).alias("trust_share"), F.when(~F.col("ahead"), share).otherwise(0.0).alias("distrust_share")
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, error: float = ERROR) -> DataFrame:
    """``(host, trust, distrust)`` of the hosts that any seed reaches; ``seeds(host, trusted, blocked)`` in pages."""
    t, b = seeds.agg(F.coalesce(F.sum("trusted"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    start = stored(seeds.where("trusted + blocked > 0").select("host", (F.col("trusted") / max(t, 1)).alias("trust"), (F.col("blocked") / max(b, 1)).alias("distrust")), "seeds")
    steps = stored(_steps(edges), "shares")
    home = start.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    state = start
    for i in range(math.ceil(math.log(error) / math.log(damping))):
        moved = state.join(steps, state["host"] == steps["from"]).select(
            F.col("to").alias("host"), (F.col("trust") * F.col("trust_share") * damping).alias("trust"), (F.col("distrust") * F.col("distrust_share") * damping).alias("distrust")
        )
        state = moved.unionByName(home).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % STRIDE == STRIDE - 1:
            state = stored(state, "ranks")
    return state


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    seeds = rows.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("found.verdict") == "allow").alias("trusted"), F.count_if(F.col("found.verdict") == "block").alias("blocked")
    )
    seeds = stored(seeds, "hosts")
    edges = stored(host_edges(pages, url_col, html_col), "edges")
    nodes = seeds.count()
    ranks = stored(propagate(edges, seeds), "ranks")
    judged = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") * max(nodes, 1) >= threshold), "block").otherwise("allow")
    ranks = ranks.select("host", "trust", "distrust", judged.alias("by_graph"))
    return rows.join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "by_graph", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
