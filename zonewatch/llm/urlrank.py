"""Operator 5: url rules, and for what no rule fits, trust and distrust spread over the host graph.

Rules are few and given by the user: (verdict, host, path). A rule fits its host and all hosts below it if
the url's path starts with the rule's; of several the longest (host and path together) wins, a block before
an allow of the same length.

Hosts are scored on the graph of links between hosts, repeated links counted once. Trust is a personalised
PageRank: it starts from hosts by the share of their pages that rules allow and follows links. Distrust
starts from the share that rules block and goes against the links, from the linked to the linking host, which
takes the mean over the hosts it links to: how many others link there too does not matter. Both scores are on
one scale, with links or without: a host's own seed counts `1 - DAMPING` times. A host is blocked if its distrust is at least `FLOOR` and exceeds its trust. Rounds stop when no score moves
by more than `TOLERANCE`, after `ROUNDS` at the latest; each round is two joins and a sum over distinct
links, written to the shared folder, and one number reaches the driver.

Defined results: a null url, or one without `://`, has an empty host and path, is a page of no host, and
is allowed; null html has no links; links within a host do not count; without links every host's scores are
`1 - DAMPING` times its seeds; repeated rows come back repeated; an empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import lookup_side
from zonewatch.session import materialize, release

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
FLOOR = 0.05
TOLERANCE = 1e-4
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in best]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return (found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
            .filter("src != '' AND dst != '' AND src != dst").distinct())


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) once they stand still, for seeds (host, s_trust, s_distrust) and distinct links."""
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    along = links.join(out, "src").select(F.col("src").alias("frm"), F.col("dst").alias("to"), (1.0 / F.col("k")).alias("t"), F.lit(0.0).alias("d"))
    against = links.join(out, "src").select(F.col("dst").alias("frm"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (1.0 / F.col("k")).alias("d"))
    flow = materialize(along.union(against))
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    base = materialize(hosts.join(seeds, "host", "left").select(
        "host", F.coalesce("s_trust", F.lit(0.0)).alias("s_trust"), F.coalesce("s_distrust", F.lit(0.0)).alias("s_distrust")))
    state = materialize(base.select("host", *[((1 - damping) * F.col(f"s_{c}")).alias(c) for c in ("trust", "distrust")]))
    still = flow.isEmpty()
    while not still:
        got = flow.join(state, F.col("frm") == F.col("host")).groupBy("to").agg(
            F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        step = lambda s, x: (1 - damping) * F.col(s) + damping * F.coalesce(F.col(x), F.lit(0.0))
        moved = materialize(base.join(got, F.col("host") == F.col("to"), "left").join(state.withColumnRenamed("host", "h"), F.col("host") == F.col("h"))
                            .select("host", step("s_trust", "t").alias("trust"), step("s_distrust", "d").alias("distrust"),
                                    F.greatest(F.abs(step("s_trust", "t") - F.col("trust")), F.abs(step("s_distrust", "d") - F.col("distrust"))).alias("change")))
        release(state)
        state = moved
        still = (state.agg(F.max("change")).first()[0] or 0.0) <= TOLERANCE
    release(flow, base)
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, floor: float = FLOOR) -> DataFrame:
    """`pages` (page_id, url, html, more) with host, path, rule, verdict, trust, distrust of the host."""
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    parts = pages.select(*others, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("fit_", matched_rule(F.col("host"), F.col("path"), rules))
    seeds = (parts.filter("host != ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("fit_.verdict"), F.lit("")) == "allow").cast("double")).alias("s_trust"),
        F.avg((F.coalesce(F.col("fit_.verdict"), F.lit("")) == "block").cast("double")).alias("s_distrust")))
    links = materialize(host_links(parts.select("host", "html")))
    scores = lookup_side(spread(seeds, links, damping).filter("trust > 0 OR distrust > 0").withColumnRenamed("host", "host_"))
    joined = parts.join(scores, F.col("host") == F.col("host_"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust >= floor) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*others, "host", "path", F.col("fit_.rule").alias("rule"), F.coalesce(F.col("fit_.verdict"), own).alias("verdict"),
                         trust.alias("trust"), distrust.alias("distrust"))
