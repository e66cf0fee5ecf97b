"""URL verdicts by rules, and by trust and distrust that spread over links between hosts.

Rules come first: the longest one whose host is the url's host or a parent domain of it and whose
path starts the url's path. For other urls the host decides. Hosts most of whose pages an allow rule
fits are trusted seeds, those most of whose pages a block rule fits are blocked seeds. Trust is a
personalised PageRank from the trusted seeds along links; distrust is one from the blocked seeds
against the direction of links, as a host that links to bad hosts is suspect. A host is blocked if its
distrust exceeds its trust by a factor.

Edges between hosts are the links of pages to other hosts, and one in each direction between a host
and its registered domain (last two labels). They are counted per pair of hosts before they are joined,
so a host with very many pages is one row. Trust and distrust walk together, as two kinds of one
table, and every ``BLOCK`` steps their masses are written to the shared folder.

A step moves ``mass * n / out`` rounded down, in whole parts of ``MASS * FINE``, so a result doesn't depend
on the order of sums and a rare link of a host with very many still carries its share. Steps end when
those of a block changed at most a ``TOLERANCE``-th of the mass of either kind. A step keeps ``DAMPING``
per cent of a change, so that is after 48 steps at most, and all further ones would change 0.4 times as
much. ``trust`` and ``distrust`` are shown in 1e-12ths; verdicts compare the full masses.

Defined cases: a url that is null or has no ``://`` has empty host and path, no rule and the verdict
allow; null pages have no links; repeated rows count each; hosts that no mass reaches are allowed;
an empty table gives an empty result; columns other than page_id, url and html are ignored.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope.session import stage

#: (verdict, host, path)
Rule = tuple[str, str, str]

BLOCK = 8  # steps in one plan
TOLERANCE = 100
DAMPING = 85  # per cent
MASS = 10**12
#: ``MASS * FINE`` times the links between two hosts has to fit into 38 digits.
FINE = 10**13
FACTOR = 1

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3))
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` (host, path) with ``rule`` and ``rule_verdict``: the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        rule = F.when(fits(r), F.lit(r[1] + r[2])).otherwise(rule)
        verdict = F.when(fits(r), F.lit(r[0])).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts, with those to registered domains."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    found = pages.where("host != ''").select(F.col("host").alias("source"), hrefs.alias("href"))
    absolute = found.where(F.col("href").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//")).select("source", F.regexp_replace("href", r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "x://").alias("href"))
    outward = split_url(absolute, "href").where("host != '' AND host != source").select("source", F.col("host").alias("target"))
    hosts = pages.where("host != ''").select("host").distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    up = hosts.select(F.col("host").alias("source"), domain.alias("target")).where("target != '' AND source != target")
    return outward.union(up).union(up.select("target", "source")).groupBy("source", "target").agg(F.count("*").alias("n"))


def seeds(pages: DataFrame) -> DataFrame:
    """(host, verdict) of hosts most of whose pages fall under rules of one verdict."""
    share = pages.where("host != ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("rule_verdict") == "allow").alias("allowed"),
        F.count_if(F.col("rule_verdict") == "block").alias("blocked"),
    )
    verdict = F.when(F.expr("2 * allowed > pages"), "allow").when(F.expr("2 * blocked > pages"), "block")
    return share.select("host", verdict.alias("verdict")).where("verdict IS NOT NULL")


def _moved() -> Column:
    part = F.expr("CAST(mass * n AS DECIMAL(38,0))")
    whole = ((part - part % F.col("out")) / F.col("out")).cast("decimal(38,0)")  # DIV would end at 64 bits
    return F.floor(whole * DAMPING / 100).cast("decimal(38,0)")


def spread(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, int]:
    """((kind, host, mass), steps) of a personalised PageRank of each kind from its hosts in ``start``.

    ``edges``: kind, source, target, n; ``start``: kind, host. Every seed of a kind gets the same share of
    ``MASS * FINE``; mass that a host without links receives ends there.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    counts = {r.kind: r.n for r in start.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return start.select("kind", "host", exact(F.lit(0)).alias("mass")), 0
    seed = F.create_map(*[x for kind, n in counts.items() for x in (F.lit(kind), exact(F.lit(str(MASS * FINE // n))))])[F.col("kind")]
    ranks = stage(start.select("kind", "host", seed.alias("mass")), "trust-seeds")
    again = ranks.select("kind", "host", exact(F.floor(F.col("mass") * (100 - DAMPING) / 100)).alias("mass"))
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("out"))
    counted = stage(edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", "n", "out"), "link-shares")
    steps, change = 0, None
    while change is None or change > MASS * FINE // TOLERANCE:
        before = ranks
        for _ in range(BLOCK):
            moved = ranks.join(counted, ["kind", "host"]).select("kind", F.col("target").alias("host"), _moved().alias("mass"))
            ranks = moved.union(again).groupBy("kind", "host").agg(exact(F.sum("mass")).alias("mass"))
        ranks = stage(ranks, "trust-ranks")
        differences = ranks.union(before.withColumn("mass", exact(-F.col("mass")))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("by"))
        steps, change = steps + BLOCK, differences.groupBy("kind").agg(F.sum("by").alias("by")).agg(F.max("by")).first()[0]
    return ranks, steps


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, steps) of every page (page_id, url, html)."""
    ruled = with_rule(split_url(pages.select("page_id", "url", "html")), rules)
    first = stage(seeds(ruled), "seeds")
    edges = stage(links(ruled), "links")
    trust, distrust = F.lit("allow").alias("kind"), F.lit("block").alias("kind")
    both = edges.select(trust, "source", "target", "n").union(edges.select(distrust, "target", "source", "n"))
    ranks, steps = spread(both, first.select(F.col("verdict").alias("kind"), "host"))
    of_kind = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("mass"))).alias(name)
    hosts = ranks.groupBy("host").agg(of_kind("allow", "trust"), of_kind("block", "distrust"))
    mass = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)")).alias(c)
    scored = ruled.drop("html", "url").join(hosts, "host", "left").select("page_id", "host", "path", "rule", "rule_verdict", mass("trust"), mass("distrust"))
    own = F.when(F.col("distrust") > F.col("trust") * FACTOR, "block").otherwise("allow")
    shown = lambda c: F.floor(F.col(c) / F.lit(FINE)).cast("long").alias(c)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), shown("trust"), shown("distrust"), F.lit(steps).alias("steps"))
