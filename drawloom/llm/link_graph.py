"""URL filter by rules and by trust that flows over the link graph of hosts.

A rule names a host, a path prefix and a verdict; it fits the host and its subdomains, and the longest that fits wins.
Pages without a rule get the verdict of their host. Trust is a personalised PageRank along links, started at hosts in
proportion to their pages that a rule allows; distrust is one against the direction of links, started in proportion to
blocked pages. Links are the absolute ones in the pages' html, one per pair of hosts weighted by the pages that carry
it. A host is blocked if its share of all distrust exceeds its share of all trust and ``LIFT`` times its share of the
background rank (the same walk started at all pages alike).

What a host without outgoing links would pass on is left out instead of sent back to the seeds: this scales all values
of a vector alike, and only shares are used. Each step is one join on hosts and one pre-aggregated sum; every
``CUT`` steps the vectors are written to the shared folder and compared with those ``CUT`` steps before. The walk ends
when no vector can be further than ``TOLERANCE`` (sum of all hosts) from its limit: a step shrinks differences by the
damping at least, so the change of a round bounds all that would follow.

A null url and one without ``://`` have an empty host and path, no rule and no part in the graph, and are allowed;
a null html has no links; repeated rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import lower_ascii, small_side, stored

DAMPING, CUT, LIFT, TOLERANCE = 0.85, 4, 1.5, 1e-9
_TARGET = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The default policy.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    ordered = sorted(rules, key=lambda r: -len(r.name))
    return F.coalesce(*(F.when(fits(r, host, path), F.lit(getattr(r, field))) for r in ordered), F.lit(None).cast("string"))


def links(pages: DataFrame) -> DataFrame:
    """Host pairs (a, b) by the pages that link them. ``pages`` has host and html."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(_TARGET), F.lit(1)))
    found = pages.filter("host != '' and html is not null").select(F.col("host").alias("a"), F.explode(F.array_distinct(F.transform(targets, lower_ascii))).alias("b"))
    return found.filter("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def ranked(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host with trust, distrust and background. ``seeds`` has host and the three start shares; ``edges`` a, b, w."""
    columns = ("trust", "distrust", "background")
    if edges.isEmpty():
        return seeds.select("host", *columns)
    out = edges.groupBy("a").agg(F.sum("w").alias("out"))
    into = edges.groupBy("b").agg(F.sum("w").alias("into"))
    weighted = stored(edges.join(out, "a").join(into, "b"))
    along = weighted.select(F.col("a").alias("host"), F.col("b").alias("to"), (F.col("w") / F.col("out")).alias("f"), F.lit(0.0).alias("r"))
    against = weighted.select(F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("f"), (F.col("w") / F.col("into")).alias("r"))
    moves = stored(along.unionByName(against))
    every = edges.select(F.col("a").alias("host")).unionByName(edges.select(F.col("b").alias("host"))).distinct()
    base = stored(seeds.join(every, "host", "full").select("host", *(F.coalesce(c, F.lit(0.0)).alias(f"s_{c}") for c in columns)))
    state = before = base.select("host", *(F.col(f"s_{c}").alias(c) for c in columns))
    rest = damping**CUT / (1 - damping**CUT)
    for step in count(1):
        sent = moves.join(state, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("f") * F.col("trust")).alias("trust"), F.sum(F.col("r") * F.col("distrust")).alias("distrust"), F.sum(F.col("f") * F.col("background")).alias("background"))
        state = base.join(sent, "host", "left").select("host", *((F.lit(1 - damping) * F.col(f"s_{c}") + damping * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns))
        if step % CUT == 0:
            state = stored(state)
            old = before.select("host", *(F.col(c).alias(f"o_{c}") for c in columns))
            change = state.join(old, "host").agg(*(F.sum(F.abs(F.col(c) - F.col(f"o_{c}"))) for c in columns)).first()
            if max(change) * rest <= tolerance:
                return state
            before = state


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's shares of trust and distrust."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = rows.select("page_id", "host", "path", by_rule(F.col("host"), F.col("path"), rules, "name").alias("rule"), by_rule(F.col("host"), F.col("path"), rules, "verdict").alias("ruled"))
    hosts = stored(ruled.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    total = hosts.agg(F.sum("n"), F.sum("allowed"), F.sum("blocked")).first()

    def share(column: str, whole: int | None) -> Column:
        return F.col(column) / float(whole) if whole else F.lit(0.0)

    seeds = hosts.select("host", share("allowed", total[1]).alias("trust"), share("blocked", total[2]).alias("distrust"), share("n", total[0]).alias("background"))
    state = stored(ranked(seeds, stored(links(rows.select("host", "html")))))
    sums = state.agg(*(F.sum(c) for c in ("trust", "distrust", "background"))).first()
    parts = [(F.col(c) / s if s else F.lit(0.0)).alias(c) for c, s in zip(("trust", "distrust", "background"), sums, strict=True)]
    scores = state.select("host", *parts)
    scores = stored(scores.select("host", "trust", "distrust", ((F.col("distrust") > F.col("trust")) & (F.col("distrust") > LIFT * F.col("background"))).alias("bad")))
    out = ruled.join(small_side(scores, 100_000), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
