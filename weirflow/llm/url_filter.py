"""URL filters with link-graph propagation, in DataFrame operations only.

Rules name a host and a path: ``block net/`` or ``allow example.net/en/``. A rule
fits its host and all subdomains where the URL's path starts with the rule's; the
longest one decides. Where none fits, the method does: over the graph of links
between hosts, personalised PageRank spreads trust along links from hosts that
rules mostly allow, and distrust against the direction of links from hosts that
rules mostly block. A host is blocked if its distrust exceeds LEAST of an even
share (what each host would have if distrust were spread over all alike) and
outweighs its trust; else its pages are allowed. Propagation goes on until what all
later rounds together can still move is at most TOLERANCE of the whole.

Hosts are compared by code points after lower-casing A-Z. A null URL, or one
without ``://``, has empty host and path, fits no rule and is allowed. Repeated
pages are judged row by row; null html has no links. Host edges are counted before
they are joined, so a host with a third of all pages is one row; each round is one
shuffle by host. Rounds are written to the shared folder every few, to cut lineage.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.scratch import Scratch

DAMPING, LEAST, TOLERANCE = 0.85, 0.5, 1e-6
#: Rounds between two written tables, which are also looked at for TOLERANCE.
CUT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """The part after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, rule) that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def host_scores(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """host, trust and distrust, propagated to within TOLERANCE of where it ends.

    ``edges`` has distinct (src, dst), ``seeds`` host, trusted and blocked (0 or 1);
    a host without links out, or in, keeps what it has from its seed. A round shrinks
    what is moved by DAMPING or more, so about a hundred rounds are the most.
    """
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = seeds.select("host", (F.col("trusted") / max(total.t or 0, 1)).alias("t0"), (F.col("blocked") / max(total.b or 0, 1)).alias("b0"))
    if edges.isEmpty():  # every round gives the seeds' part alone
        return start.select("host", ((1 - DAMPING) * F.col("t0")).alias("trust"), ((1 - DAMPING) * F.col("b0")).alias("distrust"))
    now = scratch.keep(start.select("host", "t0", "b0", F.col("t0").alias("trust"), F.col("b0").alias("distrust")), "scores-0")
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    weighed = scratch.keep(edges.join(out, "src").join(into, "dst").select("src", "dst", "n_out", "n_in"), "edges")
    both = weighed.select(F.col("src").alias("host"), F.col("dst").alias("to"), (1 / F.col("n_out")).alias("wt"), F.lit(0.0).alias("wb"))
    both = both.unionByName(weighed.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (1 / F.col("n_in")).alias("wb")))
    for i in itertools.count(1):
        sent = both.join(now.select("host", "trust", "distrust"), "host").groupBy("to").agg(F.sum(F.col("wt") * F.col("trust")).alias("t"), F.sum(F.col("wb") * F.col("distrust")).alias("b"))
        trust = (1 - DAMPING) * F.col("t0") + DAMPING * F.coalesce("t", F.lit(0.0))
        distrust = (1 - DAMPING) * F.col("b0") + DAMPING * F.coalesce("b", F.lit(0.0))
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        now = now.join(sent.withColumnRenamed("to", "host"), "host", "left").select("host", "t0", "b0", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved"))
        if i % CUT == 0:
            now = scratch.keep(now, f"scores-{i}")
            scratch.drop(f"scores-{i - CUT}")
            if now.agg(F.sum("moved")).first()[0] * DAMPING / (1 - DAMPING) <= TOLERANCE:
                return now.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession)
    judged = pages.select("page_id", "url").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    known = judged.filter("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.expr("int(by_rule = 'allow')")).alias("allowed"), F.sum(F.expr("int(by_rule = 'block')")).alias("blocked")
    )
    known = known.select("host", F.expr("double(coalesce(allowed, 0) * 2 > n)").alias("trusted"), F.expr("double(coalesce(blocked, 0) * 2 > n)").alias("blocked"))
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src != '' and src != dst").distinct()
    links = scratch.keep(links, "links")
    linked = links.select(F.col("dst").alias("host")).distinct().select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked"))
    seeds = scratch.keep(known.unionByName(linked).groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked")), "seeds")
    n_hosts = seeds.count()
    blocked = host_scores(links, seeds, scratch).select("host", ((F.col("distrust") * n_hosts > LEAST) & (F.col("distrust") > F.col("trust"))).alias("bad"))
    bad = blocked.filter("bad").select(F.col("host").alias("bad_host"))
    out = judged.join(bad, F.col("host") == F.col("bad_host"), "left")
    return out.select("page_id", "host", "path", "rule", F.expr("coalesce(by_rule, if(bad_host is null, 'allow', 'block'))").alias("verdict"))
