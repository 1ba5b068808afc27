"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

Hosts are linked by the absolute links of their pages and, if ``owner_edges`` is set, a host with the domain above
it in both directions (its owner).  Relative links stay on their host and make no edge.  Pages allowed by a rule seed
trust, blocked ones seed distrust, by number.  Personalised PageRank carries trust along the edges and distrust against
them; a host whose share of distrust is above the threshold is blocked, and every other one allowed.

Each round leaves at most DAMPING of what was still to be dealt out: after ROUNDS that is DAMPING ** ROUNDS of all trust
and distrust, which is checked to be below TOLERANCE.  Edges are counted per pair of hosts before they are joined; a hub's edges
are the rows of an equi-join that adaptive execution splits, and what reaches it is summed by partial aggregation.
States are settled in the shared folder every few rounds, and the pages meet the verdicts in a join whose host side is measured first.

Defined cases: a url that is null or has no ``://`` has an empty host and path, which no rule fits and
which is a host like any other; a null html has no links; hosts that no seed reaches are allowed;
without seeds all are; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.scratch import join_checked, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path), as rules are written.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds, those between settled states, and the most of the mass that may be left to deal.
ROUNDS, SETTLE_EVERY, TOLERANCE = 48, 6, 1e-3
THRESHOLD = 0.5
#: Whether a host and the domain above it are linked.
OWNER_EDGES = True
HREF = r"(?i)href *= *[\"']?([a-zA-Z]*:?//[^\"' >]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block"))
    fits = [(host == h) | host.endswith("." + h) for _, h, _ in ordered]
    fits = [f & path.startswith(p) for f, (_, _, p) in zip(fits, ordered, strict=True)]
    pick = lambda values: reduce(lambda e, fv: e.when(*fv), zip(fits[1:], values[1:], strict=True), F.when(fits[0], values[0])) if values else F.lit(None).cast("string")
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) from absolute links, one row for a pair of hosts."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("_to"))
    to = F.translate(F.regexp_extract("_to", r"//([^/?#]*)", 1), UPPER, LOWER)
    return found.withColumn("dst", to).where("dst <> src and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Every host to and from the domain above it, up to two labels."""
    labels = F.split("host", r"\.")
    up = hosts.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("src"))
    up = up.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where("dst <> src and instr(dst, '.') > 0").distinct()
    return up.select("src", "dst", F.lit(1.0).alias("links")).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("links")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` of personalised PageRank from (host, s_trust, s_distrust).

    Trust runs from src to dst by share of the source's links, distrust from dst to src by share of the target's.
    What a host without further edges holds is not dealt out again.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("_in"))
    ways = edges.join(out, "src").join(into, "dst")
    ways = ways.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("_out")).alias("_t"), F.lit(0.0).alias("_d")).unionByName(
        ways.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("_t"), (F.col("links") / F.col("_in")).alias("_d")))
    ways = settle(ways.groupBy("host", "to").agg(F.sum("_t").alias("_t"), F.sum("_d").alias("_d")), "link-ways")
    state = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    for nth in range(1, rounds + 1):
        sent = state.join(ways, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("_t") * damping).alias("trust"), (F.col("distrust") * F.col("_d") * damping).alias("distrust"))
        back = seeds.select("host", (F.col("s_trust") * (1 - damping)).alias("trust"), (F.col("s_distrust") * (1 - damping)).alias("distrust"))
        state = sent.unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if nth % SETTLE_EVERY == 0 or nth == rounds:
            state = settle(state, "link-state")
    return state


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS, owner_edges: bool = OWNER_EDGES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    if damping**rounds > TOLERANCE:
        raise ValueError(f"{rounds} rounds leave {damping**rounds:.2g} of the mass undealt, more than {TOLERANCE}")
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    judged = settle(cut.select("page_id", "host", "path", rule.alias("rule"), said.alias("_said")), "link-pages")
    seen = judged.groupBy("host").agg(F.count(F.when(F.col("_said") == "allow", 1)).alias("_a"), F.count(F.when(F.col("_said") == "block", 1)).alias("_b"))
    seen = settle(seen, "link-hosts")
    row = seen.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b")).first()
    seeds = seen.select("host", (F.col("_a") / F.lit(max(row["a"], 1.0))).cast("double").alias("s_trust"), (F.col("_b") / F.lit(max(row["b"], 1.0))).cast("double").alias("s_distrust"))
    edges = host_edges(cut)
    if owner_edges:
        edges = edges.unionByName(domain_edges(seen.select("host"))).groupBy("src", "dst").agg(F.sum("links").alias("links"))
    state = propagate(seeds, settle(edges, "link-edges"), damping, rounds)
    judged = join_checked(judged, state, "host", "left", row_bytes=160, salt_by="page_id")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_method = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_said", by_method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
