"""Operator 3: URL filters by propagation over the link graph of hosts.

Rules judge what they fit. For the rest, trust flows from the hosts that allow
rules fit along links, by personalised PageRank, and distrust flows from the
hosts that block rules fit against the links (who links to a blocked host is
suspect), by the same on the reversed graph. A host is blocked where distrust
outweighs trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import whole
from papersluice.session import read_table, written

DAMPING = 0.85
ROUNDS = 12
#: Relative change of every rank, below which propagation has converged; significant digits of ranks.
TOLERANCE, DIGITS = 1e-6, 10
#: Distrust over trust plus distrust, from which on a host is blocked.
THRESHOLD = 0.5
#: Links of a host that meet in one place; those of hubs are dealt into several.
HUB = 10_000
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Values in quotes of either kind, or without quotes to the next space or >.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:["'](?=[^"']*["']))?((?<=["'])[^"']*|(?<!["'])[^\s"'>]+)"""


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


#: Fixed by the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Lower-cased between the first :// and /, ?, # or the end; empty without ://, and for null."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


RULE = "struct<n:int,action:string,name:string>"


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(n, action, name) of the longest rule that fits; null if none does. Of equally long ones block wins.

    The rules are literals, a test each: for lists of a few hundred rules. Longer ones go through rules_joined().
    """
    fits = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.action).alias("action"), F.lit(r.host + r.path).alias("name")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(RULE)


def rules_joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path) with r as in rule_for(), for rule tables (action, host, path) of any length.

    A rule meets the pages of its host and subdomains by an equi-join over the
    suffixes of hosts, of which each host has as many as labels.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host", "path").distinct()
    listed = rules.select(F.col("action"), F.col("host").alias("suffix"), F.col("path").alias("prefix")).distinct()
    met = hosts.select("host", "path", F.explode(suffix).alias("suffix")).join(listed, "suffix").where(F.col("path").startswith(F.col("prefix")))
    name = F.concat("suffix", "prefix")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), "action", name.alias("name"))).alias("r"))
    return pages.join(best, ["host", "path"], "left")


def linked_hosts(html: Column, host: Column) -> Column:
    """Distinct other hosts that a page's absolute or protocol-relative links name."""
    targets = F.transform(F.regexp_extract_all(whole(html), F.lit(HREF), F.lit(1)), lambda u: F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))
    return F.array_distinct(F.filter(F.transform(targets, host_of), lambda h: (h != "") & (h != host)))


def _significant(x: Column) -> Column:
    """x to DIGITS significant digits, however small."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.coalesce(F.round(x / unit, DIGITS - 1) * unit, x)


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, hub: int = HUB) -> DataFrame:
    """kind, host, rank: personalised PageRank after `rounds` rounds; None: until no host is new and no rank changes by more than TOLERANCE of itself.

    seeds: kind, host, seed; edges: kind, src, dst, n. Ranks of different kinds
    don't mix. A host without links keeps its rank to itself. Rounded to
    significant digits each round, so that the order of summing doesn't matter
    and no small rank is lost. Links that start at hosts without rank are never
    joined; those of a host with more than `hub` links are dealt into several
    places, and its rank goes to each, so no task holds all links of a hub.
    """
    links = written(edges.groupBy("kind", "src", "dst").agg(F.sum("n").alias("n")), "links")
    outs = links.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / hub).cast("long").alias("parts"))
    outs = written(outs, "outs")
    places = outs.select("kind", "src", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    placed = links.join(outs.select("kind", "src", "parts"), ["kind", "src"])
    placed = written(placed.select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"), "dst", "n"), "placed")
    start = written(seeds, "seeds")
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank, used = start.select("kind", "host", F.col("seed").alias("rank")), bool(placed.take(1))
    done, moving = 0, True
    while moving:
        sent = rank.withColumnRenamed("host", "src").join(places, ["kind", "src"]).select("kind", "src", "part", (F.col("rank") / F.col("total")).alias("unit"))
        moved = sent.join(placed, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (F.col("unit") * F.col("n") * damping).alias("rank"))
        after = written(base.unionByName(moved).groupBy("kind", "host").agg(_significant(F.sum("rank")).alias("rank")), "rank")
        done += 1
        if not used:
            moving = False
        elif rounds is not None:
            moving = done < rounds
        else:
            was = rank.withColumnRenamed("rank", "was")
            changed = F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > TOLERANCE * F.col("rank"))
            moving = bool(after.join(was, ["kind", "host"], "left").where(changed).take(1))
        rank = after
    return rank


def judged(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust.

    rules: a few as a tuple, any number as a table (action, host, path).

    Urls that are null or without :// have an empty host and path, which no
    links reach and which is allowed. Null html has no links. Repeated pages are
    judged alike, each counts. A host with neither trust nor distrust is
    allowed. Other columns don't matter, whatever their names. Seeds are the
    shares of a host's pages that allow and block rules fit. An empty table
    gives an empty result.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = named.select("page_id", "host", "path", linked_hosts(F.col("html"), F.col("host")).alias("links"))
    ruled = rules_joined(named, rules) if isinstance(rules, DataFrame) else named.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    parsed = written(ruled, "pages")
    share = lambda action: F.avg(F.coalesce((F.col("r.action") == action).cast("double"), F.lit(0.0)))
    hosts = parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0")
    links = parsed.where("host <> ''").select("host", F.explode("links").alias("to")).groupBy("host", "to").agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("host").alias("src"), F.col("to").alias("dst")), F.struct(F.lit("distrust").alias("kind"), F.col("to").alias("src"), F.col("host").alias("dst"))))
    ranks = spread(seeds, links.select(both.alias("e"), "n").select("e.*", "n"), rounds=None)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    table = written(ranks.groupBy("host").agg(of("trust"), of("distrust")), "hosts")
    bad = (F.col("distrust") > 0) & (F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust")))
    return parsed.join(table, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.name").alias("rule"),
        F.coalesce(F.col("r.action"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op3_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page; null and odd urls, repeated pages as in judged()."""
    return judged(read_table(spark, sf_dir, "pages"))
