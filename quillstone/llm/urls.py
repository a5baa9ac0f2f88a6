"""URL filter: rules first, then link-graph trust and distrust per host. DataFrame functions only.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting
rule decides. Pages that no rule fits are judged by their host: a personalised
PageRank walks host links forward from the hosts whose pages are allowed by rule
(trust) and backward from the hosts whose pages are blocked by rule (distrust).

The walk goes on for ``STEPS`` steps, after which ``residual`` (0.85^86, less than a millionth) of the mass is
still on its way. Edges of the domain hierarchy are part of the
host graph beside the links: where pages link only within their own host, they alone carry standing from one host
of an owner to another.

Defined cases: a null url, or one without ``://``, has empty host and path and is
judged like any other host named ''. A host that no walk reaches is allowed, and so is one
whose distrust equals its trust (to 12 places). Null or empty html has no links; very long html is searched whole.
Repeated rows are judged alike, each on its own row. No pages:
no rows. A walk that comes to a host without links ends there. Extra columns of the
input are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, lower_ascii, take

STEPS = 86
EDGES_A_PART = 200_000
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; equal lengths: the first block rule.

    The rules are a short list of the caller's, so they are part of the plan, not a table.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from pages (host, html) and the domain hierarchy.

    Absolute links count once per occurrence, summed before the shuffle. Each host is
    also joined with its parent domain, both ways, so that hosts of one owner share
    their standing even where pages link only to their own host.
    """
    links = cut(
        pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    parent = F.expr("substring(host, instr(host, '.') + 1)")
    family = hosts.where("instr(host, '.') > 0").select("host", parent.alias("parent")).where("instr(parent, '.') > 0")
    kin = family.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(
        family.select(F.col("parent").alias("src"), F.col("host").alias("dst"))
    )
    kin = kin.select("src", "dst", F.lit(1.0).alias("weight"))
    return links.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def residual(damping: float = 0.85, iterations: int = STEPS) -> float:
    """The most that a host's trust or distrust can still gain or lose after so many steps."""
    return damping**iterations


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = STEPS, cut_every: int = 1) -> DataFrame:
    """Personalised PageRank by (kind, node): seeds (kind, node, mass), edges (kind, src, dst, weight).

    Masses are scaled to sum 1 by kind. Both kinds run in one job per step; sums are
    combined before the shuffle, so a hub costs one row per task. Tables are in as many parts as
    their edges need, ``EDGES_A_PART`` to a part, whatever the number of shuffle partitions: a host graph is
    small beside the pages, and every step would pay for empty parts.
    """
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out_weight"))
    parts = 1 + edges.count() // EDGES_A_PART
    start = cut(seeds.join(total, "kind").select("kind", "node", (F.col("mass") / F.col("total")).alias("mass")).coalesce(parts))
    steps = cut(
        edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("node"), "dst", (F.col("weight") / F.col("out_weight")).alias("share")).coalesce(parts)
    )
    base = start.select("kind", "node", (F.col("mass") * (1 - damping)).alias("mass"))
    rank = start
    for step in range(iterations):
        moved = rank.join(steps, ["kind", "node"]).select("kind", F.col("dst").alias("node"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        rank = base.union(moved).coalesce(parts).groupBy("kind", "node").agg(F.sum("mass").alias("mass")).coalesce(parts)
        if (step + 1) % cut_every == 0:
            rank = cut(rank)
    return rank


def judge_pages(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, iterations: int = STEPS, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; see the module's text.

    A host is blocked where its distrust exceeds ``ratio`` times its trust.
    """
    host, path = url_parts(F.col("url"))
    judged = take(pages, "page_id", "url", "html").select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = judged.withColumn("ruled", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = (
        judged.where("ruled is not null and host <> ''")
        .groupBy(F.when(F.col("ruled.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), F.col("host").alias("node"))
        .agg(F.count("*").cast("double").alias("mass"))
    )
    edges = cut(host_edges(judged.select("host", "html")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    rank = propagate(both, seeds, damping, iterations)
    hosts = rank.groupBy("node").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"),
    )
    blocked = hosts.where(F.round("distrust", 12) > F.round(F.col("trust") * ratio, 12)).select(F.col("node").alias("host"), F.lit(True).alias("distrusted"))
    return (
        judged.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("by_rule"))
        .join(cut(blocked), "host", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("by_rule", F.when(F.col("distrusted"), "block").otherwise("allow")).alias("verdict"),
        )
    )


#: The production rules of the query.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def oracle(rules: Sequence[Rule] = RULES, damping: float = 0.85, iterations: int = STEPS, ratio: float = 1.0) -> str:
    """The same in SQL; the walk is unrolled, one step a common table expression."""
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    order = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "block"))
    case = lambda what: "case " + " ".join(f"when {fits(r)} then '{what(r)}'" for r in order) + " end"
    link = LINK.replace("'", "''")
    steps, last = "", "r0"
    for i in range(1, iterations + 1):
        steps += f""",
r{i} as (select kind, node, sum(mass) mass from (
  select kind, node, mass * {1 - damping} mass from r0
  union all select s.kind, s.dst, r.mass * s.share * {damping} from {last} r join steps s on r.kind = s.kind and r.node = s.node) group by 1, 2)"""
        last = f"r{i}"
    return f"""with parts as (
  select page_id, html, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
split as (
  select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
judged as (select *, {case(lambda r: r.pattern)} as rule, {case(lambda r: r.verdict)} as by_rule from split),
links as (
  select src, dst, count(*)::double weight from (
    select host src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') dst from judged)
  where src <> dst and src <> '' and dst <> '' group by 1, 2),
hosts as (select distinct host from (select host from judged union all select dst from links) where host <> ''),
family as (select host, substr(host, instr(host, '.') + 1) parent from hosts where instr(host, '.') > 0),
kin as (select * from family where instr(parent, '.') > 0),
edges as (
  select src, dst, sum(weight) weight from (
    select * from links union all select host, parent, 1.0 from kin union all select parent, host, 1.0 from kin) group by 1, 2),
kinds as (select 'trust' kind, src, dst, weight from edges union all select 'distrust', dst, src, weight from edges),
steps as (select kind, src node, dst, weight / sum(weight) over (partition by kind, src) share from kinds),
seeds as (
  select case when by_rule = 'allow' then 'trust' else 'distrust' end kind, host node, count(*)::double mass
  from judged where by_rule is not null and host <> '' group by 1, 2),
r0 as (select kind, node, mass / sum(mass) over (partition by kind) mass from seeds){steps},
scores as (
  select node, sum(case when kind = 'trust' then mass else 0 end) trust, sum(case when kind = 'distrust' then mass else 0 end) distrust
  from {last} group by 1)
select page_id, host, path, rule,
  coalesce(by_rule, case when round(distrust, 12) > round(trust * {ratio}, 12) then 'block' else 'allow' end) verdict
from judged left join scores on host = node"""
