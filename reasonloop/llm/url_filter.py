"""URL filters with DataFrame operations only: host rules, then link-graph propagation.

*Rules* ``host/path`` block or allow: a rule fits its host and all subdomains where the url's
path starts with the rule's; the longest rule that fits decides.

*Propagation* judges what no rule decides. Hosts are vertices; a link from a page to another
host is an edge, weighted by its share of the linking host's links. A host most of whose
pages are blocked by rule is a distrust seed; one with allowed pages and fewer blocked ones a
trust seed. Trust is personalised PageRank from the trust seeds: their mass is shared over their own links,
and on along the links. Distrust goes against the links: a host takes over the distrust of the hosts it
links to by its shares of links, so a blocked host with many linkers counts no less for each of them. Both run
in one iteration over (kind, host) until no score moves by ``TOLERANCE``; a round's largest move is at
most ``DAMPING`` times the one before, so it always ends.

Scores are read in units of a seed's own restart (``1 - DAMPING``), so a seed's is 1 and a host's distrust is the
chance that a walk along links from it, ended with ``1 - DAMPING`` at each step, ends on a blocked
seed, counted as if a walk that begins at one ended there. A host is blocked when that
is ``THRESHOLD`` or more, that is more likely than not, and above its trust: a chain of up to four hosts that
link only to the next one is caught (0.85, 0.72, 0.61, 0.52), and a host with three of four links into a blocked one
(0.64), not one with half of its links there (0.43).

Null urls and urls without ``://`` have an empty host and path and are allowed; null html has no
links. Repeated pages count as often as they stand. Scores are one row per host, written to
the shared folder each round; a hub's edges are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: (action, rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ITERATIONS = 60              # rounds the oracle SQL unrolls; the operator goes on to the tolerance
TOLERANCE = 1e-6
THRESHOLD = 0.5
MOST_RULES = 1000            # of one expression
_CASE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_CASE), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(r)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def with_rules(pages: DataFrame, rules=RULES, most: int = MOST_RULES) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest rule that fits (``host``, ``path``). Up to ``most`` rules are one
    expression; a longer list is a table, joined with the suffixes of the hosts that occur."""
    if len(rules) <= most:
        rule, action = rule_for(F.col("host"), F.col("path"), rules)
        return pages.withColumn("rule", rule).withColumn("action", action)
    split = [(a, r, *r.partition("/")[::2]) for a, r in rules]
    table = pages.sparkSession.createDataFrame(split, "action string, rule string, suffix string, begin string")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                   lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    per_host = (pages.select("host").distinct().select("host", suffix.alias("suffix")).join(table, "suffix")
                .groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "action", "begin")).alias("fit")))
    best = F.array_max(F.filter("fit", lambda x: F.startswith(F.col("path"), F.concat(F.lit("/"), x["begin"]))))
    named = pages.where("host != ''").join(per_host, "host", "left").withColumn("best", best)
    named = named.select(*pages.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    none = F.lit(None).cast("string")
    return named.unionByName(pages.where("host = ''").withColumn("rule", none).withColumn("action", none))


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n) of links between different hosts."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href=["']?(?:[a-z]+:)?//([^/?#"'\s>]+)"""), F.lit(1))
    return (pages.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
            .select("src", F.translate("dst", *_CASE).alias("dst")).where("src != dst and src != ''")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) for ``seeds`` (kind, host): kind ``trust`` follows the edges, ``distrust``
    follows them backwards, each edge weighted by its share of the linking host's links. A seed
    restarts with ``1 - damping``."""
    own = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = edges.join(own, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")),
                    F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))
    both = materialize(shares.select(F.explode(kinds).alias("k"), "w").select("k.*", "w"), "url-edges")
    start = materialize(seeds.select("kind", "host", F.lit(1.0 - damping).alias("score")), "url-seeds")
    score = start
    if both.isEmpty():
        return score
    while True:
        flow = (both.join(score.withColumnRenamed("host", "a"), ["kind", "a"])
                .groupBy("kind", F.col("b").alias("host")).agg((F.lit(damping) * F.sum(F.col("w") * F.col("score"))).alias("score")))
        new = flow.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = new.join(score.withColumnRenamed("score", "was"), ["kind", "host"], "left")
        new = materialize(new.select("kind", "host", "score", F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))).alias("moved")),
                          "url-scores")
        moved = new.agg(F.max("moved")).first()[0]
        score = new.drop("moved")
        if moved is None or moved < tolerance:
            break
    return score


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          threshold: float = THRESHOLD) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                     F.col(html_col).cast("string").alias("html"))
    p = with_rules(p, rules)
    hosts = p.where("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("action") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("action") == "allow", 1)).alias("allowed"))
    seed = (F.when(2 * F.col("blocked") > F.col("pages"), F.lit("distrust"))
            .when((F.col("allowed") > 0) & (F.col("allowed") > F.col("blocked")), F.lit("trust")))
    seeds = hosts.select(seed.alias("kind"), "host").where("kind is not null")
    score = propagate(host_edges(p.select("host", "html"), "html"), seeds)
    per_host = score.groupBy(F.col("host").alias("h")).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))) / F.lit(1.0 - DAMPING), F.lit(0.0)).alias(k)
          for k in ("trust", "distrust")])
    j = p.drop("html").join(materialize(per_host, "url-hosts"), F.col("host") == F.col("h"), "left")
    bad = (F.coalesce("distrust", F.lit(0.0)) >= threshold) & (F.col("distrust") > F.col("trust"))
    return j.select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("action", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
