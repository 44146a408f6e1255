"""URL filtering: path rules first, then trust and distrust spread over the links between hosts.

Rules are (verdict, host and path prefix); a rule fits its host and all subdomains where the path starts with the rule's,
and the longest rule that fits wins. Where none fits, the host decides: personalised PageRank runs from hosts with
allowed pages along links, and from hosts with blocked pages against them (who links to a blocked host is near it).
A host is blocked if its distrust exceeds `threshold` times the sum of its trust and distrust.

Ranks are joins and aggregates over an edge table, one row per pair of hosts; every round is written to the shared
folder. A host with very many links is combined on the map side; AQE splits it in the joins.

NULL urls and urls without `://` have an empty host and path: no rule fits and they are allowed. Hosts without links keep
only their own seed. NULL html has no links. Repeated rows get equal verdicts; links count once for each page that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import ascii_lower
from tapelake.session import written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.75


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else NULL."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # the last WHEN is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): pages of src that link to dst, another host. Relative links stay on their host and make no edge."""
    link = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(link), 1), ascii_lower))
    return (pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(found).alias("dst"))
            .where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def spread(edges: DataFrame, seeds: DataFrame, label: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass) of a walk from `seeds` (host, seed; seeds sum to 1) that returns there with 1 - damping, and from hosts
    without edges. `edges` are (src, dst, n)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), label)
    mass = seeds.select("host", F.col("seed").alias("mass"))
    if steps.isEmpty():
        return mass
    for _ in range(rounds):
        passed = written(steps.join(mass, steps["src"] == mass["host"]).groupBy(F.col("dst").alias("host"))
                         .agg((damping * F.sum(F.col("share") * F.col("mass"))).alias("mass")), label)
        # what does not move along an edge goes back to the seeds; all masses sum to 1
        moved = passed.agg(F.sum("mass")).first()[0] or 0.0
        back = seeds.select("host", (F.col("seed") * (1 - moved)).alias("mass"))
        mass = passed.unionByName(back).groupBy("host").agg(F.sum("mass").alias("mass"))
    return written(mass, label)


def _seeds(rows: DataFrame, verdict: str) -> DataFrame:
    """Hosts by their share of the pages that rules give this verdict."""
    own = rows.where((F.col("host") != "") & (F.col("rule_verdict") == verdict)).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    own = written(own, f"seeds-{verdict}")
    total = own.agg(F.sum("n")).first()[0] or 1
    return own.select("host", (F.col("n") / F.lit(total)).alias("seed"))


def host_scores(rows: DataFrame, html: str = "html", damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches. `rows` have host, rule_verdict and html."""
    edges = written(host_edges(rows, "host", html), "edges")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = spread(edges, _seeds(rows, "allow"), "trust", damping, rounds)
    distrust = spread(turned, _seeds(rows, "block"), "distrust", damping, rounds)
    return (trust.withColumnRenamed("mass", "trust").join(distrust.withColumnRenamed("mass", "distrust"), "host", "full")
            .fillna(0.0, ["trust", "distrust"]))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
          damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust and distrust of the host."""
    link = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"), F.col(html).alias("html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule_verdict", verdict_of(F.col("rule"), rules))
    hosts = written(host_scores(rows, "html", damping, rounds), "hosts")
    far = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    own = F.when(far, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.drop("html").join(hosts, "host", "left")
            .select(F.col("page_id").alias(page_id), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
