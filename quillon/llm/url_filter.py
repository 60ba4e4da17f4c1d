"""URL filter by empirical-Bayes host reputations, under explicit rules.

Labelled page outcomes (bad or not) are counted for each host, its registered domain and its suffix.  The share
of bad pages is shrunk from the top down: a suffix towards the share of all pages, a domain towards its suffix,
a host towards its domain.  Each step is a beta-binomial prior whose mean is the level above and whose
strength, in pages, comes from how far the shares of the level spread beyond chance (method of moments).  A host
is blocked if the lower bound of its posterior (mean less `z` standard deviations) is over `most`.
The longest rule that fits a page's host or a parent of it and starts its path goes before.

A null url, or one without ://, has empty host and path; all those pages are one host.  A label counts
for each page of its id; of several labels of one id the worst counts; null ids have no label.  Repeated rows count
each.  Columns besides id and url pass through, but for those that are named like a column of the result.  An empty table gives an empty result; without labels
every host is allowed unless a rule blocks it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lookup, scratch, written

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Second-level registries, under which a registered domain has three parts.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    return (
        F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """com and example.com of m.example.com, co.uk and example.co.uk of m.example.co.uk; an address is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:\d*)?$", "")
    parts = F.split(bare, r"\.")
    two = (F.size(parts) > 2) & (F.length(F.get(parts, F.size(parts) - 1)) == 2) & F.get(parts, F.size(parts) - 2).isin(SECOND_LEVEL)
    n = F.when(two, 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".")
    address = bare.rlike(r"^(\d+\.){3}\d+$|^\[")
    return F.when(address, bare).otherwise(tail(n)), F.when(address, bare).otherwise(tail(n + 1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def strength(children: DataFrame) -> float:
    """Pages that the prior counts for; children: n, bad and mean, that of the level above."""
    p = F.col("mean")
    off = F.pow(F.col("bad") / F.col("n") - p, 2) * F.col("n")
    r = children.filter("n > 0").agg(F.sum(off).alias("off"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(p * (1 - p) * F.col("n")).alias("pq"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    chance, spread = r["pq"] / r["n"], r["off"] / r["n"]
    between = (spread - chance * r["k"] / r["n"]) / max(1e-9, 1 - r["nn"] / r["n"] ** 2)
    return min(1e4, max(2.0, chance / between - 1)) if between > 1e-9 else 1e4


def reputations(pages: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """For each host: n_pages, n (labelled), bad, mean and bound; pages: host and bad (0, 1 or null); written writes a table."""
    suffix, domain = suffix_and_domain(F.col("host"))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("children")]
    hosts = pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(hosts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    domains = written(hosts.groupBy("suffix", "domain").agg(*counts), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*counts), "suffixes")
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    top = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1)

    def shrunk(level: DataFrame) -> DataFrame:
        m = strength(level)
        return level.withColumn("above", F.col("mean")).withColumn("weight", F.lit(m)).withColumn("mean", (F.col("bad") + m * F.col("mean")) / (F.col("n") + m))

    suffixes = shrunk(suffixes.withColumn("mean", F.lit(top)))
    domains = written(shrunk(lookup(domains, suffixes.select("suffix", "mean", "children"), "suffix", "children", domains.count(), "domain").drop("children")), "domains")
    means = domains.groupBy("domain").agg(F.max("mean").alias("mean"), F.count("*").alias("children"))
    grown = hosts.groupBy("domain").agg(F.count("*").alias("children"))
    means = means.drop("children").join(grown, "domain")
    hosts = shrunk(lookup(hosts, means, "domain", "children", hosts.count(), "host").drop("children"))
    a = F.col("bad") + F.col("weight") * F.col("above")
    b = F.col("n") - F.col("bad") + F.col("weight") * (1 - F.col("above"))
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.select("host", "n_pages", "n", "bad", "mean", sd.alias("sd"))


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    label_id: str = "doc_id", bad: Column | None = None, most: float = 0.5, z: float = 1.64,
) -> DataFrame:
    """The rows of `pages` with host, path, rule, verdict, n_labelled and bound (the posterior's lower bound).  bad: a
    condition on `labels`, that a page's outcome was bad; low quality by default."""
    bad = F.col("quality") == 0 if bad is None else bad
    host, path = host_and_path(F.col(f"`{url_col}`"))
    outcome = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label")).agg(F.max(bad.cast("int")).alias("bad"))
    split = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"))
    with scratch(pages.sparkSession) as keep:
        known = written(reputations(split.join(outcome, F.col("id") == F.col("label"), "left").select("host", "bad"), keep), "reputations")
    made = ["host", "path", "rule", "verdict", "n_labelled", "bound"]
    others = [c for c in pages.columns if c not in made]
    # the page's own columns as one, so that no name can clash
    full = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("page"), F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    known = known.select("host", F.struct("n", (F.col("mean") - z * F.col("sd")).alias("bound")).alias("own"), "n_pages")
    full = lookup(full, known, "host", "n_pages", full.count(), "id")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return full.select(
        *[F.col("page")[c].alias(c) for c in others],
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("own")["bound"] > most, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("own")["n"].alias("n_labelled"),
        F.col("own")["bound"].alias("bound"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return url_filter(pages.select("page_id", "url"), labels.select("doc_id", "quality")).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(level: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR count(*) < 2 THEN 10.0
      WHEN (sum(pow(bad / n - mean, 2) * n) / sum(n) - sum(mean * (1 - mean) * n) / sum(n) * count(*) / sum(n)) / greatest(1e-9, 1 - sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2)) > 1e-9
      THEN least(1e4, greatest(2.0, sum(mean * (1 - mean) * n) / sum(n) / ((sum(pow(bad / n - mean, 2) * n) / sum(n) - sum(mean * (1 - mean) * n) / sum(n) * count(*) / sum(n)) / greatest(1e-9, 1 - sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2))) - 1))
      ELSE 1e4 END FROM {level} WHERE n > 0)"""


#: For hosts without ports, addresses and two-part suffixes, as the synthetic pages have them.
SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain
          FROM h LEFT JOIN l ON doc_id = page_id GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM domains) AS mean FROM domains GROUP BY 1),
s2 AS (SELECT suffix, (bad + m * mean) / (n + m) AS mean FROM suffixes, (SELECT {_strength_sql("suffixes")} AS m)),
d1 AS (SELECT domain, n, bad, mean FROM domains JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (bad + m * mean) / (n + m) AS mean FROM d1, (SELECT {_strength_sql("d1")} AS m)),
h1 AS (SELECT host, n, bad, mean FROM hosts JOIN d2 USING (domain)),
h2 AS (SELECT host, bad + m * mean AS a, n - bad + m * (1 - mean) AS b FROM h1, (SELECT {_strength_sql("h1")} AS m)),
r AS (SELECT page_id, h.host, path, a / (a + b) - 1.64 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound, CASE
        WHEN (h.host = 'example.com' OR ends_with(h.host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN (h.host = 'example.net' OR ends_with(h.host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN (h.host = 'com' OR ends_with(h.host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN (h.host = 'net' OR ends_with(h.host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN (h.host = 'org' OR ends_with(h.host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
      FROM h JOIN h2 ON h2.host = h.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
