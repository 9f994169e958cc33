"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1: good, 0: bad) are counted by host. Rates are shrunk through
beta-binomial priors from the root to the suffix, the registered domain and the host: a level's
posterior mean is (good + s * parent's mean) / (n + s), where the prior strength s of the level
is estimated from all its groups by the method of moments. A page is blocked if the upper end of
its host's posterior interval (mean + z deviations of the beta posterior) lies below ``floor``,
so a host is blocked on evidence and never for being unknown. Hosts without labels take the
reputation of their domain, else of their suffix, else the root.

Rules come first: a rule fits its host, all subdomains and urls whose path starts with the
rule's; the longest fitting rule wins.

Null urls and urls without '://' have an empty host and path and are judged by the root. Label
rows without an outcome are dropped. Repeated pages are judged alike; columns that are not named
are ignored; with no labels at all, everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.session import cut

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr", "co.kr"]

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased in A-Z; both empty without '://'."""
    u = F.coalesce(url, F.lit(""))
    has = u.contains("://")
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    last2, last3 = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    two = last2.isin(TWO_LABEL_SUFFIXES)
    return F.when(two, last3).otherwise(last2), F.when(two, last2).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame, parent: Column) -> float:
    """The prior strength of one level by the method of moments, between 1 and 1000.

    With parent means m, sum (good - n m)^2 / sum n m (1 - m) estimates 1 + (mean group size - 1)
    times the share of variance that lies between groups.
    """
    row = groups.select(
        F.sum((F.col("good") - F.col("n") * parent) ** 2).alias("seen"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("expected"),
        F.sum(F.col("n") * (F.col("n") - 1) * parent * (1 - parent)).alias("spare"),
    ).first()
    if not row.spare or not row.expected:
        return 1000.0
    rho = max((row.seen - row.expected) / row.spare, 1e-3)
    return float(min(max(1 / min(rho, 0.5) - 1, 1.0), 1000.0))


def reputation(outcomes: DataFrame, prior_good: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Tables (key, mean, strength) of hosts, domains and suffixes, and the root's.

    outcomes: host, good (0 or 1). Counting by host comes first, so a host with any share of the
    rows is added up within the tasks that read it.
    """
    domain, suffix = levels(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good")).withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    n, good = total[0], total[1]
    root = (good + 2 * prior_good) / (n + 2)

    def shrunk(groups: DataFrame, parent: Column, key: str) -> DataFrame:
        s = _strength(groups, parent)
        return groups.withColumn("mean", (F.col("good") + s * parent) / (F.col("n") + s)).withColumn("strength", F.col("n") + F.lit(s))

    suffixes = shrunk(suffixes, F.lit(root), "suffix").select("suffix", "mean", "strength")
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("above")), "suffix"), F.col("above"), "domain").select("domain", "mean", "strength")
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("above")), "domain"), F.col("above"), "host").select("host", "mean", "strength")
    return hosts, domains, suffixes, (root, float(n + 2))


def _fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, name, start = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", floor: float = 0.5, z: float = 2.0) -> DataFrame:
    """(id, host, path, rule, verdict, reputation, upper) for each page.

    outcomes: host, good. rules: (verdict, host, path) with few entries.
    """
    host, path = parse(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hosts, domains, suffixes, (root, root_strength) = reputation(outcomes)
    # labelled hosts are few beside pages, but may be many: reputations are looked up once for each different host
    domain, suffix = levels(F.col("host"))
    known = df.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    for name, table in (("host", hosts), ("domain", domains), ("suffix", suffixes)):
        known = known.join(table.select(name, F.col("mean").alias(f"m_{name}"), F.col("strength").alias(f"s_{name}")), name, "left")
    mean = F.coalesce("m_host", "m_domain", "m_suffix", F.lit(root))
    strength = F.coalesce("s_host", "s_domain", "s_suffix", F.lit(root_strength))
    upper = F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (strength + 1)))
    known = known.select("host", F.round(mean, 9).alias("reputation"), F.round(upper, 9).alias("upper"))
    df = df.join(known, "host")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("upper") < floor, "block").otherwise("allow")
    for r in reversed(ordered):
        rule, verdict = F.when(_fits(r, F.col("host"), F.col("path")), r[1] + r[2]).otherwise(rule), F.when(_fits(r, F.col("host"), F.col("path")), r[0]).otherwise(verdict)
    return df.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "reputation", "upper")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    """Every page judged; outcomes are the quality labels of the documents with the pages' numbers."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("good")).dropna()
    outcomes = pages.withColumn("host", parse(F.col("url"))[0]).join(labels, "page_id").select("host", "good")
    return judge(pages, outcomes)
