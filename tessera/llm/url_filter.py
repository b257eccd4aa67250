"""URL rules and empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted per host. A host's rate is shrunk towards its registered domain, that
towards its suffix, that towards the overall rate, each by a beta-binomial prior around the rate of what it belongs to. The strength of
a level's priors is fitted to how far its groups lie from theirs, beyond chance (method of moments). A host is blocked when even the
upper bound of its posterior rate is under a floor, so that hosts without evidence stay. Explicit rules go before reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash, unstash

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which domains are registered; all others are the last label alone.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Limits of a prior's strength, in pseudo-observations, and the strength where too little is known to fit it.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 1000.0, 10.0
#: Host tables up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def registered_domain(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix, without a port: the last label is the suffix, or the last two where they are listed."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(name, ".", -1))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fit, F.lit(h + p)).otherwise(rule), F.when(fit, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-observations of the priors of groups (n, k) around the means of what they belong to, by the method of moments.

    A rate of n outcomes scatters by mean (1 - mean) (1 / n + (1 - 1 / n) / (strength + 1)) around its mean.
    """
    rate, chance = F.col("k") / F.col("n"), mean * (1 - mean)
    x = groups.filter("n > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum((rate - mean) * (rate - mean) - chance / F.col("n")).alias("beyond"),
        F.sum(chance * (1 - 1 / F.col("n"))).alias("most"),
    ).first()
    if x.groups < 2 or not x.most > 0:
        return UNKNOWN
    fitted = x.most / x.beyond - 1 if x.beyond > 0 else STRONGEST
    return round(min(STRONGEST, max(WEAKEST, fitted)), 3)


def host_reputation(outcomes: DataFrame, z: float = 1.645, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """Posterior of each host. outcomes: host, good (1, 0 or null where unlabelled), one row a page. Counted once and written to the shared folder."""
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    domain, suffix = registered_domain(F.col("host"), long_suffixes)
    hosts = stash(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stash(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = domains.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = F.lit(((total.k or 0) + 1) / ((total.n or 0) + 2))
    shrunk = lambda prior, s: (F.col("k") + prior * F.lit(s)) / (F.col("n") + F.lit(s))
    suffixes = suffixes.select("suffix", shrunk(mean, _strength(suffixes, mean)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(F.col("suffix_rate"), _strength(domains, F.col("suffix_rate"))).alias("domain_rate"))
    rated = stash(hosts.join(domains, "domain").select("host", "n", "k", "domain_rate"), "rated")
    unstash(hosts)
    strength = _strength(rated, F.col("domain_rate"))
    rated = rated.withColumn("rate", shrunk(F.col("domain_rate"), strength))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1)))
    return rated.select("host", F.col("n").alias("n_labelled"), "rate", F.least(F.lit(1.0), F.col("rate") + F.lit(z) * sd).alias("upper"), F.greatest(F.lit(0.0), F.col("rate") - F.lit(z) * sd).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, floor: float = 0.5, z: float = 1.645, rules=RULES, long_suffixes: tuple[str, ...] = LONG_SUFFIXES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """Verdict on every url: the longest fitting rule's, else block where the host's upper posterior bound is under floor.

    labels: label_id, quality, toxic; a page is good if quality is 1 and toxic is not 1, and unlabelled where quality
    is null; of several labels of a page the worst counts. Returns id_col, host, path, rule, verdict, n_labelled, rate,
    upper, lower. Null, empty and very long urls are judged like any other, those without `://` under the empty host; repeated pages are
    all judged, and each counts as an outcome; of rules of equal length the last one wins; empty tables
    give empty results (without labels every host has the even prior); other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    good = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 0).otherwise(F.when(F.col("quality") == 1, 1).otherwise(0))
    marks = labels.filter(F.col(label_id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(good).alias("good"))
    outcomes = seen.join(marks, F.col(id_col) == F.col("_id"), "left").select("host", "good")
    hosts = host_reputation(outcomes, z, long_suffixes)
    weight = hosts.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0)).alias("w")).first().w
    if weight <= BROADCAST_BYTES:
        hosts = F.broadcast(hosts)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    return seen.join(hosts, "host", "left").select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"),
        "n_labelled", "rate", "upper", "lower",
    )
