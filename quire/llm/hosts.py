"""Verdicts on urls: rules by host and path, and empirical-Bayes reputation of hosts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bad share that a host's posterior must exceed to be blocked ...
MOST_BAD = 0.5
#: ... even at its lower bound, this many standard deviations below the mean.
DEVIATIONS = 1.645
#: Prior of the suffixes: the share of bad outcomes overall, worth this many outcomes.
STRENGTH = 10.0
#: What a fitted prior is worth at least, in outcomes.
LEAST_STRENGTH = 2.0
#: Second-level labels that registries hand out below a country's suffix (fixed values).
REGISTRY_LABELS = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, written host + path, and its verdict; null without one.

    A rule fits its host and all subdomains, if the path starts with the rule's. The rules are a short list.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """Last label; the last two where a registry's label stands before a country's."""
    labels = F.split(host, r"\.")
    two = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(REGISTRY_LABELS)
    return F.when(two, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; the host itself if it has no more."""
    labels = F.split(host, r"\.")
    n = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(F.size(labels) > n, F.concat_ws(".", F.slice(labels, -n, n))).otherwise(host)


def reputation(outcomes: DataFrame, hosts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``host``, ``posterior_mean`` and ``posterior_bound`` of the bad share of every host of ``hosts``.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1; null is no outcome). Counts are summed per host, then per domain and
    suffix. Each level's prior is a beta distribution around the posterior mean of the level above; its strength is
    fitted by moments to how much the level's own members differ, and is ``strength`` where they show no more
    than chance. Hosts without outcomes get the posterior of their domain, suffix, or of all outcomes.
    """
    counts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("b"), F.count("bad").cast("double").alias("n"))
    level = hosts.select("host").distinct().join(counts, "host", "left").fillna(0.0, ["b", "n"])
    level = level.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = level.groupBy("suffix", "domain").agg(F.sum("b").alias("db"), F.sum("n").alias("dn"))
    suffixes = domains.groupBy("suffix").agg(F.sum("db").alias("sb"), F.sum("dn").alias("sn"))
    every = suffixes.agg(((F.sum("sb") + 1) / (F.sum("sn") + 2)).alias("p0"))
    suffixes = suffixes.join(F.broadcast(every)).withColumn("sp", (F.col("sb") + strength * F.col("p0")) / (F.col("sn") + strength))
    domains = domains.join(suffixes, "suffix").withColumn("dp", (F.col("db") + strength * F.col("sp")) / (F.col("dn") + strength))

    # method of moments: observed spread of the shares against what chance alone would give
    share = F.col("b") / F.col("n")
    seen = level.where("n > 0").join(domains.select("domain", "suffix", "dp"), ["domain", "suffix"])
    fitted = seen.groupBy("domain", "suffix").agg(
        F.sum(F.col("n") * (share - F.col("dp")) ** 2).alias("_spread"), F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum("n").alias("_n"), F.first("dp").alias("_p"))
    chance = F.col("_k") * F.col("_p") * (1 - F.col("_p"))
    excess = (F.col("_spread") - chance) / F.greatest(F.col("_n") - F.col("_k"), F.lit(1.0))
    fitted = fitted.withColumn("_m", F.when(excess > 0, F.least(F.lit(1000.0), F.greatest(F.lit(LEAST_STRENGTH), F.col("_p") * (1 - F.col("_p")) / excess - 1))).otherwise(F.lit(strength)))
    known = level.join(domains.select("domain", "suffix", "dp"), ["domain", "suffix"]).join(fitted.select("domain", "suffix", "_m"), ["domain", "suffix"], "left")
    known = known.withColumn("_m", F.coalesce("_m", F.lit(strength)))
    a, total = F.col("b") + F.col("_m") * F.col("dp"), F.col("n") + F.col("_m")
    mean = a / total
    return known.select("host", mean.alias("posterior_mean"), (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (total + 1))).alias("posterior_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", most_bad: float = MOST_BAD) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``posterior_mean``, ``posterior_bound`` and ``verdict``.

    ``outcomes`` has ``host`` and ``bad``. The longest fitting rule decides; without one, a host is blocked
    if even the lower bound of its posterior bad share exceeds ``most_bad``. All rows and other columns stay, repeated
    ones too. A null url, or one without ``://``, has the empty host, which is judged like any other.
    """
    parsed = pages.drop("host", "path", "rule", "posterior_mean", "posterior_bound", "verdict")
    parsed = parsed.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    scores = reputation(outcomes, parsed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    joined = parsed.join(scores, "host", "left").withColumn("rule", rule)
    return joined.withColumn("verdict", F.coalesce(verdict, F.when(F.col("posterior_bound") > most_bad, "block").otherwise("allow")))
