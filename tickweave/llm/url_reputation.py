"""URL filter: explicit rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad: 0/1) are counted by host. The bad rate is shrunk
through beta-binomial priors: suffix towards the overall rate, registered domain
towards its suffix, host towards its registered domain; each level's prior
strength is fitted by moments to that level's counts. A url is blocked if the
lower bound of its host's posterior (mean - z * sd of the beta) is above a
threshold. Only DataFrame expressions; host tables are joined by shuffle (or
what AQE makes of it), counts are pre-aggregated.

Defined cases: null url or no ``://`` gives empty host and path and the overall
prior; null labels are ignored; repeated rows count each; empty tables work
(overall rate 0.5 with no labels). Rules are configuration: they become one CASE
expression of the plan.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Second-level labels under which country registries hand out names.
REGISTRY_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gub", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch"]
#: A suffix of two labels by rule: one of those under a country's two letters.
WIDE = rf"^(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$"
#: Hosts that are addresses: four numbers, or in brackets.
ADDRESS = r"^(?:\d+\.\d+\.\d+\.\d+|\[.*\])$"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): see the module's text; A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def with_levels(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds domain and suffix of ``host``.

    A suffix is the last label, or two by the rule WIDE; ``suffixes`` (one column, such as a
    public-suffix list) has further ones: the longest that a host ends with holds. An address is a
    domain of its own under the suffix "(address)".
    """
    bare = F.regexp_replace("host", r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    df = df.withColumn("_bare", bare).withColumn("_suffix", F.when(two.rlike(WIDE), two).otherwise(F.substring_index(bare, ".", -1)))
    if suffixes is not None:
        labels = F.split("_bare", r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: last_labels(F.col("_bare"), k))
        known = suffixes.select(F.lower(F.col(suffixes.columns[0])).alias("_end")).distinct()
        best = df.select("host", F.explode(ends).alias("_end")).join(known, "_end").groupBy("host").agg(F.max_by("_end", F.length("_end")).alias("_own"))
        longer = F.length("_own") > F.length("_suffix")
        df = df.join(best, "host", "left").withColumn("_suffix", F.when(longer, F.col("_own")).otherwise(F.col("_suffix"))).drop("_own")
    address = F.col("_bare").rlike(ADDRESS)
    n = F.size(F.split("_suffix", r"\."))
    domain = F.when(address, F.col("_bare")).otherwise(last_labels(F.col("_bare"), n + 1))
    return df.withColumns({"domain": domain, "suffix": F.when(address, "(address)").otherwise(F.col("_suffix"))}).drop("_bare", "_suffix")


def strength(row, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength of a level from (k groups, n, b, sum n^2, sum b^2 / n): moments of the beta-binomial."""
    k, n, b, n2, b2n = (float(x or 0) for x in row)
    if k < 2 or n <= k or b <= 0 or b >= n:
        return most
    p = b / n
    between = (b2n - n * p * p) / (k - 1)
    within = (b - b2n) / (n - k)
    size = (n - n2 / n) / (k - 1)
    if between + (size - 1) * within <= 0 or size <= 0:
        return most
    rho = (between - within) / (between + (size - 1) * within)
    return most if rho <= 0 else min(most, max(least, (1 - rho) / rho))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts(host) and outcomes(host, bad) -> host, labelled, mean, lower (of the bad rate)."""
    seen = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    every = hosts.select("host").distinct().join(seen, "host", "full_outer").fillna(0, ["n", "b"])
    host = staged(with_levels(every, suffixes), "hosts")  # one row a host, read by every level
    domain = host.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    n, b = F.col("n"), F.col("b")
    sums = lambda df: df.where(n > 0).agg(F.count("*"), F.sum(n), F.sum(b), F.sum(n.cast("double") * n), F.sum(b.cast("double") * b / n)).first()
    at_host, at_domain, at_suffix = sums(host), sums(domain), sums(suffix)
    total, bad = at_host[1] or 0, at_host[2] or 0
    overall = (bad + 0.5) / (total + 1.0)
    kh, kd, ks = strength(at_host), strength(at_domain), strength(at_suffix)
    s = suffix.select("suffix", ((b + ks * overall) / (n + ks)).alias("_ms"))
    d = domain.join(s, "suffix").select("domain", ((b + kd * F.col("_ms")) / (n + kd)).alias("_md"))
    alpha, beta = b + kh * F.col("_md"), n - b + kh * (1 - F.col("_md"))
    mean = alpha / (alpha + beta)
    sd = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return host.join(d, "domain").select("host", n.alias("labelled"), mean.alias("mean"), F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url), outcomes(url, bad) -> page_id, host, path, rule, verdict, labelled, bad_mean, bad_lower."""
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), "bad").select(host.alias("host"), "bad")
    known = reputation(cut, seen, z, suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = cut.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"), "labelled", F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    own = F.when(F.col("bad_lower") > threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_v", own)).select("page_id", "host", "path", "rule", "verdict", "labelled", "bad_mean", "bad_lower")
