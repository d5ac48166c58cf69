"""URL filter: explicit rules, and host reputations shrunk from host to domain to suffix.

Labelled pages are outcomes (bad or not) of their hosts. A level's rate of bad pages is the mean of
a beta distribution whose prior comes from the level above: all pages, suffix, registered domain,
host. How strongly a level is drawn to the one above is estimated from the data, by the spread of
its groups' rates. A page is blocked where a lower quantile of its host's rate exceeds the rate of
all pages: by default, where the host is twice as likely to be worse than the average as not.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import new_folder, stored
from pulsepress.operators.joins import attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are few and become one expression; more than this many is an error.
MOST_RULES = 500
#: Registered under these endings, a domain has one label more. Else the last label is the suffix.
SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: A page is blocked where the lower bound of its host's rate is over this many times the rate of all pages.
BLOCK_RATIO = 1.0
#: The lower bound is this quantile of a host's rate: odds of two to one that the rate is higher.
BOUND = 1 / 3
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the host ends in, or its last label."""
    found = F.substring_index(host, ".", -1)
    for suffix in sorted(suffixes, key=lambda x: (len(x), x)):
        found = F.when((host == suffix) | host.endswith("." + suffix), F.lit(suffix)).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with the label before it; the host itself where it is its own suffix."""
    before = host.substr(F.lit(1), F.length(host) - F.length(suffix) - 1)
    joined = F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix)
    return F.when(host == suffix, host).otherwise(joined)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (verdict, host, path) that fits, else NULLs."""
    rules = sorted(rules, key=lambda x: (len(x[1] + x[2]), x[1] + x[2]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in rules:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame) -> float:
    """How many prior pages a level's groups count for, by the method of moments.

    ``groups`` has n, bad and the mean of the group above. The spread of rates beyond what chance
    explains gives the strength; without any spread it is the largest.
    """
    rate = F.col("bad") / F.col("n")
    chance = F.col("above") * (1 - F.col("above"))
    sums = groups.agg(
        F.sum(F.col("n") * chance).alias("chance"),
        F.sum(F.col("n") * (rate - F.col("above")) * (rate - F.col("above")) - chance).alias("spread"),
    ).first()
    if not sums.chance or sums.spread <= 0:
        return MOST_STRENGTH
    # The excess variance is of the order 1 / (strength + 1).
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, sums.chance / sums.spread - 1))


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of the beta distribution with ``a`` and ``b`` that lies below ``x``, by its continued fraction."""
    swap = x > (a + 1) / (a + b + 2)  # the fraction ends early on the other side of the mean only
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b) - np.log(a)
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, value = np.ones_like(x), d.copy()
    # As many terms as the square root of the larger parameter asks for.
    for m in range(1, 50 + int(5 * math.sqrt(max(a.max(initial=1.0), b.max(initial=1.0))))):
        before = value
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(value - before) <= 1e-13 * np.abs(value)):
            break
    below = np.exp(front) * value
    return np.where(swap, 1 - below, below)


def beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distribution with ``a`` and ``b`` has ``share`` of its mass below, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        middle = (low + high) / 2
        under = beta_share(middle, a, b) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _bounded(lower: float):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean = batch.column("mean").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            # Many hosts have the same counts.
            shapes, which = np.unique(np.stack([mean * weight, (1 - mean) * weight], 1), axis=0, return_inverse=True)
            values = beta_quantile(lower, shapes[:, 0], shapes[:, 1])[which.reshape(-1)]
            yield batch.append_column("lower", pa.array(values, pa.float64()))

    return bound


def reputations(hosts: DataFrame, suffixes: Iterable[str] = SUFFIXES, lower: float = BOUND) -> DataFrame:
    """Rate of bad pages of every host: host, n, bad, level, overall, mean, weight, lower.

    ``hosts`` has one row per host with n and bad, zero where a host has no labelled page; NULL is a
    host like any other. The rate is beta distributed with ``mean`` and ``weight`` (the sum of its two
    parameters), ``lower`` is its quantile of that share. ``level`` says what the rate comes from: the
    host's own pages, else its domain, suffix, or all pages; hosts without pages have the prior of a
    host there, as weak as the weakest level in between. ``overall`` is the rate of all pages.
    """
    folder = new_folder(hosts)
    named = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    named = stored(named.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), folder, "hosts")
    seen = named.filter(F.col("n") > 0)

    def summed(by: str, *more: str) -> DataFrame:
        return seen.groupBy(by, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def under(groups: DataFrame, above: DataFrame, by: str, key: str) -> DataFrame:
        return attach(groups, above.select(by, F.col("mean").alias("above")), by, spread=key)

    def level(groups: DataFrame, name: str) -> tuple[DataFrame, float]:
        strength = _strength(groups)
        mean = (F.col("above") * strength + F.col("bad")) / (F.col("n") + strength)
        posterior = groups.withColumn("mean", mean).withColumn("weight", F.col("n") + strength)
        return stored(posterior, folder, name), strength

    total = seen.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 1.0) / ((total.n or 0) + 2.0)
    suffix, of_suffixes = level(summed("suffix").withColumn("above", F.lit(overall)), "suffixes")
    domain, of_domains = level(under(summed("domain", "suffix"), suffix, "suffix", "domain"), "domains")
    host, of_hosts = level(under(seen.select("host", "domain", "n", "bad"), domain, "domain", "host"), "seen")
    host = host.select("host", "n", "bad", F.lit("host").alias("level"), "mean", "weight")
    unseen = named.filter(F.col("n") == 0)
    unseen = attach(unseen, domain.select("domain", F.col("mean").alias("of_domain")), "domain", spread="host")
    unseen = attach(unseen, suffix.select("suffix", F.col("mean").alias("of_suffix")), "suffix", spread="host")

    def nearest(of_domain: Column, of_suffix: Column, of_all: Column) -> Column:
        return F.when(F.col("of_domain").isNotNull(), of_domain).when(F.col("of_suffix").isNotNull(), of_suffix).otherwise(of_all)

    strengths = (of_hosts, min(of_hosts, of_domains), min(of_hosts, of_domains, of_suffixes))
    unseen = unseen.select(
        "host",
        "n",
        "bad",
        nearest(F.lit("domain"), F.lit("suffix"), F.lit("all")).alias("level"),
        nearest(F.col("of_domain"), F.col("of_suffix"), F.lit(overall)).alias("mean"),
        nearest(*[F.lit(float(x)) for x in strengths]).alias("weight"),
    )
    every = host.unionByName(unseen).withColumn("overall", F.lit(overall))
    every = every.select("host", "n", "bad", "level", "overall", "mean", F.col("weight").cast("double").alias("weight"))
    return every.mapInArrow(
        _bounded(lower), "host string, n long, bad long, level string, overall double, mean double, weight double, lower double"
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    id: str = "page_id",
    url: str = "url",
    suffixes: Iterable[str] = SUFFIXES,
    block_ratio: float = BLOCK_RATIO,
    lower: float = BOUND,
) -> DataFrame:
    """Verdict on every page: id, host, path, rule, verdict, n_labelled, level, mean, lower.

    ``outcomes`` has the id of a page and ``bad`` (0 or 1); pages with several outcomes count each,
    outcomes with a NULL id or NULL ``bad`` none, and so do outcomes of an unknown page. Where a
    rule (verdict, host, path) fits, the longest decides (of equally long ones the last in the order of
    their text); else the page is blocked if the bound of its host's rate of bad pages, its quantile
    ``lower``, is over ``block_ratio`` times the rate of all pages. ``level``, ``mean`` and ``lower`` are
    what `reputations` gives for the host. A URL that is NULL or has no ``://`` has the empty host,
    which gathers a reputation like any other; a URL may be of any length. Repeated rows are judged each; other columns
    of ``pages`` and ``outcomes`` are not read. Without outcomes every page no rule fits is allowed.
    """
    folder = new_folder(pages)
    link = F.col(url)
    split = pages.select(F.col(id).alias(id), host_of(link).alias("host"), path_of(link).alias("path"))
    split = stored(split, folder, "split")
    marked = outcomes.select(F.col(id), F.col("bad").cast("long").alias("bad"))
    marked = marked.filter(F.col(id).isNotNull() & F.col("bad").isNotNull())
    marked = marked.groupBy(id).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    labelled = split.select(id, "host").join(marked, id, "left")
    hosts = labelled.groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    known = stored(reputations(stored(hosts, folder, "counts"), suffixes, lower), folder, "reputations")
    judged = attach(split, known, "host", spread=[id, "path"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > block_ratio * F.col("overall"), "block").otherwise("allow")
    return judged.select(
        id,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
        F.col("n").alias("n_labelled"),
        "level",
        "mean",
        "lower",
    )
