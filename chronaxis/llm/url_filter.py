"""URL rules and empirical-Bayes host reputation.

A list of rules decides the urls that it covers.  All other urls are judged by
their host's reputation: labelled page outcomes (by default, what the rules say of
the host's other pages) are counted for host, registered domain and public suffix,
and shrunk from the top down through beta-binomial priors.  The mean of each
level's prior is the posterior mean of the level above, its strength is estimated
from the spread of the groups by the method of moments.  A host is blocked where
the ``BOUND`` quantile of its beta posterior, the lower bound of its bad rate, is over
one half.

Suffixes come from a table in the syntax of the public suffix list (``com``,
``*.ck``, ``!www.ck``); without one, ``TWO_LABEL_SUFFIXES`` and last labels serve.

Cases: a null url, or one without ``://``, has an empty host and path and is judged
by the overall rate; no labelled outcome at all: allow; repeated rows each return a
row; an empty table gives no rows; only the id and the url are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import checkpointed, join_to_groups

#: Suffixes of two labels below which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
BOUND = 0.05
THRESHOLD = 0.5
#: A suffix table of up to this many rows is broadcast; the public list has about ten thousand.
FEW_SUFFIXES = 100_000


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest that fits, or nulls; for lists written in code.  Of equal length, the first wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    rule = verdict = F.lit(None).cast("string")
    for says, text in reversed(ordered):
        h, p = split_rule(text)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def registered_by(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (distinct ``host``) with ``domain`` and ``suffix`` by a table of suffix rules (``suffix``).

    An exception (``!``) comes before all else, then the rule of most labels; a host
    that fits none has its last label as suffix.  A host that is a suffix is its own domain.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tail = lambda i: F.array_join(F.slice(labels, i, n), ".")
    tried = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.array(
                F.struct(tail(i).alias("rule"), F.lit(0).alias("first"), (n - i + 1).alias("size")),
                F.struct(F.concat(F.lit("*."), tail(i + 1)).alias("rule"), F.lit(0).alias("first"), (n - i + 1).alias("size")),
                F.struct(F.concat(F.lit("!"), tail(i)).alias("rule"), F.lit(1).alias("first"), (n - i).alias("size")),
            ),
        )
    )
    rules = suffixes.select(F.lower(F.trim("suffix")).alias("rule")).distinct()
    if rules.limit(FEW_SUFFIXES + 1).count() <= FEW_SUFFIXES:
        rules = F.broadcast(rules)
    best = hosts.select("host", F.explode(tried).alias("t")).select("host", "t.*").join(rules, "rule").groupBy("host").agg(F.max(F.struct("first", "size")).alias("best"))
    size = F.coalesce("best.size", F.lit(1))
    made = hosts.join(best, "host", "left").withColumn("__size", size)
    return made.withColumns({"domain": F.array_join(F.slice(labels, F.greatest(n - F.col("__size"), F.lit(1)), n), "."), "suffix": F.array_join(F.slice(labels, F.greatest(n - F.col("__size") + 1, F.lit(1)), n), ".")}).drop("best", "__size")


def beta_quantile(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """The ``q`` quantile of each beta distribution, by bisecting its distribution function."""
    log_beta = np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    def below(x: np.ndarray) -> np.ndarray:
        """The distribution function; its continued fraction is taken from the nearer end."""
        turn = x > (a + 1) / (a + b + 2)
        p, r, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
        front = np.exp(p * np.log(y) + r * np.log1p(-y) - log_beta) / p
        c, d = np.ones_like(y), 1 / (1 - (p + r) * y / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            change = np.ones_like(y)
            for t in (m * (r - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + r + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + t * d) > 1e-290, 1 + t * d, 1e-290)
                c = 1 + t / np.where(np.abs(c) > 1e-290, c, 1e-290)
                change = change * d * c
                h = h * d * c
            if (np.abs(change - 1) < 1e-12).all():
                break
        return np.where(turn, 1 - front * h, front * h)

    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(52):
        mid = (low + high) / 2
        under = below(mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def lower_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), BOUND))


def _strength(groups: DataFrame, mean: Column, low: float = 2.0, high: float = 200.0) -> float:
    """Prior strength by moments: how much the groups' rates spread beyond chance around ``mean``."""
    rate, n = F.col("bad") / F.col("n"), F.col("n").cast("double")
    made = groups.filter("n >= 2").agg(F.sum(n * F.pow(rate - mean, 2)), F.sum(n * mean * (1 - mean)), F.sum(mean * (1 - mean)), F.count("*")).first()
    spread, chance, floor, k = (x or 0.0 for x in made)
    excess = spread - floor  # of n (rate - mean)^2, mean (1 - mean) is chance
    if k < 2 or chance <= 0 or excess <= 0:
        return high
    return min(high, max(low, (chance - excess) / excess))


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``host, n_pages, bad_mean, bad_low`` from ``host, bad`` (null: unlabelled; rows of all pages).

    Hosts without outcomes get their domain's posterior, and so on up.
    """
    labelled = F.col("bad").isNotNull()
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.sum(F.when(labelled, F.col("bad").cast("long")).otherwise(0)).alias("bad"))
    if suffixes is None:
        domain, suffix = registered(F.col("host"))
        hosts = checkpointed(hosts.withColumns({"domain": domain, "suffix": suffix}))
    else:
        hosts = checkpointed(registered_by(checkpointed(hosts), suffixes))
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts")))
    tops = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains")))
    n, bad = (x or 0 for x in tops.agg(F.sum("n"), F.sum("bad")).first())
    mean = F.lit((bad + 1.0) / (n + 2.0) if n else 0.0)

    def posterior(groups: DataFrame, prior: Column, name: str) -> DataFrame:
        k = _strength(groups.withColumn("__m", prior), F.col("__m"))
        return groups.withColumns({name: (F.col("bad") + k * prior) / (F.col("n") + k), "__k": F.lit(k)})

    tops = posterior(tops, mean, "top_mean").select("suffix", "top_mean", "domains")
    domains = posterior(checkpointed(join_to_groups(domains, tops, "suffix", "domains")), F.col("top_mean"), "domain_mean").select("domain", "domain_mean", "hosts")
    hosts = posterior(checkpointed(join_to_groups(hosts, domains, "domain", "hosts")), F.col("domain_mean"), "bad_mean")
    total = F.col("n") + F.col("__k")
    # A rate of exactly 0 or 1 has no spread; the bound is the rate.
    inside = (F.col("bad_mean") > 0) & (F.col("bad_mean") < 1)
    safe = F.when(inside, F.col("bad_mean")).otherwise(0.5)
    low = F.when(inside, lower_bound(total * safe, total * (1 - safe))).otherwise(F.col("bad_mean"))
    return hosts.select("host", "n_pages", "bad_mean", low.alias("bad_low"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame | None = None, suffixes: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_mean, bad_low`` for each row.

    ``outcomes`` (``host, bad``) are further labelled pages, ``suffixes`` a table of suffix rules.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    seen = rows.select("host", F.when(F.col("says").isNotNull(), F.col("says") == "block").alias("bad"))
    known = checkpointed(reputations(seen if outcomes is None else seen.unionByName(outcomes.select("host", F.col("bad").cast("boolean").alias("bad"))), suffixes))
    judged = join_to_groups(rows, known, "host", "n_pages")
    verdict = F.coalesce("says", F.when(F.col("bad_low") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_mean", "bad_low")
