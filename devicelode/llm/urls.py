"""URL filter: rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import ascii_lower, saved

#: (host, path, verdict) of the contract; hand-written lists like this one are short.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")]
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
            "edu.au", "gov.uk", "net.au", "org.au", "org.uk"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what) -> Column:
    """``what(rule)`` of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(what((h, p, v))))
            for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix); a host of one label is its own domain and suffix."""
    two = F.substring_index(host, ".", -2)
    double = two.isin(suffixes)
    return (F.when(double, F.substring_index(host, ".", -3)).otherwise(two),
            F.when(double, two).otherwise(F.substring_index(host, ".", -1)))


def _strength(stats: DataFrame, weakest: float = 1.0, strongest: float = 1e4) -> float:
    """Prior strength by moments: how far rates (bad of n) scatter about their parent's ``mean`` beyond binomial noise."""
    spread = F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) - F.col("n") * F.col("mean") * (1 - F.col("mean"))
    room = F.col("n") * (F.col("n") - 1) * F.col("mean") * (1 - F.col("mean"))
    over, most = stats.agg(F.sum(spread), F.sum(room)).first()
    if not most or not over or over <= 0:
        return strongest
    return min(strongest, max(weakest, most / over - 1))


def _shrunk(stats: DataFrame, strength: float) -> tuple[Column, Column]:
    """Parameters of the posterior beta under the parent's mean."""
    return F.col("mean") * strength + F.col("bad"), (1 - F.col("mean")) * strength + F.col("n") - F.col("bad")


def beta_quantile(a: np.ndarray, b: np.ndarray, part: float, points: int = 1024, rows: int = 512) -> np.ndarray:
    """Quantiles of beta distributions, to about five digits.

    Over log odds the density is smooth and falls off on both sides at least as fast as exp(-a y) and exp(-b y), also where a or b is
    under 1; so it is summed there on a grid of ``points`` on each side of its mode, ``rows`` distributions at a time.
    """
    out = np.empty(len(a))
    for at in range(0, len(a), rows):
        p, q = a[at:at + rows, None], b[at:at + rows, None]
        sd = np.sqrt(1 / p + 1 / q)
        step = np.linspace(0, 12, points)
        y = np.log(p / q) + np.hstack([-(step[:0:-1] * np.maximum(sd, 1 / p)), step * np.maximum(sd, 1 / q)])
        logs = -p * np.logaddexp(0, -y) - q * np.logaddexp(0, y)
        height = np.exp(logs - logs.max(axis=1, keepdims=True))
        mass = np.cumsum((height[:, 1:] + height[:, :-1]) / 2 * np.diff(y), axis=1)
        mass = np.hstack([np.zeros((len(p), 1)), mass / mass[:, -1:]])
        out[at:at + rows] = [np.interp(part, m, v) for m, v in zip(mass, y, strict=True)]
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _bound(part: float):
    return F.pandas_udf(lambda a, b: pd.Series(beta_quantile(a.to_numpy(), b.to_numpy(), part)), "double")


def host_reputation(pages: DataFrame, suffixes: list[str] = SUFFIXES, doubt: float = 0.05) -> DataFrame:
    """``host, domain, suffix, n, bad, rate, lower`` for every host of ``pages`` (host, bad: 0, 1 or null for unlabelled).

    Rates are shrunk from the whole to suffix, registered domain and host: the posterior mean of one level is the prior
    mean of the next, with a strength fitted over all units of that level. Hosts without labels keep their domain's. ``lower`` is the ``doubt`` quantile of the host's
    posterior. A suffix that isn't among ``suffixes``, the registry's names of two labels, is the last label.
    """
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = saved(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1.0)
    total = lambda df, key, *more: df.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    ends = total(hosts, "suffix").withColumn("mean", F.lit(overall))
    a, b = _shrunk(ends, _strength(ends))
    ends = ends.select("suffix", (a / (a + b)).alias("mean"))
    domains = saved(total(hosts, "domain", "suffix").join(ends, "suffix"), "domains")
    a, b = _shrunk(domains, _strength(domains))
    domains = domains.select("domain", (a / (a + b)).alias("mean"))
    hosts = saved(hosts.join(domains, "domain"), "hosts")
    a, b = _shrunk(hosts, _strength(hosts))
    return hosts.select("host", "domain", "suffix", "n", "bad", (a / (a + b)).alias("rate"), _bound(doubt)(a, b).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, tolerated: float = 0.25,
          doubt: float = 0.05, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, lower`` for every row of ``pages`` (page_id, url).

    ``outcomes`` (url, bad 0 or 1) are the labelled outcomes. Where no rule fits, a page is blocked if the lower bound of its host's bad rate,
    the ``doubt`` quantile of the posterior, is above ``tolerated``. Null urls and urls without ``://`` have the empty
    host, which is judged like any other. Repeated rows are judged each; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    known = outcomes.select(host.alias("host"), F.col("bad").cast("int").alias("bad"))
    seen = pages.select(host.alias("host"), F.lit(None).cast("int").alias("bad"))
    hosts = saved(host_reputation(known.unionByName(seen), suffixes, doubt).select("host", "rate", "lower"), "rates")
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).join(hosts, "host")
    fit = lambda what: rule_of(F.col("host"), F.col("path"), rules, what)
    own = F.when(F.col("lower") > tolerated, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", fit(lambda r: r[0] + r[1]).alias("rule"),
                         F.coalesce(fit(lambda r: r[2]), own).alias("verdict"), "rate", "lower")
