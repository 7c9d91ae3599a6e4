"""Empirical-Bayes host reputation and rules over URLs.

Labelled pages give each host a count of bad outcomes. Beta-binomial priors shrink it through three levels: a suffix towards
all pages, a registered domain towards its suffix, a host towards its domain. The strength of each level's prior is fitted by
the method of moments from how far its groups stray from their parents. A host is blocked if the lower bound of its
posterior bad rate, the BOUND quantile of its beta distribution, is over a threshold, so a host with few labels is judged by
its parents. Rules by host and path prefix come first; of the rules that fit, the longest decides.

Outcomes are counted for each page shown and host before they are joined, so neither a very common page nor a very common
host is a hot group; only the result's join has a row per page, against a checkpointed table of hosts.

Nulls and odd input: a null URL or one without :// has an empty host and path and is judged as the host ''; labels that are null
are no outcomes; a host without labels has its domain's rate; repeated pages are judged alike but count once for
each row; without any label the rate is 0 and nothing is blocked; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed

#: Suffixes of two labels under which domains are registered; a parameter.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
BOUND, BLOCK_OVER = 0.05, 0.3
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), A_Z, A_Z.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_levels(hosts: DataFrame, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """hosts with domain and suffix; login and port don't count."""
    name = F.regexp_replace(F.col("host"), r"^.*@|:\d*$", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)\.?$", 1)
    three = F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)\.?$", 1)
    domain = F.when(two.isin(*suffixes) & (three != ""), three).when(two != "", two).otherwise(name)
    return hosts.withColumn("domain", domain).withColumn("suffix", F.regexp_extract("domain", r"\.(.*)$", 1))


def _strength(groups: DataFrame) -> float:
    """Prior strength from (n, k, m): group sizes, bad counts and the parents' means; moments of the beta-binomial."""
    spread = F.col("m") * (1 - F.col("m"))
    got = groups.where("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) / F.col("n")).alias("s"), F.sum(spread).alias("a"), F.sum(spread * (F.col("n") - 1)).alias("b")).first()
    if not got.b:
        return 1.0
    rho = min(0.5, max(1e-4, (got.s - got.a) / got.b))
    return 1 / rho - 1


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of a beta distribution under x, by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out, m = d.copy(), 0
    while True:
        m += 1
        was = out.copy()
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if m > 10_000 or np.all(np.abs(out - was) <= 1e-12 * np.abs(out)):
            break
    return np.where(flip, 1 - front * out, front * out)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By halving; 0 where a is nought."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    some = np.maximum(a, 1e-9), np.maximum(b, 1e-9)
    for _ in range(45):
        mid = (lo + hi) / 2
        under = beta_below(mid, *some) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return np.where(a > 0, np.where(b > 0, (lo + hi) / 2, 1.0), 0.0)


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = TWO_PART_SUFFIXES, bound: float = BOUND) -> DataFrame:
    """(host, n_labelled, n_bad, bad_rate, bad_low, suffix_strength, domain_strength, host_strength) of each host in outcomes (host, n labelled pages, k bad ones)."""
    counts = outcomes.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    counts = checkpointed(with_levels(counts, suffixes))
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    parents = counts.select("suffix").distinct().withColumn("m", F.lit(total.k / total.n if total.n else 0.0))
    strengths = {}
    for level, key in (("suffix", "suffix"), ("domain", "suffix"), ("host", "domain")):
        groups = counts.groupBy(level, *([key] if key != level else [])).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(parents, key)
        s = strengths[level] = _strength(groups)
        parents = groups.select(level, ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m"))
    rated = groups.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("bad_rate"))

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            weight = f.n_labelled + s
            yield f.assign(bad_low=beta_quantile(bound, (weight * f.bad_rate).to_numpy(float), (weight * (1 - f.bad_rate)).to_numpy(float)))

    lowest = rated.mapInPandas(bounded, "host string, n_labelled long, n_bad long, bad_rate double, bad_low double")
    return lowest.select("*", *[F.lit(v).alias(f"{k}_strength") for k, v in strengths.items()])


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule = said = None
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = (F.concat(F.lit("."), host).endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        said = F.when(fits, F.lit(verdict)) if said is None else said.when(fits, F.lit(verdict))
    return (rule, said) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judged_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The digest of op1. A page shows the document whose number is in its path; its outcome is bad if that one's quality is 0."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    shown = parts.groupBy("host", F.regexp_extract("path", r"^/[^/]*/([0-9]+)", 1).try_cast("long").alias("shown")).agg(F.count(F.lit(1)).alias("pages"))
    shown = checkpointed(shown)
    bad = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("shown")).agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    labelled = shown.where("shown is not null").join(bad, "shown").select("host", F.col("pages").alias("n"), (F.col("pages") * F.col("bad")).alias("k"))
    every = shown.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    known = checkpointed(reputation(labelled.unionByName(every)))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > BLOCK_OVER, F.lit("block")).otherwise(F.lit("allow"))
    told = [F.round(c, 6).alias(c) for c in ("bad_rate", "bad_low", "suffix_strength", "domain_strength", "host_strength")]
    return parts.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "n_labelled", "n_bad", *told)


def _level_sql(level: str, key: str) -> str:
    """A level's groups, strength and means in the oracle."""
    return f"""
{level}_g AS (SELECT c.{level}, c.{key} AS up, sum(n) AS n, sum(k) AS k FROM counts c GROUP BY c.{level}, c.{key}),
{level}_m AS (SELECT g.{level}, g.n, g.k, p.m FROM {level}_g g JOIN {'root' if level == 'suffix' else key + '_p'} p ON g.up = p.{key}),
{level}_s AS (SELECT coalesce((SELECT 1 / least(0.5::DOUBLE, greatest(1e-4::DOUBLE, (sum(pow(k - n * m, 2) / n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0))) - 1 FROM {level}_m WHERE n > 0), 1) AS s),
{level}_p AS (SELECT {level}, n, k, (k + s * m) / (n + s) AS m, s FROM {level}_m, {level}_s)"""


def _series(x: str, a: str, b: str) -> str:
    return f"list_sum(list_transform(range(2000), lambda i: exp((i + {a}) * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b} + i) - lgamma({b}) - lgamma({a} + 1 + i))))"


#: The share of a beta distribution (a, b) under x, by its power series from the nearer end.
_BELOW = f"CASE WHEN x > a / (a + b) THEN 1 - {_series('(1 - x)', 'b', 'a')} ELSE {_series('x', 'a', 'b')} END"
ORACLE = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{A_Z}', '{A_Z.lower()}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) AS BIGINT) AS shown FROM u),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
named AS (SELECT host, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM v LEFT JOIN bad ON shown = doc_id GROUP BY host),
two AS (SELECT *, regexp_extract(name, '([^.]+\.[^.]+)\.?$', 1) AS two, regexp_extract(name, '([^.]+\.[^.]+\.[^.]+)\.?$', 1) AS three FROM named),
domains AS (SELECT *, CASE WHEN two IN ({", ".join(f"'{x}'" for x in TWO_PART_SUFFIXES)}) AND three <> '' THEN three WHEN two <> '' THEN two ELSE name END AS domain FROM two),
counts AS (SELECT host, domain, regexp_extract(domain, '\.(.*)$', 1) AS suffix, n, k FROM domains),
root AS (SELECT DISTINCT suffix, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0)::DOUBLE FROM counts) AS m FROM counts),
{_level_sql("suffix", "suffix")},{_level_sql("domain", "suffix")},{_level_sql("host", "domain")},
h AS (
  SELECT host, n, k, m, (n + s) * m AS a, (n + s) * (1 - m) AS b, s AS host_strength, (SELECT s FROM suffix_s) AS suffix_strength, (SELECT s FROM domain_s) AS domain_strength FROM host_p),
halves AS (
  SELECT host, a, b, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.5::DOUBLE AS x, 0 AS step FROM h WHERE a > 0 AND b > 0
  UNION ALL
  SELECT host, a, b, CASE WHEN under THEN x ELSE lo END, CASE WHEN under THEN hi ELSE x END, CASE WHEN under THEN (x + hi) / 2 ELSE (lo + x) / 2 END, step + 1
  FROM (SELECT *, {_BELOW} < {BOUND} AS under FROM halves WHERE step < 45) AS z),
low AS (SELECT host, x FROM halves WHERE step = 45),
j AS (
  SELECT page_id, v.host, path, h.*EXCLUDE (host), CASE WHEN a <= 0 THEN 0 WHEN b <= 0 THEN 1 ELSE x END AS low,
         CASE {" ".join(f"WHEN ends_with('.' || v.host, '.{t.partition('/')[0]}') AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'" for _, t in sorted(RULES, key=lambda r: -len(r[1])))} END AS rule
  FROM v JOIN h USING (host) LEFT JOIN low USING (host))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in RULES)} WHEN low > {BLOCK_OVER} THEN 'block' ELSE 'allow' END AS verdict,
       n::BIGINT AS n_labelled, k::BIGINT AS n_bad, round(m, 6) AS bad_rate, round(low, 6) AS bad_low,
       round(suffix_strength, 6) AS suffix_strength, round(domain_strength, 6) AS domain_strength, round(host_strength, 6) AS host_strength
FROM j
"""
