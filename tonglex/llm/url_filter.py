"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host and path, verdict); the longest rule that fits decides.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words between dots and hyphens of a host that label a training URL as unwanted.
SEED_WORDS = frozenset("spam casino pills adult bets ads porn xxx viagra betting malware phishing warez".split())
#: The trees are fitted on so many labelled URLs at most, those with the lowest hash.
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is the longest
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


NAMES = ("url_length", "host_length", "path_depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "longest_label", "suffix1", "suffix2")


def suffixes(host: str) -> tuple[str, str]:
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


def features(url: str | None, suffix_rate: dict[str, float], prior: float) -> list[float]:
    u = url or ""
    m = re.search(r"://([^/?#]*)([^?#]*)", u)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    n = max(1, len(u))
    counts = Counter(host)
    h = max(1, len(host))
    entropy = -sum(c / h * np.log2(c / h) for c in counts.values())
    query = u.partition("?")[2].partition("#")[0]
    s1, s2 = suffixes(host)
    parts = host.split(".")
    return [
        len(u), len(host), path.count("/"), sum(c.isdigit() for c in host) / n, entropy, query.count("=") or bool(query), len(parts),
        host.count("-"), max(map(len, parts)), suffix_rate.get(s1, prior), suffix_rate.get(s2, prior),
    ]


@dataclass
class Trees:
    """Regression trees of equal depth as arrays: node i has children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    inner = 2**depth - 1
    n, d = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    cuts = []  # every value, or quantiles where there are many
    for j in range(d):
        u = np.unique(x[:, j])
        cuts.append(u[:-1] if len(u) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    score = np.full(n, base)
    feature, cut, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            here = node == k
            if not here.any():
                node[here] = 2 * k + 1
                continue
            gain_best = 1e-9
            gs, hs = g[here].sum(), h[here].sum()
            for j in range(d):
                if not len(cuts[j]):
                    continue
                b = binned[j][here]
                gl = np.cumsum(np.bincount(b, g[here], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[here], len(cuts[j]) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                if gain.max() > gain_best:
                    gain_best, feature[t, k], cut[t, k] = gain.max(), j, cuts[j][gain.argmax()]
            node[here] = 2 * k + 1 + (x[here, feature[t, k]] > cut[t, k])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -rate * gl / (hl + ridge)
        score += value[t][leaf]
    return Trees(feature, cut, value, base)


@dataclass
class UrlModel:
    trees: Trees
    suffix_rate: dict[str, float]
    prior: float

    def block(self, urls: list[str | None]) -> np.ndarray:
        x = np.array([features(u, self.suffix_rate, self.prior) for u in urls], dtype=float).reshape(-1, len(NAMES))
        return self.trees.score(x) > 0


def fit(urls: list[str], labels: list[int], smoothing: float = 20.0) -> UrlModel:
    """Suffix rates, smoothed towards the prior, then trees. 1: block."""
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    seen, bad = Counter(), Counter()
    for u, y in zip(urls, labels, strict=True):
        m = re.search(r"://([^/?#]*)", u)
        for s in set(suffixes(m[1].lower() if m else "")):
            seen[s] += 1
            bad[s] += y
    rate = {s: (bad[s] + smoothing * prior) / (n + smoothing) for s, n in seen.items()}
    x = np.array([features(u, rate, prior) for u in urls], dtype=float).reshape(-1, len(NAMES))
    return UrlModel(fit_trees(x, np.array(labels, dtype=float)), rate, prior)


def seed_label(host: Column) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, sorted(SEED_WORDS)))).cast("int")


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, y): the URLs of pages with labels from the seed words of their hosts."""
    return pages.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct().select("url", seed_label(host_of(F.col("url"))).alias("y"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, by_method for every row.

    `labelled`: (url, y) with y 1 for unwanted; the trees see `sample` of them at most. Defined results: a null
    url, or one without ://, has an empty host and path, fits no rule and is judged by its features; null
    page_ids and repeated rows stay; with no labelled URL everything outside the rules is allowed.
    """
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    model = fit([r["url"] for r in rows], [r["y"] for r in rows])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column("url").to_pylist()
            todo = [i for i, r in enumerate(b.column("rule").to_pylist()) if r is None]
            block = np.zeros(b.num_rows, dtype=bool)
            block[todo] = model.block([urls[i] for i in todo])
            cols = [b.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(block)], names=["page_id", "host", "path", "rule", "by_method"])

    url = F.col("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    p = p.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    p = p.mapInArrow(judge, "page_id long, host string, path string, rule string, by_method boolean")
    said = F.lit(None).cast("string")
    for text, verdict in rules:
        said = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(said)
    return p.select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("by_method"), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_urls(pages))
