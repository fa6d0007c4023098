"""URL filtering: host and path rules, and gradient-boosted trees on lexical features elsewhere.

Rules are matched by host suffix and path prefix; the longest one decides.  URLs
without a rule get the verdict of boosted trees over length, depth, digit ratio, entropy,
parameter counts and suffix statistics.  The trees are trained from labelled URLs: a table
of the caller's (``labelled``), or else the policy's own verdicts, where a URL that no rule
names counts as allowed with the weight ``free_weight``.  No list of words is involved.

Suffix statistics are smoothed shares of blocked URLs by top-level label, by the last two
labels of the host and by the first segment of the path, over all labelled URLs of the
sample.  Those that a tree is trained on come from hosts of the other half, so no host
vouches for itself; :func:`held_out_auc` measures the ranking on hosts never trained on.

Defined cases: a null URL or one without ``://`` has empty host and path and is judged on
empty features; equal URLs get equal verdicts, each row its own; a probability of one half
blocks; very long URLs are read whole, in time proportional to their length; without
labelled URLs of both kinds the trees give the share of blocked ones; an empty table gives
no row; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("length", "host_length", "host_depth", "host_digits", "host_hyphens", "host_entropy", "longest_label", "path_length", "path_depth", "path_digits", "path_entropy", "parameters", "query_length", "fragment", "https", "extension", "top_rate", "suffix_rate", "segment_rate")
_SPLIT = re.compile(r"[/?#]")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = _SPLIT.search(rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def match_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fitting rule."""
    best = None
    for verdict, rule_host, rule_path in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            name = rule_host + rule_path
            if best is None or len(name) > len(best[0]):
                best = (name, verdict)
    return best


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """The keys of the suffix statistics: last label, last two labels, first segment of the path."""
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:]), path[1:].partition("/")[0]


@dataclass
class SuffixStats:
    """Smoothed share of blocked URLs, by each key of :func:`suffixes`; unknown keys have the overall share."""

    prior: float = 0.5
    rate: list[dict[str, float]] = field(default_factory=lambda: [{}, {}, {}])

    @classmethod
    def fit(cls, keys: list[tuple[str, str, str]], blocked: np.ndarray, weight: np.ndarray, smooth: float = 10.0) -> SuffixStats:
        total = float(weight.sum())
        out = cls(float((weight * blocked).sum()) / total if total else 0.5)
        for k in range(3):
            n, b = Counter(), Counter()
            for key, y, w in zip(keys, blocked, weight, strict=True):
                n[key[k]] += w
                b[key[k]] += w * y
            out.rate[k] = {key: float((b[key] + smooth * out.prior) / (n[key] + smooth)) for key in n}
        return out

    def rates(self, keys: tuple[str, str, str]) -> list[float]:
        return [self.rate[k].get(key, self.prior) for k, key in enumerate(keys)]


def lexical(url: str | None, host: str, path: str, stats: SuffixStats) -> list[float]:
    url = url or ""
    before, _, fragment = url.partition("#")
    query = before.partition("?")[2]
    digits = lambda s: sum(c in "0123456789" for c in s) / max(1, len(s))
    leaf = path.rsplit("/", 1)[-1]
    return [len(url), len(host), host.count("."), digits(host), host.count("-"), entropy(host), max(map(len, host.split("."))), len(path), path.count("/"), digits(path), entropy(path), query.count("=") + query.count("&"), len(query), bool(fragment), url[:6].lower() == "https:", "." in leaf, *stats.rates(suffixes(host, path))]


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at]


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, l2: float, least: float) -> Tree:
    """A complete tree by histogram splits, level by level; a node without a gain sends all rows left."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.zeros(size)
    node = np.zeros(len(binned), dtype=np.int64)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        local = node - first
        best = np.zeros(width)
        for f, e in enumerate(edges):
            bins = len(e) + 1
            if bins < 2:
                continue
            key = local * bins + binned[:, f]
            g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
            h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
            gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            at = gain.argmax(axis=1)
            top = gain[np.arange(width), at]
            better = np.flatnonzero(top > best + 1e-9)
            best[better] = top[better]
            feature[first + better], cut[first + better] = f, e[at[better]]
        split = cut[node]
        edge_bin = np.zeros(len(node), dtype=np.int64)
        for f, e in enumerate(edges):
            mine = feature[node] == f
            edge_bin[mine] = np.searchsorted(e, split[mine])
        right = np.isfinite(split) & (binned[np.arange(len(node)), feature[node]] > edge_bin)
        node = 2 * node + 1 + right
    first = 2**depth - 1
    g = np.bincount(node - first, grad, 2**depth)
    h = np.bincount(node - first, hess, 2**depth)
    value[first:] = -g / (h + l2)
    return Tree(feature, cut, value)


@dataclass
class UrlModel:
    stats: SuffixStats
    base: float
    trees: list[Tree]
    depth: int
    rate: float
    rules: tuple = RULES

    def blocked(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x, self.depth)
        return 1 / (1 + np.exp(-z))


def fit(urls: list[str | None], blocked: list[bool], weights: list[float] | None = None, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0, rules=RULES) -> UrlModel:
    """Boosting of the weighted logistic loss; suffix statistics of a row come from the other half of the hosts.

    A side of a split has a second derivative of ``least`` or more, or of an even share of the whole where that is less.
    """
    y = np.array(blocked, dtype=float)
    w = np.ones(len(y)) if weights is None else np.array(weights, dtype=float)
    parts = [split_url(u) for u in urls]
    keys = [suffixes(*p) for p in parts]
    stats = SuffixStats.fit(keys, y, w)
    p = float(np.clip(stats.prior, 0.01, 0.99)) if len(y) else 0.01
    model = UrlModel(stats, math.log(p / (1 - p)), [], depth, rate, tuple(rules))
    if len(set(blocked)) < 2:
        return model
    half = np.array([zlib.crc32(h.encode("utf-8", "surrogatepass")) >> 7 & 1 for h, _ in parts])
    other = [SuffixStats.fit([k for k, s in zip(keys, half, strict=True) if s != side], y[half != side], w[half != side]) for side in (0, 1)]
    x = np.array([lexical(u, h, q, other[k]) for u, (h, q), k in zip(urls, parts, half, strict=True)], dtype=float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), model.base)
    least = min(least, float((w * p * (1 - p)).sum()) / 2**depth)  # so that few labels can be told apart as well
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        model.trees.append(grow(binned, edges, w * (p - y), w * p * (1 - p), depth, l2, least))
        z += rate * model.trees[-1].predict(x, depth)
    return model


def policy_labels(urls: list[str | None], rules=RULES, free_weight: float = 0.25) -> tuple[list[bool], list[float]]:
    """The policy's verdict on each URL and its weight: 1 where a rule names the URL, ``free_weight`` (allowed) elsewhere."""
    found = [match_rule(*split_url(u), rules) for u in urls]
    return [bool(r) and r[1] == "block" for r in found], [1.0 if r else free_weight for r in found]


def auc(scores: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> float:
    """Weighted chance that a blocked URL scores above an allowed one; ties count half."""
    values, at = np.unique(scores, return_inverse=True)
    bad, good = (np.bincount(at, weights * (truth == side), len(values)) for side in (True, False))
    below = np.cumsum(good) - good
    pairs = bad.sum() * good.sum()
    return float((bad * (below + good / 2)).sum() / pairs) if pairs else float("nan")


def held_out_auc(urls: list[str | None], blocked: list[bool], weights: list[float] | None = None, folds: int = 5, **options) -> float:
    """Ranking of the URLs of one fold of hosts by a model that never saw those hosts."""
    parts = [split_url(u) for u in urls]
    out = np.array([zlib.crc32(h.encode("utf-8", "surrogatepass")) % folds == 0 for h, _ in parts])
    y, w = np.array(blocked), np.ones(len(urls)) if weights is None else np.array(weights, dtype=float)
    model = fit([u for u, o in zip(urls, out, strict=True) if not o], y[~out].tolist(), w[~out].tolist(), **options)
    x = np.array([lexical(u, h, p, model.stats) for u, (h, p), o in zip(urls, parts, out, strict=True) if o], dtype=float).reshape(-1, len(FEATURES))
    return auc(model.blocked(x), y[out], w[out])


def train(pages: DataFrame, *, labelled: DataFrame | None = None, url_col: str = "url", label_col: str = "blocked", sample_rows: int = 20_000, sample_bytes: int = 32 << 20, rules=RULES, free_weight: float = 0.25, **options) -> UrlModel:
    """Fit on at most ``sample_rows`` distinct URLs of ``sample_bytes`` together, chosen by their hash.

    With ``labelled`` (a table of ``url_col`` and the boolean ``label_col``; any block of a URL counts) the labels are
    the caller's; else the URLs of ``pages`` are labelled by the policy.
    """
    if labelled is None:
        rows = pages.select(F.col(url_col).alias("text")).where("text is not null").distinct().withColumn("label", F.lit(None).cast("boolean"))
    else:
        rows = labelled.select(F.col(url_col).alias("text"), F.col(label_col).cast("boolean").alias("label")).where("text is not null and label is not null").groupBy("text").agg(F.max("label").alias("label"))
    got = bounded_sample(rows.withColumn("id", F.col("text")), sample_rows, sample_bytes)
    urls = [r["text"] for r in got]
    blocked, weights = policy_labels(urls, rules, free_weight) if labelled is None else ([r["label"] for r in got], None)
    return fit(urls, blocked, weights, rules=rules, **options)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, p_block double"


def judge(pages: DataFrame, model: UrlModel, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, p_block): the rule's verdict, else the trees'; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m = shared.value
        urls = batch.column(1).to_pylist()
        parts = [split_url(u) for u in urls]
        x = np.array([lexical(u, h, p, m.stats) for u, (h, p) in zip(urls, parts, strict=True)], dtype=float)
        prob = m.blocked(x)
        found = [match_rule(h, p, m.rules) for h, p in parts]
        verdicts = [r[1] if r else ("block" if q >= 0.5 else "allow") for r, q in zip(found, prob, strict=True)]
        return {"page_id": batch.column(0), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r[0] if r else None for r in found], "verdict": verdicts, "p_block": prob}

    return arrow_map(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), run, SCHEMA)
