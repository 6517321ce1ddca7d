"""URL filter: host/path rules first, gradient-boosted trees on lexical features for what no rule covers.

The trees are trained here, from URLs whose label is known because a rule covers them. A rule's own text must not be
the whole of what a tree learns, so the features are lexical only: lengths, depth, digit ratio, entropy, parameter
counts and statistics of the host's suffix, the latter estimated from the training rows.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path, matches no rule and is judged by
the trees on those empty strings. Repeated rows are judged one by one, alike. An empty table gives no rows. Without a
labelled row, or with one label only, every unmatched URL is allowed, or gets that label. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, utf8

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
#: Labelled URLs that the trees are fitted on, about, at most: those with small hashes.
TRAIN_ROWS = 20_000
#: Parts of the training rows; a row's suffix statistics come from the others.
FOLDS = 5

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "params", "query_length", "hyphens", "labels", "fragment", "secure", "suffix_rate", "suffix_count")


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(utf8(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(utf8(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    text = verdict = F
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):  # one flat CASE, longer rules first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = text.when(fits, F.lit(rule_host + rule_path)), verdict.when(fits, F.lit(what))
    return text, verdict


def _suffix(host: str) -> str:
    return host.rsplit(":", 1)[0].rsplit(".", 1)[-1]


def lexical(urls: list[str | None], hosts: list[str], paths: list[str], suffixes: dict[str, tuple[float, float]]) -> np.ndarray:
    """One row of FEATURES for each URL."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        n = max(len(url), 1)
        counts = Counter(url).values()
        query = url.partition("?")[2].partition("#")[0]
        rate, seen = suffixes.get(_suffix(host), (0.5, 0.0))
        out[i] = (
            len(url), len(host), len(path), len([x for x in path.split("/") if x]),
            sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
            -sum(c / n * math.log2(c / n) for c in counts),
            len([x for x in re.split("[&;]", query) if x]), len(query), host.count("-"), host.count(".") + bool(host),
            "#" in url, url[:8].lower() == "https://", rate, math.log1p(seen),
        )
    return out


@dataclass
class Boosted:
    """Gradient-boosted regression trees under the logistic loss, on features cut into at most ``bins`` quantile bins."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        p = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if n == 0 or y.min() == y.max():
            self.base = 8.0 if n and y.min() == 1 else -8.0
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        cut = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at, tree = np.zeros(n, int), []
            for level in range(self.depth):
                splits = {}
                for node in range(1 << level):
                    rows = np.flatnonzero(at == node)
                    splits[node] = self._split(cut[rows], grad[rows], hess[rows])
                tree += [(j, float(self.edges[j][b]) if j >= 0 else 0.0, 0.0) for j, b in splits.values()]
                right = np.zeros(n, bool)
                for node, (j, b) in splits.items():
                    if j >= 0:
                        right |= (at == node) & (cut[:, j] > b)
                at = at * 2 + right
            g, h = (np.bincount(at, w, 1 << self.depth) for w in (grad, hess))
            leaf = self.rate * g / (h + self.l2)
            tree += [(-2, 0.0, float(v)) for v in leaf]
            self.nodes.append(tree)
            score += leaf[at]
        return self

    def _split(self, cut: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best = (1e-6, -1, 0)
        if len(cut) < 2:
            return -1, 0
        g, h = grad.sum(), hess.sum()
        for j, e in enumerate(self.edges):
            if len(e):
                gl, hl = (np.cumsum(np.bincount(cut[:, j], w, len(e) + 1))[:-1] for w in (grad, hess))
                gain = gl**2 / (hl + self.l2) + (g - gl) ** 2 / (h - hl + self.l2) - g**2 / (h + self.l2)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, b)
        return best[1:]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1."""
        score = np.full(len(x), self.base)
        for tree in self.nodes:
            feature, edge, value = (np.array(v) for v in zip(*tree, strict=True))
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                j = feature[node]
                at = at * 2 + ((j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > edge[node]))
            score += value[(1 << self.depth) - 1 + at]
        return 1 / (1 + np.exp(-score))


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[Boosted, dict[str, tuple[float, float]]]:
    """Fit on (url, host, path, blocked) rows: about ``max_rows`` distinct ones with small hashes, which is all that reaches the driver."""
    cols = [F.col(c).alias(c) for c in ("url", "host", "path", "blocked")]
    picked = sorted(hashed_sample(labelled.select(*cols), max_rows, "url", "blocked").collect())
    urls, hosts, paths = ([r[k] for r in picked] for k in range(3))
    y = np.array([float(r[3]) for r in picked])
    fold = np.array([zlib.crc32((u or "").encode("utf-8", "surrogatepass")) % FOLDS for u in urls], int)
    x = np.zeros((0, 0))
    for k in range(FOLDS):  # a row's own label is not in what it is told about its suffix
        own = np.flatnonzero(fold == k)
        others = _rates([hosts[i] for i in np.flatnonzero(fold != k)], y[fold != k])
        part = lexical([urls[i] for i in own], [hosts[i] for i in own], [paths[i] for i in own], others)
        x = x if x.size else np.zeros((len(y), part.shape[1]))
        x[own] = part
    return Boosted().fit(x, y), _rates(hosts, y)


def _rates(hosts: list[str], y: np.ndarray) -> dict[str, tuple[float, float]]:
    """Of each suffix: the smoothed share of blocked rows, and its rows."""
    n, bad = Counter(map(_suffix, hosts)), Counter(_suffix(h) for h, b in zip(hosts, y, strict=True) if b)
    return {s: ((bad[s] + 1) / (k + 2), float(k)) for s, k in n.items()}


def judge_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest fitting rule's verdict, else ``block`` where the trees give ``threshold`` or more.

    ``score`` is the trees' probability of ``block``, null where a rule decided. One narrow scan trains, one narrow scan
    judges; nothing is shuffled but the bounded training sample.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_column(host, path, rules)
    base = df.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))
    model, suffixes = fit(base.filter("rule is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("blocked")), max_train_rows)

    def judge(batches):
        for batch in batches:
            c = batch.to_pydict()
            decided = [r is not None for r in c["rule"]]
            free = [i for i, d in enumerate(decided) if not d]
            score = np.zeros(batch.num_rows)
            if free:
                score[free] = model.predict(lexical(*[[c[k][i] for i in free] for k in ("url", "host", "path")], suffixes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("host"), batch.column("path"), batch.column("rule"),
                    pa.array([v if d else "block" if s >= threshold else "allow" for v, d, s in zip(c["verdict"], decided, score, strict=True)], pa.string()),
                    pa.array([None if d else float(s) for d, s in zip(decided, score, strict=True)], pa.float64()),
                ],
                names=[id_col, "host", "path", "rule", "verdict", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return base.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")
