"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs, by default those that the rules judge, and become nested Spark conditional
expressions; features, rules and trees are DataFrame functions throughout.

The suffix statistics are block rates of hosts' suffixes and paths' endings, in hashed places, so that every value has
one. A labelled URL has the rates of the other folds' URLs when the trees are fitted, a URL to judge those of all.

Defined cases: a null url or one without "://" has empty host and path, fits no rule, and is judged by its features
(null counts as empty); without labelled URLs the verdict is allow, with one class only that class; repeated rows are
judged alike; of rules of equal length the first in order of host and path wins; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "host_length", "segment_length", "suffix_rate", "ending_rate"]
#: Places that suffixes and endings are hashed to, folds of the labelled URLs, and URLs' worth that a rate is drawn to that of all.
PLACES, FOLDS, DRAWN = 1024, 5, 20.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<name, verdict> of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<name: string, verdict: string>") if out is None else out


def occurrences(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def ending_of(path: Column) -> Column:
    """The last segment's dot ending, "/" for a folder, else empty."""
    return F.when(path.endswith("/"), F.lit("/")).otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: runs of the sorted characters are counted in one pass."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weigh = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        same = s["c"] == c
        return F.struct(c.alias("c"), F.when(same, s["n"] + 1).otherwise(1.0).alias("n"), F.when(same, s["sum"]).otherwise(s["sum"] + weigh(s["n"])).alias("sum"))

    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.log2(size) - F.aggregate(chars, start, step, lambda s: s["sum"] + weigh(s["n"])) / size


def place_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PLACES)).cast("int")


def features(url: Column, host: Column, path: Column, rates: dict[str, list[float]]) -> Column:
    """struct of FEATURES, all double; rates: the block rate of each place of "suffix" and "ending", 0.5 where not given."""
    url = F.coalesce(url, F.lit(""))
    length = F.length(url)
    depth = occurrences(path, "/")

    def rate(name: str, key: Column) -> Column:
        return F.get(F.lit(rates[name]), place_of(key)) if rates.get(name) else F.lit(0.5)

    values = {
        "length": length,
        "depth": depth,
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(length, F.lit(1)),
        "entropy": entropy(url),
        "parameters": occurrences(url, "="),
        "host_labels": occurrences(host, ".") + 1,
        "hyphens": occurrences(url, "-"),
        "host_length": F.length(host),
        "segment_length": F.length(path) / F.greatest(depth, F.lit(1)),
        "suffix_rate": rate("suffix", suffix_of(host)),
        "ending_rate": rate("ending", ending_of(path)),
    }
    return F.struct(*(values[f].cast("double").alias(f) for f in FEATURES))


def smoothed(place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Block rate of each place, drawn towards the rate of all."""
    base = y.mean() if len(y) else 0.5
    return (np.bincount(place, y, PLACES) + DRAWN * base) / (np.bincount(place, minlength=PLACES) + DRAWN)


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, ridge: float) -> Node:
    """A regression tree of Newton steps on second-order gains."""
    g, h = gradient.sum(), hessian.sum()
    node = Node(value=float(-g / (h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return node
    best, at = 1e-6, None
    for f, thresholds in enumerate(cuts):
        which = np.searchsorted(thresholds, x[:, f], side="right")
        gs, hs, ns = (np.cumsum(np.bincount(which, w, len(thresholds) + 1))[:-1] for w in (gradient, hessian, np.ones(len(x))))
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (len(x) - ns < least)] = 0
        if len(gain) and gain.max() > best:
            best, at = float(gain.max()), (f, float(thresholds[int(gain.argmax())]))
    if at is None:
        return node
    node.feature, node.threshold = at
    low = x[:, at[0]] < at[1]
    node.low = _tree(x[low], gradient[low], hessian[low], cuts, depth - 1, least, ridge)
    node.high = _tree(x[~low], gradient[~low], hessian[~low], cuts, depth - 1, least, ridge)
    return node


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] < node.threshold, _values(node.low, x), _values(node.high, x))


@dataclass
class Booster:
    bias: float
    trees: list[Node]
    rates: dict[str, list[float]]
    rate: float = 0.3

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rates: dict, trees: int = 20, depth: int = 3, bins: int = 24, least: int = 10, rate: float = 0.3) -> Booster:
        """y: 1 is block. Logistic loss."""
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        out = cls(float(np.log(p / (1 - p))), [], rates, rate)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        raw = np.full(len(y), out.bias)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            tree = _tree(x, q - y, q * (1 - q), cuts, depth, least, 1.0)
            out.trees.append(tree)
            raw = raw + rate * _values(tree, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.rate * sum((_values(t, x) for t in self.trees), np.zeros(len(x))))))

    def column(self, own: Column) -> Column:
        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(self.rate * node.value)
            return F.when(own[FEATURES[node.feature]] < node.threshold, of(node.low)).otherwise(of(node.high))

        raw = F.lit(self.bias)
        for t in self.trees:
            raw = raw + of(t)
        return 1 / (1 + F.exp(-raw))


def train(labelled: DataFrame, url: str, label: str, most: int = 20_000) -> Booster:
    """From rows with a url and a label (block or allow): `most` distinct ones at most, chosen by a hash of both.

    The sample is read once; its features, places and folds come to the driver, where the trees are fitted.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = stored(labelled.where(F.col(label).isin("block", "allow")).select(url, label).distinct(), "url-labelled")
    rows = bounded(rows, most, F.col(url), F.col(label)).select(
        features(F.col(url), host, path, {}).alias("f"),
        F.struct(place_of(suffix_of(host)).alias("suffix"), place_of(ending_of(path)).alias("ending"), F.pmod(F.xxhash64(F.lit("fold"), F.col(url)), F.lit(FOLDS)).alias("fold")).alias("p"),
        (F.col(label) == "block").cast("double").alias("y"),
    )
    got = sorted(tuple(r) for r in rows.select("f.*", "p.*", "y").collect())
    if not got:
        return Booster(-30.0, [], {})
    data = np.array(got, float)
    x, places, fold, y = data[:, : len(FEATURES)], data[:, len(FEATURES) : -2].astype(int).T, data[:, -2], data[:, -1]
    rates = {}
    for name, place in zip(("suffix", "ending"), places, strict=True):
        rates[name] = smoothed(place, y).tolist()
        for k in range(FOLDS):
            own = fold == k
            x[own, FEATURES.index(f"{name}_rate")] = smoothed(place[~own], y[~own])[place[own]]
    if y.min() == y.max():
        return Booster(30.0 if y[0] else -30.0, [], rates)
    return Booster.fit(x, y, rates)


def judged(pages: DataFrame, rules: list[Rule], model: Booster, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score (of block) and verdict; columns of these names are replaced."""
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    h, p, r, f = (free_name(pages, f"url_{x}") for x in ("host", "path", "rule", "features"))
    rows = pages.withColumn(h, host_of(F.col(url))).withColumn(p, path_of(F.col(url)))
    rows = rows.withColumn(r, rule_of(F.col(h), F.col(p), rules)).withColumn(f, features(F.col(url), F.col(h), F.col(p), model.rates))
    score = model.column(F.col(f))
    out = rows.select(*(F.col(f"`{c}`") for c in own), F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{r}.name").alias("rule"), score.alias("score"), F.col(f"{r}.verdict").alias("verdict"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def label_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """url, label of the pages that a rule judges."""
    rule = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)
    return pages.select(F.col(url).alias("url"), rule["verdict"].alias("label")).where("label is not null")
