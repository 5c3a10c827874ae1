"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is taken in linear time as
half of |sum_i x_i v_i|^2 - sum_i |x_i v_i|^2.

Words count as square roots of their frequencies, scaled to unit length; structure statistics and metadata are
standardised, clipped to +-4 and scaled. Defined cases: null text counts as empty; an empty text has only structure
statistics and gets a score as any other; null metadata counts as the mean; without labelled rows every score is 0.5;
texts are read whole.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name

BUCKETS = 1 << 15
RANK = 8
SYMBOLS = re.compile(rb"[#*$%&|<>@~^_={}\[\]\\]")
STATS = ["log_words", "word_chars", "distinct", "top_word", "adjacent", "repeat_pairs", "symbols", "marks", "upper", "caps_words", "digits", "lines", "repeat_lines", "bars", "long_words", "no_letter"]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(distinct buckets of the words, the words in each, structure statistics) of a UTF-8 text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), [0.0] * (len(STATS) - 1) + [1.0]
    codes = np.fromiter(map(crc32, words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    found, counts = np.unique(codes, return_counts=True)
    buckets, which = np.unique(found % BUCKETS, return_inverse=True)  # words that share a bucket are one input
    pairs = codes[1:] * 31 + codes[:-1]
    size = len(text)
    lines = [x for x in text.split(b"\n") if x]
    caps = sum(map(bytes.isupper, words))
    upper = np.frombuffer(text, np.uint8)
    letters = max(1, int((((upper | 32) >= 97) & ((upper | 32) <= 122)).sum()))
    stats = [
        np.log1p(n),
        size / n,
        len(found) / n,
        counts.max() / n,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        len(SYMBOLS.findall(text)) / size,
        (text.count(b"!") + text.count(b"?")) / size,
        int(((upper >= 65) & (upper <= 90)).sum()) / letters,
        caps / n,
        int(((upper >= 48) & (upper <= 57)).sum()) / size,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        words.count(b"|") / n,
        float((lengths > 30).mean()),
        0.0,
    ]
    return buckets, np.bincount(which, counts), stats


class Machine:
    """Parameters of a trained machine; inputs are BUCKETS words, then structure statistics, then metadata."""

    def __init__(self, n_meta: int = 0, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = BUCKETS + len(STATS) + n_meta
        self.n_meta, self.bias, self.fitted = n_meta, 0.0, False
        self.linear, self.factors = np.zeros(n), rng.normal(0, 0.01, (n, RANK))
        self.mean, self.scale = np.zeros(len(STATS) + n_meta), np.ones(len(STATS) + n_meta)

    def inputs(self, words: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.sqrt(counts)
        x = x / max(1e-12, np.sqrt((x * x).sum()))
        dense = np.clip((stats - self.mean) / self.scale, -4, 4)
        dense[np.isnan(dense)] = 0
        return np.concatenate((words, np.arange(BUCKETS, BUCKETS + len(dense)))), np.concatenate((x, dense * 0.5))

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        xv = self.factors[at] * x[:, None]
        total = xv.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * (total @ total - (xv * xv).sum()))

    def score(self, text: bytes | None, meta: list[float]) -> float:
        words, counts, stats = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(words, counts, np.array([*stats, *meta], float))), -30, 30))))

    def fit(self, rows: list[tuple], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, batch: int = 64, decay: float = 2e-4, seed: int = 3) -> None:
        """rows: (words, counts, stats with metadata). Adagrad on the logistic loss."""
        if not len(rows):
            return
        self.fitted = True
        dense = np.array([r[2] for r in rows], float)
        with np.errstate(all="ignore"):
            self.mean = np.nan_to_num(np.nanmean(dense, axis=0))
            self.scale = np.nan_to_num(np.nanstd(dense, axis=0)) + 1e-6
        made = [self.inputs(w, c, d) for (w, c, _), d in zip(rows, dense, strict=True)]
        rng, n = np.random.default_rng(seed), len(rows)
        p = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        seen_w, seen_v, seen_b = np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                some = order[lo : lo + batch]
                lengths = np.array([len(made[i][0]) for i in some])
                at, x = np.concatenate([made[i][0] for i in some]), np.concatenate([made[i][1] for i in some])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                row = np.repeat(np.arange(len(some)), lengths)
                xv = self.factors[at] * x[:, None]
                total = np.add.reduceat(xv, starts, axis=0)
                raw = self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), starts))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
                e = error[row] * x
                unique, inverse = np.unique(at, return_inverse=True)
                gw = np.bincount(inverse, e, len(unique)) + decay * self.linear[unique]
                pull = e[:, None] * (total[row] - xv)
                gv = np.stack([np.bincount(inverse, pull[:, f], len(unique)) for f in range(RANK)], axis=1) + decay * self.factors[unique]
                seen_w[unique] += gw * gw
                seen_v[unique] += gv * gv
                self.linear[unique] -= rate * gw / np.sqrt(seen_w[unique])
                self.factors[unique] -= 0.5 * rate * gv / np.sqrt(seen_v[unique])
                seen_b += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(seen_b)


def _meta(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in columns]


def train(rows: DataFrame, label: str, text: str = "text", meta: tuple[str, ...] = (), key: str = "doc_id", most: int = 6000) -> Machine:
    """Fit on labelled rows: about `most` of them at most, chosen by a hash of the key. Null labels teach nothing."""
    rows = rows.where(F.col(label).isNotNull())

    @F.pandas_udf("words binary, counts binary, stats array<double>")
    def extract(texts: pd.Series) -> pd.DataFrame:
        out = [features(t) for t in texts]
        return pd.DataFrame({"words": [w.astype("<u2").tobytes() for w, _, _ in out], "counts": [c.astype("<f4").tobytes() for _, c, _ in out], "stats": [s for _, _, s in out]}, columns=["words", "counts", "stats"])

    some = bounded(rows, most, F.col(key)).select(F.col(label).cast("double").alias("y"), F.array(*_meta(list(meta))).alias("m") if meta else F.array().cast("array<double>").alias("m"), extract(F.col(text).cast("binary")).alias("x"))
    got = sorted(some.select("y", "m", "x.*").collect(), key=lambda r: (r["y"], r["words"], r["counts"], r["stats"]))
    machine = Machine(len(meta))
    data = [(np.frombuffer(r["words"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(float), [*r["stats"], *(np.nan if v is None else v for v in r["m"])]) for r in got]
    machine.fit(data, np.array([r["y"] for r in got]))
    return machine


def scored(docs: DataFrame, machine: Machine, text: str = "text", meta: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0)."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series, metas: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series([own.score(t, [np.nan if v is None else v for v in m]) for t, m in zip(texts, metas, strict=True)], dtype=float)

    tmp = free_name(docs, "fm_score")
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    metas = F.array(*_meta(list(meta))) if meta else F.array().cast("array<double>")
    out = docs.withColumn(tmp, score(F.col(text).cast("binary"), metas))
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col(tmp).alias("score"), (F.col(tmp) >= threshold).cast("int").alias("predicted"))
