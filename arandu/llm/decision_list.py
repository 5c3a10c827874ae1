"""Quality rules as a learned decision list.

Sequential covering: a rule, a conjunction of thresholds on statistics of a text, is grown on one part of the labelled
rows by the gain in information, pruned on the other part, and emitted if it still is precise there; the rows that it
covers are taken away and the next rule is learned. The list becomes one ordered Spark conditional expression.

Defined cases: null text counts as empty; without labelled rows, or with one class only, the list is empty and every
document that passes the base rules is kept; rows with a null label teach nothing; null statistics meet no condition;
repeated rows are judged alike; an empty table gives no rows; columns named as the new ones are replaced, others stay;
texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: The statistics of a text: counts, all whole numbers.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_caps_words", "n_bars", "n_distinct", "n_adjacent", "n_lines", "n_window_words", "n_window_distinct"]
#: Words of a window in which distinct words are counted: the share of distinct words in a whole text falls with its length alone.
WINDOW = 50


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text: see the query's contract for the first five; the others are !/? characters, A-Z letters,
    words without lower-case letters, words that are a bar, distinct words, words equal to the one before, lines with a
    word, words of whole windows of WINDOW words (a shorter text is one window), and the distinct words of each."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    covered = 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n >= 3:
        base = np.int64(len(ids))
        pairs = np.unique(at[:-2] * base + at[1:-1], return_inverse=True)[1]
        _, which, times = np.unique(pairs * base + at[2:], return_inverse=True, return_counts=True)
        often = times[which] >= 2
        mask = np.zeros(n, bool)
        for k in range(3):
            mask[k : n - 2 + k] |= often
        covered = int(mask.sum())
    windows = np.sort(at[: n - n % WINDOW].reshape(-1, WINDOW) if n >= WINDOW else at.reshape(1, n), axis=1)
    raw = np.frombuffer(data, np.uint8)
    spaces = int((((raw >= 9) & (raw <= 13)) | (raw == 32)).sum())
    return (
        n,
        len(text) - spaces,
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        covered,
        data.count(b"!") + data.count(b"?"),
        int(((raw >= 65) & (raw <= 90)).sum()),
        sum(w.upper() == w and w.lower() != w for w in text.split()),
        words.count(b"|"),
        len(ids),
        int((at[1:] == at[:-1]).sum()),
        len(lines),
        windows.size,
        int((windows[:, 1:] != windows[:, :-1]).sum()) + len(windows) * (n > 0),
    )


def counts_column(text: str | Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS).astype("int64")

    return count(text)


#: name -> (numerator, denominator) of the statistics that rules test: shares and means, none a matter of length.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_chars": ("n_upper", "word_chars"),
    "caps_words": ("n_caps_words", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "window_distinct": ("n_window_distinct", "n_window_words"),
    "adjacent_words": ("n_adjacent", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str, stats: Column) -> Column:
    top, bottom = RATIOS[name]
    return stats[top].cast("double") / F.greatest(stats[bottom], F.lit(1))


@dataclass(frozen=True)
class Condition:
    stat: str
    over: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] >= self.threshold if self.over else x[self.stat] < self.threshold

    def column(self, stats: Column) -> Column:
        value = ratio(self.stat, stats)
        return value >= self.threshold if self.over else value < self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.over else '<'} {self.threshold:.6g}"


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: int) -> list[Condition]:
    """Add the condition of the largest information gain until only bad rows are covered."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < longest:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        base = np.log2(p / (p + n))
        for stat, values in x.items():
            for cut in np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, cuts))):
                for over in (True, False):
                    c = Condition(stat, over, float(cut))
                    hit = c.holds(x) & inside
                    q, m = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if q and (g := q * (np.log2(q / (q + m)) - base)) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(_widened(best, x[best.stat][inside & ~bad]))
        inside &= rule[-1].holds(x)
    return rule


def _widened(c: Condition, good: np.ndarray) -> Condition:
    """The condition with its threshold half-way to the next good value that it does not cover."""
    beyond = good[good < c.threshold] if c.over else good[good >= c.threshold]
    if not len(beyond):
        return c
    return Condition(c.stat, c.over, float((c.threshold + (beyond.max() if c.over else beyond.min())) / 2))


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    hit = covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 12, longest: int = 4, cuts: int = 24, least: int = 3, precision: float = 0.95, seed: int = 9, tries: int = 6) -> list[list[Condition]]:
    """Ordered rules for the bad rows: two thirds of the rows grow a rule, the others prune and judge it. A rule that is
    not precise there, or covers fewer than `least` bad rows, is tried again from other thirds, `tries` times in a row."""
    rng = np.random.default_rng(seed)
    left, rules, failed = np.arange(len(bad)), [], 0
    while len(rules) < most and failed < tries and bad[left].any() and not bad[left].all():
        order = rng.permutation(left)
        part = len(order) * 2 // 3
        sets = [({k: v[i] for k, v in x.items()}, bad[i]) for i in (order[:part], order[part:])]
        rule = _grow(*sets[0], longest, cuts)
        while len(rule) > 1 and (shorter := max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=lambda r: _worth(r, *sets[1])[0])) and _worth(shorter, *sets[1])[0] >= _worth(rule, *sets[1])[0]:
            rule = shorter
        _, p, n = _worth(rule, *sets[1])
        if not rule or not p or p < precision * (p + n) or _worth(rule, {k: v[left] for k, v in x.items()}, bad[left])[1] < least:
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left = left[~covers(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def train(rows: DataFrame, label: str, text: str = "text", key: str = "doc_id", most: int = 8000) -> list[list[Condition]]:
    """Rules for rows whose label is 0, from `most` labelled rows at most, chosen by a hash of the key."""
    rows = bounded(rows.where(F.col(label).isNotNull()), most, F.col(key))
    got = rows.select(F.col(label).cast("int").alias("y"), counts_column(F.col(text)).alias("s")).select("y", *(ratio(r, F.col("s")).alias(r) for r in RATIOS)).collect()
    got = sorted(got, key=tuple)
    x = {r: np.array([g[r] for g in got], float) for r in RATIOS}
    return learn_rules(x, np.array([g["y"] == 0 for g in got], bool)) if got else []


def verdict(rules: list[list[Condition]], stats: Column) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(stats)
        for c in rule[1:]:
            test = test & c.column(stats)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judged(docs: DataFrame, rules: list[list[Condition]], text: str = "text", least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """docs with COUNTS, base_failed, rule (number of the rule that rejects it, else null) and kept."""
    new = {*COUNTS, "base_failed", "rule", "kept"}
    own = [c for c in docs.columns if c.lower() not in new]
    tmp = free_name(docs, "rule_stats")
    stats = F.col(tmp)
    failed = (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > repeat_percent * stats["n_words"])
    rows = docs.withColumn(tmp, counts_column(F.col(text)))
    out = rows.select(*(F.col(f"`{c}`") for c in own), *(stats[c].alias(c) for c in COUNTS), failed.alias("base_failed"), verdict(rules, stats).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
