"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token counts of the cells are raked: factors for each source, each
language and each topic are scaled in turn until the weighted tokens meet the target shares of all three marginals. A
cell's calibrated probability is min(1, c * weight) with one constant c, chosen so that the expected tokens reach the
budget; a document is kept if a hash of its key, uniform on [0, 1), is below the probability of its cell.

Targets that contradict each other, or that the cells that occur cannot meet, are reported: marginal_gap is the largest
difference between a marginal's share and its target, and a gap over CLOSE warns, or raises if strict.

Defined cases: a null source, language or topic is a value of its own ("(none)"); a document without tokens, or with
null as their number, has the probability of its cell, and a cell without any tokens has the weight that the factors of
its source, language and topic give; targets are renormalised over the values that occur, and values without a target
get none of the tokens; an empty table gives no rows; repeated rows share their fate, as the hash is that of the key
(null keys count as one key).
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, free_name, small_side, stored

NONE = "(none)"
CELL = ["source", "lang", "topic"]
#: Cells that the driver rakes by itself; more are raked as tables.
DRIVER_CELLS = 100_000
U32 = float(1 << 32)
#: Rounds at most, the change of a factor at which raking has converged, and the marginal gap that is no rounding error.
ROUNDS, STOP, CLOSE = 60, 1e-10, 1e-6


def tempered(tokens: Mapping[str, float], alpha: float) -> dict[str, float]:
    """Shares in proportion to tokens ** alpha: 1 keeps them, 0 makes them equal."""
    raised = {k: float(v) ** alpha if v > 0 else 0.0 for k, v in tokens.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weight of each cell: margins hold each cell's value index, targets each value's share."""
    weight, total = np.ones(len(tokens)), tokens.sum()
    if not total:
        return weight
    for _ in range(ROUNDS):
        worst = 0.0
        for at, share in zip(margins, targets, strict=True):
            now = np.bincount(at, tokens * weight, len(share))
            factor = np.divide(share * total, now, out=np.ones(len(share)), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1)[now > 0].max(initial=0)))
            weight = weight * factor[at]
        if worst < STOP:
            break
    return weight


def marginal_gap(tokens: np.ndarray, weight: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """The largest difference between a marginal's share of the weighted tokens and its target."""
    total = tokens.sum()
    return max((float(np.abs(np.bincount(at, tokens * weight, len(share)) / total - share).max()) for at, share in zip(margins, targets, strict=True)), default=0.0) if total else 0.0


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight) with expected tokens equal to the budget, or as near as the weights allow."""
    positive = weight > 0
    if not positive.any() or tokens[positive].sum() <= budget:
        return positive.astype(float)
    order = np.argsort(-weight, kind="stable")
    w, t = weight[order], tokens[order]
    full = np.concatenate(([0.0], np.cumsum(t)))[:-1]  # tokens of the cells before, which have probability 1
    rest = np.cumsum((w * t)[::-1])[::-1]
    for i in range(len(w)):
        c = (budget - full[i]) / rest[i] if rest[i] > 0 else 0.0
        if c * w[i] <= 1:
            return np.minimum(1.0, np.maximum(0.0, c) * weight)
    return positive.astype(float)


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and key; null keys count as one key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(NONE)))), 1, 8), 16, 10).cast("double") / U32


def cell_probabilities(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, alpha: float, keep: float, strict: bool = False, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic, weight, probability, marginal_gap from cells (source, lang, topic, tokens).

    Up to driver_cells cells are raked on the driver, more as tables: the same rounds and the same stop.
    """
    return (_raked_as_tables if cells.count() > driver_cells else _raked_here)(cells, targets, alpha, keep, strict)


def _told(gap: float, strict: bool) -> float:
    if gap > CLOSE:
        said = f"the cells that occur cannot meet the targets: a marginal's share is {gap:.3g} off its target"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=4)
    return gap


def _raked_here(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, alpha: float, keep: float, strict: bool = False) -> DataFrame:
    rows = cells.orderBy(*CELL).collect()
    tokens = np.array([float(r["tokens"]) for r in rows])
    margins, shares = [], []
    for name in CELL:
        values = sorted({r[name] for r in rows})
        index = {v: i for i, v in enumerate(values)}
        at = np.array([index[r[name]] for r in rows], dtype=int)
        own = (targets or {}).get(name)
        if own is None:
            own = tempered(dict(zip(values, np.bincount(at, tokens, len(values)), strict=True)), alpha)
        share = np.array([own.get(v, 0.0) for v in values])
        margins.append(at)
        shares.append(share / (share.sum() or 1))
    weight = rake(tokens, margins, shares)
    gap = _told(marginal_gap(tokens, weight, margins, shares), strict)
    p = calibrate(tokens, weight, keep * tokens.sum())
    made = [(r["source"], r["lang"], r["topic"], float(w), float(x), gap) for r, w, x in zip(rows, weight, p, strict=True)]
    return cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, weight double, probability double, marginal_gap double")


def _raked_as_tables(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, alpha: float, keep: float, strict: bool = False) -> DataFrame:
    """Each round scales the weights by joins with the factors of a marginal; c is found by bisection on sums."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = {}
    for name in CELL:
        own = (targets or {}).get(name)
        if own is None:
            share = cells.groupBy(name).agg(F.sum("tokens").alias("s")).select(name, F.when(F.col("s") > 0, F.pow(F.col("s").cast("double"), F.lit(float(alpha)))).otherwise(0.0).alias("share"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in own.items()], f"{name} string, share double")
            share = cells.select(name).distinct().join(given, name, "left").select(name, F.coalesce("share", F.lit(0.0)).alias("share"))
        norm = share.agg(F.sum("share")).first()[0] or 1.0
        shares[name] = stored(share.select(name, (F.col("share") / norm).alias("share")), f"ipf-{name}")
    now = stored(cells.select(*CELL, F.col("tokens").cast("double").alias("tokens"), F.lit(1.0).alias("weight")), "ipf-0")

    def marginal(name: str) -> DataFrame:
        return now.groupBy(name).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(shares[name], name)

    for k in range(ROUNDS if total else 0):
        worst = 0.0
        for name in CELL:
            factor = stored(marginal(name).select(name, "now", F.when(F.col("now") > 0, F.col("share") * total / F.col("now")).otherwise(1.0).alias("factor")), "ipf-factor")
            worst = max(worst, factor.where("now > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            old, now = now, stored(now.join(factor.drop("now"), name).select(*CELL, "tokens", (F.col("weight") * F.col("factor")).alias("weight")), f"ipf-{k + 1}")
            drop_stored(old, factor)
        if worst < STOP:
            break
    gap = max(marginal(name).agg(F.max(F.abs(F.col("now") / total - F.col("share")))).first()[0] for name in CELL) if total else 0.0
    _told(gap, strict)
    drop_stored(*shares.values())

    def expected(c: float) -> float:
        return now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c))).first()[0] or 0.0

    budget = keep * total
    if (now.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0.0) <= budget:
        return now.select(*CELL, "weight", (F.col("weight") > 0).cast("double").alias("probability"), F.lit(gap).alias("marginal_gap"))
    low, high = 0.0, 1.0
    while expected(high) < budget:
        low, high = high, 4 * high
    while high - low > 1e-13 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < budget else (low, mid)
    return now.select(*CELL, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"), F.lit(gap).alias("marginal_gap"))


def mix(docs: DataFrame, tokens: Column, topic: Column, source: str = "source", lang: str = "lang", key: str = "doc_id", targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = 0.5, keep: float = 0.6, seed: int = 17, strict: bool = False) -> DataFrame:
    """docs with topic, n_tokens, weight, probability, marginal_gap and selected (columns of these names are replaced).

    targets: shares by "source", "lang", "topic"; a marginal without any gets its tokens' shares raised to alpha.
    keep: the budget, as a share of all tokens. strict: targets that cannot be met raise.
    """
    own = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "weight", "probability", "marginal_gap", "selected")]
    s, g, t, n = (free_name(docs, x) for x in ("ipf_source", "ipf_lang", "ipf_topic", "ipf_tokens"))
    rows = docs.withColumns({s: _value(F.col(source)), g: _value(F.col(lang)), t: _value(topic), n: F.coalesce(tokens.cast("long"), F.lit(0))})
    cells = stored(rows.groupBy(F.col(s).alias("source"), F.col(g).alias("lang"), F.col(t).alias("topic")).agg(F.sum(n).alias("tokens")), "ipf-cells")
    names = {x: free_name(rows, f"cell_{x}") for x in ("source", "lang", "topic", "weight", "probability", "marginal_gap")}
    p = small_side(cell_probabilities(cells, targets, alpha, keep, strict).withColumnsRenamed(names), cells.count(), DRIVER_CELLS)
    drop_stored(cells)
    out = rows.join(p, (F.col(s) == F.col(names["source"])) & (F.col(g) == F.col(names["lang"])) & (F.col(t) == F.col(names["topic"])))
    drawn = uniform(F.col(key), seed)
    return out.select(*(F.col(f"`{c}`") for c in own), F.col(t).alias("topic"), F.col(n).alias("n_tokens"), F.col(names["weight"]).alias("weight"), F.col(names["probability"]).alias("probability"), F.col(names["marginal_gap"]).alias("marginal_gap"), (drawn < F.col(names["probability"])).alias("selected"))
