"""Feature-hashed vectors and exact cosine search."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plain import fold_plain
from ..functions.text import Text, col, filled, fingerprint, locator_path, position_text, squeeze
from ..functions.values import LEAST_VECTOR_SIZE, VECTOR_SIZE

#: Features that a worker keeps the places of.
KEPT_FEATURES = 300_000
_places: dict[tuple[str, int], tuple[int, int, float]] = {}
_kept: dict[tuple[str, int], dict[str, int]] = {}


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.sha1(value.encode()).digest()[:8], "big")


def _place(feature: str, size: int) -> tuple[int, int, float]:
    found = _places.get((feature, size))
    if found is None:
        if len(_places) >= KEPT_FEATURES:
            _places.clear()
        found = _places[feature, size] = (_hash(f"primary::{feature}") % size, _hash(f"secondary::{feature}") % size, 1.0 if _hash(f"sign::{feature}") % 2 == 0 else -1.0)
    return found


def weighted_features(text: str) -> list[tuple[str, float]]:
    """Words, their ends, pairs of words and pieces of three and four characters of a folded text, with weights."""
    words = [t for t in re.split(r"\W+", text) if len(t) > 1 or t.isdigit()]
    out = []
    for w in words:
        out.append((f"word::{w}", 1.0 + min(len(w), 12) / 24))
        if len(w) >= 4:
            out += [(f"prefix::{w[:4]}", 0.28), (f"suffix::{w[-4:]}", 0.28)]
    out += [(f"bigram::{a}_{b}", 1.35) for a, b in zip(words, words[1:], strict=False)]
    if words:
        run = text.replace(" ", "_")
        for n, weight in ((3, 0.18), (4, 0.12)):
            out += [(f"char::{run[i : i + n]}", weight) for i in range(len(run) - n + 1)]
    return out


def embed_plain(text: object, size: int = VECTOR_SIZE) -> list[float] | None:
    """Unit vector of a text, rounded to 6 digits; None without words. A feature adds to two places with one sign, 0.45 to the second."""
    size = max(int(size), LEAST_VECTOR_SIZE)
    found = weighted_features(fold_plain(text))
    if not found:
        return None
    places = np.array([_place(feature, size) for feature, _ in found])
    signed = np.array([weight for _, weight in found]) * places[:, 2]
    first, second = places[:, 0].astype(np.int64), places[:, 1].astype(np.int64)
    vector = np.bincount(first, signed, size) + np.bincount(second, 0.45 * signed, size)
    norm = math.sqrt(float(vector @ vector))
    return [round(float(v), 6) + 0.0 for v in (vector / norm if norm > 0 else vector)]  # + 0.0: no negative zeros


#: Characters of texts that are embedded at once, so that a batch of any length takes the same memory.
EMBEDDED_AT_ONCE = 500_000


def _hashes(role: str, features: list[bytes]) -> np.ndarray:
    digests = b"".join([hashlib.sha1(role.encode() + f).digest() for f in features])
    return np.frombuffer(digests, dtype=np.uint8).reshape(-1, 20)[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)


def _coded(kind: str, names: list[str], size: int, keep: bool = True) -> np.ndarray:
    """One row for each feature of a kind: its two places and its sign. A worker keeps those of kinds that come again and again."""
    kept = _kept.setdefault((kind, size), {})
    codes = np.array([kept.get(n, -1) for n in names], dtype=np.int64)
    missing = np.flatnonzero(codes < 0)
    if len(missing):
        new = [names[i] for i in missing]
        features = [f"{kind}::{n}".encode() for n in new]
        first, second, sign = _hashes("primary::", features) % size, _hashes("secondary::", features) % size, _hashes("sign::", features) % 2
        codes[missing] = ((first * size + second) * 2 + sign).astype(np.int64)
        if keep:
            if len(kept) + len(new) > KEPT_FEATURES:
                kept.clear()
            kept.update(zip(new, codes[missing].tolist(), strict=True))
    return np.stack([codes // 2 // size, codes // 2 % size, 1 - codes % 2 * 2], axis=1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, values = pd.factorize(keys)
    return at.astype(np.int64), values


def embed_many(texts: list[object], size: int = VECTOR_SIZE) -> list[np.ndarray | None]:
    """embed_plain of each text: a feature is placed once for all texts that have it, and added in the same order."""
    size = max(int(size), LEAST_VECTOR_SIZE)
    folded = [fold_plain(t) for t in texts]
    split = [[t for t in re.split(r"\W+", f) if len(t) > 1 or t.isdigit()] for f in folded]
    known = [i for i, words in enumerate(split) if words]
    out: list[np.ndarray | None] = [None] * len(texts)
    if not known:
        return out
    row = np.repeat(np.arange(len(known)), [len(split[i]) for i in known])
    at, words = _distinct(np.array([w for i in known for w in split[i]], dtype=object))
    long = np.array([len(w) >= 4 for w in words])
    ends = [_coded(kind, [cut(w) for w in words], size) for kind, cut in (("word", str), ("prefix", lambda w: w[:4]), ("suffix", lambda w: w[-4:]))]
    weights = np.stack([np.array([1.0 + min(len(w), 12) / 24 for w in words]), np.full(len(words), 0.28), np.full(len(words), 0.28)], axis=1)
    kept = np.stack([np.ones(len(words), dtype=bool), long, long], axis=1)[at]
    parts = [(np.repeat(row, 3).reshape(-1, 3)[kept], np.stack(ends, axis=1)[at][kept], weights[at][kept])]
    pair = np.flatnonzero(row[1:] == row[:-1])
    which, pairs = _distinct(at[pair] * len(words) + at[pair + 1])
    parts.append((row[pair], _coded("bigram", [f"{words[p // len(words)]}_{words[p % len(words)]}" for p in pairs.tolist()], size, keep=False)[which], np.full(len(pair), 1.35)))
    # Pieces of three and four characters, as numbers: three characters of 21 bits, then the number of such a piece and one more.
    runs = [folded[i].replace(" ", "_") for i in known]
    letters = np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    of, end = np.repeat(np.arange(len(runs)), [len(r) for r in runs]), np.repeat(np.cumsum([len(r) for r in runs]), [len(r) for r in runs])
    three = np.flatnonzero(np.arange(len(letters)) + 3 <= end)
    which, keys = _distinct(letters[three] << 42 | letters[three + 1] << 21 | letters[three + 2])
    pieces = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in keys.tolist()]
    parts.append((of[three], _coded("char", pieces, size)[which], np.full(len(three), 0.18)))
    inside = three + 4 <= end[three]
    four = three[inside]
    which, keys = _distinct(which[inside] << 21 | letters[four + 3])
    parts.append((of[four], _coded("char", [pieces[k >> 21] + chr(k & 0x1FFFFF) for k in keys.tolist()], size)[which], np.full(len(four), 0.12)))
    rows, places, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    signed, cells = weight * places[:, 2], len(known) * size
    sums = np.bincount(rows * size + places[:, 0], signed, cells) + np.bincount(rows * size + places[:, 1], 0.45 * signed, cells)
    for i, vector in zip(known, sums.reshape(-1, size), strict=True):
        norm = math.sqrt(float(vector @ vector))
        out[i] = _rounded(vector / norm if norm > 0 else vector)
    return out


def _rounded(values: np.ndarray) -> np.ndarray:
    """round(v, 6) of each; what lies next to a half is left to round()."""
    scaled = values * 1e6
    whole = np.rint(scaled)
    for i in np.flatnonzero(np.abs(np.abs(scaled - whole) - 0.5) < 1e-5):
        whole[i] = np.rint(round(float(values[i]), 6) * 1e6)
    return whole / 1e6 + 0.0  # no negative zeros


def embed(text: Text, size: int = VECTOR_SIZE) -> Column:
    """array<double> of embed_plain for a text column, without a shuffle."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held, length = [], 0
            for t in texts:
                held.append(t)
                length += len(t) if t else 1
                if length >= EMBEDDED_AT_ONCE:
                    yield pd.Series(embed_many(held, size), dtype=object)
                    held, length = [], 0
            if held:
                yield pd.Series(embed_many(held, size), dtype=object)

    return vectors(col(text))


def cosine(left: Column, right: Column) -> Column:
    """Dot product over the shorter length, between -1 and 1, 6 digits; 0 for null or empty (vectors are unit vectors)."""
    n = F.least(F.size(left), F.size(right))
    dot = F.aggregate(F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(left.isNull() | right.isNull() | (n <= 0), 0.0).otherwise(F.round(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)), 6))


def literal_vector(vector: list[float] | None) -> Column:
    return F.lit(None).cast("array<double>") if vector is None else F.array(*(F.lit(float(v)) for v in vector))


def cosine_top(vectors: DataFrame, query: list[float], k: int, vector: str = "vector", *ties: str) -> DataFrame:
    """The k rows of largest cosine; ties by the given columns."""
    return vectors.withColumn("score", cosine(F.col(vector), literal_vector(query))).orderBy(F.desc("score"), *ties).limit(k)


def context_text(chunks: DataFrame) -> Column:
    """What of a chunk goes into its vector: heading path twice, heading, file, archetype, place and text."""
    at = F.col("locator")
    path = F.coalesce(filled(F.trim("heading_path_text")), filled(F.array_join("heading_path", " > ")), filled(F.trim("heading")))
    place = F.coalesce(filled("locator_path"), locator_path(at), position_text(at["page"], at["sheet"], at["line_start"], at["line_end"])) if "locator" in chunks.columns else filled("locator_path")
    parts = [path, path, filled(F.trim("heading")), filled(F.trim("file_name")), filled(F.trim(F.replace(F.col("archetype"), F.lit("_"), F.lit(" ")))), place, filled(squeeze("text"))]
    return F.concat_ws(" | ", *parts)


def plan_embeddings(chunks: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """chunks (chunk_id, context) with text_fingerprint, vector (the stored one if its fingerprint is the same) and reused."""
    now = chunks.withColumn("text_fingerprint", fingerprint("context"))
    # Whether a vector is filled is asked before the join, so that vectors go through it only where they are wanted.
    old = stored.select("chunk_id", F.col("text_fingerprint").alias("_old"), (F.size("vector") > 0).alias("_filled"), F.col("vector").alias("_vector"))
    same = (F.col("_old") == F.col("text_fingerprint")) & F.col("_filled") & ~F.lit(force)
    joined = now.join(old, "chunk_id", "left")
    return joined.withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("vector", F.when(F.col("reused"), F.col("_vector"))).drop("_old", "_filled", "_vector")


def build_embeddings(chunks: DataFrame, stored: DataFrame, size: int = VECTOR_SIZE, force: bool = False) -> DataFrame:
    """Embeddings of all chunks: stored vectors where nothing changed, new ones elsewhere."""
    planned = plan_embeddings(chunks, stored, force)
    fresh = embed(F.when(~F.col("reused"), F.col("context")), size)
    return planned.withColumn("vector", F.coalesce("vector", fresh))


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """stored with the rows of new in place of those with their keys."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def attach(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with their vectors (null if there are none) and has_embedding."""
    return chunks.join(embeddings.select(key, "vector"), key, "left").withColumn("has_embedding", F.col("vector").isNotNull())


def embedding_stats(chunks: DataFrame) -> DataFrame:
    """chunk_count, embedding_count, coverage, state and archetype counts of chunks with vectors."""
    n, m = F.count("*"), F.count("vector")
    by_type = chunks.groupBy("archetype").agg(n.alias("n"), m.alias("m"))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.coalesce(F.sum("m"), F.lit(0)).alias("embedding_count"), F.array_sort(F.collect_list(F.struct("archetype", "n"))).alias("by_type"))
    state = F.when(F.col("embedding_count") <= 0, "not_built").when(F.col("embedding_count") >= F.col("chunk_count"), "ready").otherwise("partial")
    return total.withColumns({"coverage": F.when(F.col("chunk_count") > 0, F.round(F.col("embedding_count") / F.col("chunk_count"), 4)).otherwise(0.0), "state": state, "archetype_counts": F.map_from_entries("by_type")}).drop("by_type")
