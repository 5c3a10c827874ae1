"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds its distinct shingles of k words. One hash of each shingle gives both its bin and its value; a
bin keeps its smallest value, an empty bin takes that of the first filled bin in its own random order. Documents with
equal sets are one class. Classes that agree in all rows of a band share a bucket; a bucket of m classes gives m - 1
candidate edges, each from its smallest member to another, so that pairs stay linear in the rows. Candidates are
confirmed on the full sets. A bucket that then still holds several components is compared across them, in blocks and on
full sets, so that no confirmed link depends on which member was the centre.

Defined cases: null or wordless text has an empty set and is linked with nothing; fewer than k words are one shingle;
null ids stay alone; rows that repeat an id are taken to repeat its text and come back repeated; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, held, small_side, stored
from .components import connected_components

WORDS = 5
BANDS, ROWS = 32, 5
#: Pairs of a star that are confirmed in one place.
MEMBERS = 256
_rng = np.random.default_rng(7)
_ODD = _rng.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ODD = _rng.integers(1 << 62, size=(256, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all their bits count."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    width = min(k, len(words))
    out = np.full(n, np.uint64(width) * _ODD[-1], np.uint64)
    for i in range(width):
        out += _mixed(own[i : i + n] * _ODD[i] + _ODD[i])
    return np.unique(_mixed(out))


class Hasher:
    """Band keys of sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(11)
        self.order = np.array([rng.permutation(self.bins) for _ in range(self.bins)])
        width = (1 << 64) // self.bins + 1
        self.edges = np.array([min(i * width, (1 << 64) - 1) for i in range(self.bins)], np.uint64)

    def signature(self, own: np.ndarray) -> np.ndarray:
        """The smallest hash in each bin (the hashes are sorted, and a bin is a range of them), densified."""
        at = np.searchsorted(own, self.edges)
        upto = np.append(at[1:], len(own))
        filled = upto > at
        out = own[np.minimum(at, len(own) - 1)]
        if not filled.all():
            empty = np.flatnonzero(~filled)
            order = self.order[empty]
            first = filled[order].argmax(axis=1)
            out[empty] = out[order[np.arange(len(empty)), first]]
        return out

    def keys(self, own: np.ndarray) -> np.ndarray:
        if not len(own):
            return np.zeros(0, np.int64)
        rows = self.signature(own).reshape(self.bands, self.rows)
        odd = _BAND_ODD[np.arange(self.bands) % 256, : self.rows] + np.uint64(2) * np.arange(self.bands, dtype=np.uint64)[:, None]
        return _mixed((_mixed(rows) * odd).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, class (digest of the set), bands (array of bucket keys)."""

    @F.pandas_udf("n_shingles long, class binary, bands array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        hasher = held(("hasher", bands, rows), lambda: Hasher(bands, rows))
        out = []
        for t in texts:
            own = shingle_set(t, k)
            out.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), hasher.keys(own)))
        return pd.DataFrame(out, columns=["n_shingles", "class", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), sign(F.col(text).cast("binary")).alias("s")).select("id", "s.*")


def full_sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).view(np.int64) for t in texts], dtype=object)

    return docs.select(F.col(key).cast("long").alias("id"), of(F.col(text).cast("binary")).alias("own"))


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), all different, whose full sets reach the similarity: 100 * intersection >= percent * union.

    The centre a of a large star is dealt out with its set to one more place for each MEMBERS of its pairs.
    """
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "oph-ends")
    wanted = docs.select(key, text).join(small_side(ends, ends.count()).select(F.col("id").alias("_end")), F.col(key) == F.col("_end"), "left_semi")
    sets = stored(full_sets(wanted, key, text, k), "oph-sets")
    of_b, of_a = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b")), sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    hot = stored(pairs.groupBy("a").count().where(F.col("count") > MEMBERS).select(F.col("a").alias("_hot"), F.ceil(F.col("count") / MEMBERS).cast("int").alias("_salts")), "oph-hot")
    hot = small_side(hot, hot.count())
    salted = pairs.join(hot, F.col("a") == F.col("_hot"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_salts")), F.lit(0)).cast("int").alias("salt"))
    dealt = of_a.join(hot, F.col("a") == F.col("_hot"), "left").select("a", "own_a", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("salt"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    linked = salted.join(of_b, "b").join(dealt, ["a", "salt"]).where(100 * both >= percent * (F.size("own_a") + F.size("own_b") - both))
    out = stored(linked.select("a", "b"), "oph-links")
    drop_stored(ends, sets)
    return out


def shared(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, from those hashes that two sets or more hold, a slice at a time."""
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    values = values[times > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    at = [np.searchsorted(values, s) for s in sets]
    held = [np.unique(i[(i < len(values)) & (values[np.minimum(i, len(values) - 1)] == s)]) if len(values) else i[:0] for i, s in zip(at, sets, strict=True)]
    for lo in range(0, len(values), width):
        rows = np.zeros((len(sets), min(width, len(values) - lo)), np.float32)
        for r, i in enumerate(held):
            a, b = np.searchsorted(i, [lo, lo + width])
            rows[r, i[a:b] - lo] = 1
        out += rows @ rows.T
    return out


def bridges_of(components: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components, as a forest of the components: (smaller, larger)."""
    n = np.array([len(s) for s in sets], np.float64)
    both = shared(sets).astype(np.float64)
    i, j = np.nonzero((100 * both >= percent * (n[:, None] + n[None] - both)) & (components[:, None] < components[None]))
    root = {int(c): int(c) for c in components}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, b in zip(components[i].tolist(), components[j].tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def across(rest: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int, block: int = 512, hashes: int = 150_000) -> DataFrame:
    """Links (a, b) between components of the same bucket (rest: bucket, id, component; size and weight of the bucket).

    A bucket is dealt into blocks, of about `block` documents and `hashes` shingles at most, by a hash of the id, and
    each pair of its blocks is one group, compared on full sets in place: the work is spread evenly however large a
    bucket is, memory is bounded, and only a forest of the links comes out.
    """
    ends = stored(rest.select("id").distinct(), "oph-torn-ends")
    wanted = docs.select(key, text).join(small_side(ends, ends.count()).select(F.col("id").alias("_end")), F.col(key) == F.col("_end"), "left_semi")
    sets = stored(full_sets(wanted, key, text, k), "oph-torn-sets")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / hashes)).cast("int")
    own = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("bucket", "id", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id").sort_values("id")
        found = bridges_of(frame["component"].to_numpy(), [np.asarray(v, np.int64).view(np.uint64) for v in frame["own"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    made = own.join(sets, "id").groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")
    out = stored(made.distinct(), "oph-bridges")
    drop_stored(ends, sets)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable, itself included), kept (key = component_id)."""
    docs = docs.select(key, text)
    signed = stored(signatures(docs, key, text, k, bands, rows), "oph-signed")
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "oph-classes")
    rows_ = classes.select("id", "n", F.explode("bands").alias("bucket"))
    stars = stored(rows_.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1"), "oph-stars")
    members = stored(rows_.join(stars, "bucket"), "oph-members")
    sizes = classes.select(F.col("id").alias("centre"), F.col("n").alias("n_centre"))
    candidates = members.where("id <> centre").groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.first("n").alias("n"))
    candidates = candidates.join(sizes, F.col("a") == F.col("centre")).where(100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre"))
    candidates = stored(candidates.select("a", "b"), "oph-candidates")
    links = confirmed(candidates, docs, key, text, k, percent)
    found = stored(connected_components(links), "oph-found")

    #: Buckets of three and more classes that the stars left in several components; equal buckets of several bands once.
    labelled = members.where("size > 2").join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    labelled = stored(labelled, "oph-labelled")
    torn = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("content"), F.count("*").alias("size"), F.sum("n").alias("weight"))
    torn = stored(torn.where("least < most").groupBy("content", "size", "weight").agg(F.min("bucket").alias("bucket")), "oph-torn")
    rest = stored(labelled.join(torn.select("bucket", "size", "weight"), "bucket"), "oph-rest")
    if rest.limit(1).count():
        bridges = across(rest, docs, key, text, k, percent)
        moved = stored(connected_components(bridges), "oph-moved").withColumnsRenamed({"node": "from", "component": "to"})
        own = found.unionByName(moved.select(F.col("from").alias("node"), F.col("from").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        found = stored(own.join(moved, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")), "oph-found")
    drop_stored(members, stars, candidates, labelled, torn, rest, links)

    merged = classes.join(found, F.col("id") == F.col("node"), "left").select("class", "copies", F.col("id").alias("first"), F.coalesce("component", "id").alias("component"))
    merged = stored(merged.where("copies > 1 or component <> first").select("class", "component"), "oph-merged")
    drop_stored(classes)
    out = signed.select("id", "n_shingles", "class").join(merged, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
