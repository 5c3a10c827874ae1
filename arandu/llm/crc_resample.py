"""Importance resampling towards a target distribution, over hashed runs of words.

Features of a text are its runs of 1 to n consecutive words; a feature's bucket is the CRC of its words joined by one
space. One scan of a text keeps a ring of running CRC states, one for each of the last n starts: each word begins a
state, and extends the others by a space and itself, so that every state passed is the CRC of a run and no run is ever
built. The scan leaves a text's buckets, sorted, as differences; counts of all texts and weights are read from those.

A bucket's gain is the logarithm of how much more frequent it is in the target's texts (both smoothed by one for each
bucket), in whole thousandths. A document's weight is the sum of its features' gains; Gumbel noise from a hash of its key
is added, and the best share is drawn, which samples without replacement by weight.

Defined cases: null and wordless texts have no features and the weight 0; a null key is hashed as an empty one and comes
last in ties; repeated rows are scored alike, and drawn one after the other; documents under the least number of words
are scored, but never drawn; an empty target or table of documents leaves smoothed counts alone, and no rows; texts are
read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Letters A to Z are lower-cased; 0-9, a-z and all bytes of other characters stay; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUNS, BUCKETS = 3, 10_000
#: Texts of an output batch, and features counted at once.
STEP, COUNTED = 500, 500_000
#: monotonically_increasing_id() counts the rows of a partition in these bits, the partition above them.
PLACE_BITS = 33


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in UTF-8, A-Z lower-cased."""
    return text.translate(LETTERS).split() if text else []


def run_hashes(words: Iterable[bytes], runs: int = RUNS) -> list[int]:
    """The CRC of every run of 1 to `runs` consecutive words joined by a space, repeats included."""
    out: list[int] = []
    ring: list[int] = []  # of the runs that end at the last word, the shortest first
    for word in words:
        spaced = b" " + word
        ring = [crc32(word), *[crc32(spaced, state) for state in ring[: runs - 1]]]
        out += ring
    return out


def width_of(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def packed(hashes: list[int], buckets: int) -> bytes:
    """Sorted buckets as differences, which are small and compress well."""
    own = np.sort(np.array(hashes, np.uint32) % np.uint32(buckets))
    return np.diff(own, prepend=np.uint32(0)).astype(width_of(buckets)).tobytes()


def unpacked(data: bytes, buckets: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, width_of(buckets)), dtype=np.int64)


def features(docs: DataFrame, text: str, runs: int, buckets: int) -> DataFrame:
    """n_words and packed buckets of each text, beside the columns that docs has besides the text."""
    others = [c for c in docs.columns if c != text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            n, data = [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                words = words_of(t.as_py())
                n.append(len(words))
                data.append(packed(run_hashes(words, runs), buckets))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=[*others, "n_words", "buckets"])

    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others), "n_words long", "buckets binary"])
    return docs.withColumn(text, F.col(text).cast("binary")).mapInArrow(scan, schema)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: counted in the tasks, added up by Spark; the driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, np.int64), [np.zeros(0, np.int64)], 0
        for data in (d for batch in batches for d in batch.column(0)):
            held.append(unpacked(data.as_py(), buckets))
            size += len(held[-1])
            if size > COUNTED:
                total += np.bincount(np.concatenate(held), minlength=buckets)
                held, size = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, object)
    for r in rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: floor(1000 ln(target's smoothed share / source's)), in doubles."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def noise(key: str | None, seed: int = 42) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of `seed:key`."""
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """n_features, weight and score of rows of key, name (the key as text), n_words and buckets."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, name, n_words, data = (batch.column(i) for i in range(4))
            n, weight = [], []
            for d in data:
                own = unpacked(d.as_py(), len(gains))
                n.append(len(own))
                weight.append(int(gains[own].sum()))
            total = [w + noise(k.as_py(), seed) for w, k in zip(weight, name, strict=True)]
            yield pa.RecordBatch.from_arrays([key, n_words, *(pa.array(x, pa.int64()) for x in (n, weight, total))], names=["key", "n_words", "n_features", "weight", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "name", "n_words", "buckets").mapInArrow(score, f"key {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """key, n_features, weight, score and rank of every document; rank is 1, 2, ... for the drawn ones, else null.

    Drawn are `percent` of a hundred, rounded down, of the documents of at least `least_words` words: those of the
    highest scores, ties to the smaller key. They are ranked by ranges of the order, whose row counts say how many stand
    before each; ranges beyond the last drawn one are not numbered.
    """
    given = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    rows = stored(features(given, "text", runs, buckets), "resample-buckets")
    wanted = bucket_counts(features(target.select(F.col(text).alias("text")), "text", runs, buckets), buckets)
    own = stored(scored(rows, gains_of(bucket_counts(rows, buckets), wanted), seed), "resample-scores")
    drop_stored(rows)
    fit = own.where(F.col("n_words") >= least_words)
    most = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), "n_features"]
    ranged = stored(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("place", PLACE_BITS)
    parts = ranged.groupBy(part.alias("part")).count()  # as many rows as ranges
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    drawn = ranged.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.when(rank <= most, rank).cast("long"))
    others = own.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(others.select(*out))
