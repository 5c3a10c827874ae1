"""Divergence of sources: how far the words of each source stand from those of its language and of its other sources.

Each language keeps the terms that occur in enough of its documents. Tasks count the terms of the texts they read, for
each language and source, and Spark adds the counts up. The kept terms are dealt out in the order of their UTF-8 bytes,
and cut into chunks; a chunk's sorted terms are its dictionary. Terms become integers by searchsorted, so that ids keep
that order, and counts become a dense vector for each source by bincount. Sources are compared chunk by chunk, by sums
over vectors; of equal differences the smaller id comes first.

All arithmetic is in integers. A share is 1 + floor(1e9 * (count + 5) / (N + 5 V)), with three steps of long division, so
that it is exact up to N + 5 V of 9e15.

Defined cases: null texts, languages and sources count as empty ones; texts without a term count as documents of their
group; a group without kept terms still has its smoothed shares; a language that keeps no term gives its pairs the value
0; a source that is alone in its language has no pairs; repeated rows are documents of their own; an empty table gives
no rows; texts are read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Letters A to Z are lower-cased; a-z and all bytes of other characters stay; the rest separates terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it passes its counts on.
MOST_COUNTED = 400_000
#: Terms of a chunk, and sources of a block: a task compares two blocks over a chunk.
WIDTH, BLOCK = 1024, 256
SCALE, SMOOTH = 1000, 5


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) as tasks have counted them: several rows of a term are to be
    added up. A row of an empty term stands for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), (n, d) in groups.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([own_lang] * len(terms), pa.binary()), pa.array([own_source] * len(terms), pa.binary()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "d"])
            groups.clear()

        for batch in batches:
            for group_lang, group_source, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group_lang, group_source) not in groups:
                    groups[group_lang, group_source] = Counter({b"": 0}), Counter()
                n, d = groups[group_lang, group_source]
                terms = data.translate(LETTERS).split()
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in groups.values()) > MOST_COUNTED:
                yield from out()
        yield from out()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    return given.mapInArrow(count, "lang binary, source binary, term binary, n long, d long")


def kept_counts(docs: DataFrame, least_docs: int, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n for the terms that a language keeps, and a row of an empty term for each group.

    One shuffle, by language and term: tasks have added up what they read, so that a frequent term has a row for each
    task and source at most.
    """
    rows = counted(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    docs_with = F.sum("d").over(Window.partitionBy("lang", "term"))
    return rows.withColumn("all_d", docs_with).where((F.col("all_d") >= least_docs) | (F.col("term") == F.lit(b""))).select("lang", "source", "term", "n")


def summed(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """bincount by weights in whole numbers: in doubles each half of the bits stays exact."""
    low, high = np.bincount(codes, n & 0xFFFFFFFF, size), np.bincount(codes, n >> 32, size)
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


def encode_chunk(own_lang: bytes, chunk: str, source: list[bytes], term: list[bytes], n: np.ndarray) -> list[tuple]:
    """A chunk's dictionary row (its terms and their counts in the language), and a row of dense counts for each source."""
    terms, sources = np.array(sorted(set(term)), object), np.array(sorted(set(source)), object)
    ids, owners = np.searchsorted(terms, np.array(term, object)), np.searchsorted(sources, np.array(source, object))
    vectors = summed(owners * len(terms) + ids, n, len(sources) * len(terms)).reshape(len(sources), len(terms))
    rows = [(own_lang, chunk, None, terms.tolist(), vectors.sum(0).tolist())]
    return rows + [(own_lang, chunk, s, None, v.tolist()) for s, v in zip(sources.tolist(), vectors, strict=True)]


CHUNK = "lang binary, chunk string, source binary, terms array<binary>, counts array<long>"


def encoded(kept: DataFrame, width: int) -> DataFrame:
    """Chunks of at most `width` terms in UTF-8 order, as CHUNK; kept must not be derived anew by the range sampling."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])
        here, last, size = None, None, 0

        def out() -> pa.RecordBatch:
            rows = encode_chunk(here, f"{part}-{k}", held[0], held[1], np.array(held[2], np.int64))
            kinds = (pa.binary(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "chunk", "source", "terms", "counts"])

        for batch in batches:
            for own_lang, source, term, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_lang != here or term != last:
                    if held[0] and (own_lang != here or size >= width):
                        yield out()
                        held, k, size = ([], [], []), k + 1, 0
                    here, last, size = own_lang, term, size + 1
                held[0].append(source)
                held[1].append(term)
                held[2].append(n)
        if held[0]:
            yield out()

    rows = kept.where(F.col("term") != F.lit(b"")).select("lang", "source", "term", "n")
    return rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(encode, CHUNK)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE**3 * (counts + SMOOTH) / total), digit by digit in base SCALE."""
    rest = counts.astype(np.int64) + SMOOTH
    out = np.zeros_like(rest)
    for _ in range(3):
        digit, rest = np.divmod(rest * SCALE, total)
        out = out * SCALE + digit
    return out + 1


def compare(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of two blocks of sources over a chunk: for each pair the sum of differences there; for each source of a block that
    meets itself, its `most` terms furthest above the language's share."""
    own = frame[frame["source"].isna()].iloc[0]
    rows = frame[frame["source"].notna()].sort_values("source")
    terms, width, v = own["terms"], len(own["terms"]), int(own["v"])
    names, blocks = rows["source"].tolist(), rows["block"].to_numpy()
    counts = np.stack([np.zeros(width, np.int64) if c is None else np.asarray(c, np.int64) for c in rows["counts"]]) if names else np.zeros((0, width), np.int64)
    p, lang, chunk, out = shares(counts, (rows["n"].to_numpy(np.int64) + SMOOTH * v)[:, None] if v else 1), own["lang"], own["chunk"], []
    low, high = int(own["low"]), int(own["high"])
    for i in range(len(names)):
        others = np.flatnonzero(blocks == high) if blocks[i] == low else np.zeros(0, int)
        others = others[others > i] if low == high else others
        for j, value in zip(others.tolist(), np.abs(p[others] - p[i]).sum(1).tolist(), strict=True):
            out.append((lang, names[i], names[j], "pair", value))
    if low == high and width:
        q = shares(np.asarray(own["counts"], np.int64), int(own["lang_n"]) + SMOOTH * v)
        for i in range(len(names)):
            above = p[i] - q
            ids = np.flatnonzero((counts[i] > 0) & (above > 0))
            for k in ids[np.lexsort((ids, -above[ids]))][:most].tolist():
                out.append((lang, names[i], terms[k], "term", int(above[k])))
    return pd.DataFrame(out, columns=["lang", "source", "item", "part", "value"])


def audit(docs: DataFrame, least_docs: int = 30, most: int = 50, width: int = WIDTH, block: int = BLOCK, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language all other sources by distance ("pair"), and
    its `most` terms furthest above the language's share ("term"); equal values in the order of the items."""
    kept = stored(kept_counts(docs, least_docs, lang, source, text), "divergence-counts")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum((F.col("term") != F.lit(b"")).cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    blocks = F.greatest(F.ceil(F.count_distinct("source") / block), F.lit(1)).cast("int")
    langs = stored(langs.join(groups.groupBy("lang").agg(blocks.alias("n_blocks")), "lang"), "divergence-langs")
    groups = stored(groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int")), "divergence-groups")
    chunks = stored(encoded(kept, width), "divergence-chunks")
    none = langs.where("v = 0").select("lang", F.lit("none").alias("chunk"), F.array().cast("array<binary>").alias("terms"), F.array().cast("array<long>").alias("counts"))
    dictionary = chunks.where(F.col("source").isNull()).select("lang", "chunk", "terms", "counts").unionByName(none)
    # Every group has a row in every chunk of its language, with its counts if it has some.
    vectors = chunks.where(F.col("source").isNotNull()).select("lang", "chunk", "source", "counts")
    grid = groups.join(dictionary.select("lang", "chunk"), "lang").join(vectors, ["lang", "chunk", "source"], "left")
    # A block of sources meets itself and every other one.
    met = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("lang", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "n", "counts", F.lit(None).cast("array<binary>").alias("terms"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("lang_n"))
    met = met.join(langs.select("lang", F.col("v").alias("_v")), "lang").withColumn("v", F.col("_v")).drop("_v")
    own = dictionary.join(langs, "lang").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("high", F.explode(F.sequence(F.col("low"), F.col("n_blocks") - 1)))
    own = own.select("lang", "chunk", "low", "high", F.lit(None).cast("binary").alias("source"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("long").alias("n"), "counts", "terms", "v", "lang_n")
    found = met.unionByName(own).groupBy("lang", "chunk", "low", "high").applyInPandas(lambda frame: compare(frame, most), "lang binary, source binary, item binary, part string, value long")
    found = stored(found, "divergence-found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item")))
    best = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= most)
    out = pairs.withColumn("rank", place).unionByName(best.select("lang", "source", "item", "value", "part", "rank"))
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")
