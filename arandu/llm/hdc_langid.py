"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A letter trigram is the product of its letters' vectors, the first permuted
(rotated) twice, the second once. A document is the sum (bundle) of its trigrams' vectors, a language prototype the
sum of the unit vectors of its training documents, and a document gets the language whose prototype has the largest
cosine with it.

Defined cases: null text or a text without any letter gives ("und", 0.0); ties go to the first language in alphabetical
order; without training rows every document is "und"; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, free_name, hash_fraction, held, small_side, stored

DIM = 1024
SEED = 20_011
#: Letters that share the quick trigram table; documents with further letters take the general path.
TABLE_LETTERS = 128
SLICE = 4096


class Encoder:
    """Document vectors of a batch of texts. One per worker process; it keeps the vectors of trigrams seen."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letter_class = np.full(0x110000, -1, np.int32)  # -1: not looked at yet; 0: no letter; else a letter's class
        self.letters: list[np.ndarray] = [self._random(0)]  # class 0 is the boundary between words
        self.of_trigram = np.full(TABLE_LETTERS**3, -1, np.int32)
        self.rows = np.empty((0, dim), np.int8)
        self.n_rows = 0

    def _random(self, code: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.letter_class[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]):
                if chr(code).isalpha():
                    self.letter_class[code] = len(self.letters)
                    self.letters.append(self._random(int(code) + 1))
                else:
                    self.letter_class[code] = 0
            found = self.letter_class[codes]
        return found

    def _bind(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        letters = np.stack(self.letters)
        return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]

    def symbols(self, text: str) -> np.ndarray:
        """Letter classes of the lower-cased text, any run of other characters as one boundary, one at either end."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        found = self._classes(codes)
        found = np.concatenate(([0], found, [0]))
        return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One row of dim float32 sums for each text; all zero if it has no letter."""
        parts = [self.symbols(t) for t in texts]
        parts = [p if len(p) > 2 else p[:0] for p in parts]
        lengths = np.array([max(0, len(p) - 2) for p in parts])
        out = np.zeros((len(texts), self.dim), np.float32)
        if not lengths.sum():
            return out
        doc = np.repeat(np.arange(len(texts)), lengths)
        a, b, c = (np.concatenate([p[i : len(p) - 2 + i] for p in parts]) for i in range(3))
        quick = (a < TABLE_LETTERS) & (b < TABLE_LETTERS) & (c < TABLE_LETTERS)
        if quick.all():
            self._add(out, doc, self._known((a * TABLE_LETTERS + b) * TABLE_LETTERS + c))
        else:
            if quick.any():
                self._add(out, doc[quick], self._known((a[quick] * TABLE_LETTERS + b[quick]) * TABLE_LETTERS + c[quick]))
            rest, n = ~quick, np.int64(len(self.letters))
            keys, which = np.unique((a[rest] * n + b[rest]) * n + c[rest], return_inverse=True)
            for at in range(0, len(keys), SLICE):
                own = keys[at : at + SLICE]
                here = (which >= at) & (which < at + len(own))
                counts = np.zeros((len(texts), len(own)), np.float32)
                np.add.at(counts, (doc[rest][here], which[here] - at), 1)
                out += counts @ self._bind(own // n // n, own // n % n, own % n).astype(np.float32)
        return out

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Rows of self.rows for trigram keys of the quick table."""
        rows = self.of_trigram[keys]
        if (rows < 0).any():
            new = np.unique(keys[rows < 0])
            n = TABLE_LETTERS
            made = self._bind(new // n // n, new // n % n, new % n)
            if self.n_rows + len(new) > len(self.rows):
                grown = np.empty((max(2 * len(self.rows), self.n_rows + len(new), SLICE), self.dim), np.int8)
                grown[: self.n_rows] = self.rows[: self.n_rows]
                self.rows = grown
            self.rows[self.n_rows : self.n_rows + len(new)] = made
            self.of_trigram[new] = np.arange(self.n_rows, self.n_rows + len(new))
            self.n_rows += len(new)
            rows = self.of_trigram[keys]
        return rows

    def _add(self, out: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> None:
        width = self.n_rows
        counts = np.bincount(doc * np.int64(width) + rows, minlength=len(out) * width).reshape(len(out), width).astype(np.float32)
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), SLICE):
            own = used[at : at + SLICE]
            out += counts[:, own] @ self.rows[own].astype(np.float32)
        if self.n_rows > 8 * SLICE:  # rare letters have filled it; common trigrams come back at once
            self.of_trigram[:] = -1
            self.rows, self.n_rows = np.empty((0, self.dim), np.int8), 0


def _encoder(dim: int, seed: int) -> Encoder:
    return held(("bundles", dim, seed), lambda: Encoder(dim, seed))


def batches(texts: list[str], rows: int = 64, chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts): at most that many rows and about that many characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or size + len(t) > chars):
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def unit_bundles(encoder: Encoder, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, unit vectors) of some texts at a time: those of all texts of an Arrow batch are 12 KB each."""
    for at, some in batches(texts):
        out = encoder.bundle(some)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64))
        norm[norm == 0] = 1
        yield at, out / norm[:, None]


class Prototypes:
    """Languages in alphabetical order and their unit prototype vectors."""

    def __init__(self, langs: list[str], vectors: np.ndarray, dim: int = DIM, seed: int = SEED):
        self.langs, self.vectors, self.dim, self.seed = langs, vectors.astype(np.float32), dim, seed

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        encoder, out, scores = _encoder(self.dim, self.seed), [], np.zeros(len(texts))
        if not self.langs:
            return ["und"] * len(texts), scores
        for at, own in unit_bundles(encoder, texts):
            cosines = own @ self.vectors.T
            best = cosines.argmax(axis=1)
            known = own.any(axis=1)
            scores[at : at + len(own)] = np.where(known, np.clip(cosines[np.arange(len(own)), best], 0, 1), 0)
            out += [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return out, scores

    def column(self, text: str | Column) -> Column:
        """struct<lang_pred string, score double> of a text column. The prototypes, 4 * dim bytes a language, go to each worker once.

        Spark is told not to move or repeat the call, so that a filter on the answer does not work it out a second time.
        """
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("lang_pred string, score double")
        def predict(texts: pd.Series) -> pd.DataFrame:
            langs, scores = shared.value.predict([t or "" for t in texts])
            return pd.DataFrame({"lang_pred": langs, "score": scores})

        return predict.asNondeterministic()(text)


def _added(frames: Iterator[pd.DataFrame], vectors) -> Iterator[pd.DataFrame]:
    """One row (lang, vector) for each language: the sum of vectors(rows of the language)."""
    total: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang"):
            total[lang] = total.get(lang, 0) + vectors(group)
    if total:
        yield pd.DataFrame({"lang": list(total), "vector": [v.astype("<f8").tobytes() for v in total.values()]})


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, dim: int = DIM, seed: int = SEED) -> Prototypes:
    """Prototypes from labelled rows, of every language that occurs.

    Bound: about per_lang rows of each language, chosen by a hash of key and text. Rows with null text or language, or
    without a letter, teach nothing. Texts are bundled where they are read; only sums, one a task and language, are
    shuffled, and one for each language comes to the driver.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "hdc-langs")
    part = (per_lang / F.col("n")).cast("double")
    chosen = rows.join(small_side(sizes, sizes.count()), "lang").where(hash_fraction(part, F.col("key"), F.col("text"))).select("lang", "text")

    def bundles(group: pd.DataFrame) -> np.ndarray:
        return sum((own.sum(axis=0, dtype=np.float64) for _, own in unit_bundles(_encoder(dim, seed), group["text"].tolist())), np.zeros(dim))

    def sums(group: pd.DataFrame) -> np.ndarray:
        return sum(np.frombuffer(v, "<f8") for v in group["vector"])

    schema = "lang string, vector binary"
    partial = chosen.mapInPandas(lambda frames: _added(frames, bundles), schema).repartition("lang").mapInPandas(lambda frames: _added(frames, sums), schema)
    total = {r["lang"]: v for r in partial.collect() if (v := np.frombuffer(r["vector"], "<f8")).any()}
    drop_stored(sizes)
    langs = sorted(total)
    vectors = np.array([total[k] / np.linalg.norm(total[k]) for k in langs]).reshape(len(langs), dim)
    return Prototypes(langs, vectors, dim, seed)


def with_random_letters(model: Prototypes, words: int = 20_000) -> Prototypes:
    """model with one more prototype, "und", of words of 2 to 9 random letters a-z: what is nearest to it is no language."""
    rng = np.random.default_rng(model.seed)
    letters = rng.integers(ord("a"), ord("z") + 1, (words, 9), dtype=np.uint8)
    text = " ".join(bytes(row[:n]).decode() for row, n in zip(letters, rng.integers(2, 10, words), strict=True))
    own = next(unit_bundles(_encoder(model.dim, model.seed), [text]))[1]
    return Prototypes([*model.langs, "und"], np.concatenate((model.vectors, own)), model.dim, model.seed)


def identify(docs: DataFrame, model: Prototypes, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names that docs has already are replaced."""
    tmp = free_name(docs, "langid")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn(tmp, model.column(F.col(text))).select(*(F.col(f"`{c}`") for c in kept), F.col(f"{tmp}.lang_pred"), F.col(f"{tmp}.score"))
