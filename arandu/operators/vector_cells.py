"""Vectors clustered in cells, so that an exact nearest-neighbour search reads few of them.

Cells are the regions of centres, found by a few rounds of k-means over a bounded sample; every vector goes to its nearest
centre, and one folder holds each cell's vectors. A small table has each cell's centre and radius. A vector v of a cell
with centre c is at least |q - c| - r away from a query q, r being the cell's radius, which for unit vectors bounds its
cosine: q·v = 1 - |q - v|² / 2. A search reads the most promising cells first, and then, by partition pruning, only those
whose bound reaches the k-th cosine found. Centres never change a result, only what is read.

Vectors that are null, empty, of another length than the first one's, not finite or zero are kept apart and always read, as
the bound does not hold for them; so are vectors that are not of length 1 within ROUNDING.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import cosine, literal_vector

#: Vectors that centres are learned from, rounds of learning, and vectors a cell should have.
SAMPLED, ROUNDS, PER_CELL = 20_000, 6, 2_000
#: Cells read first, and cells at most: the driver holds their centres.
FIRST_CELLS, MOST_CELLS = 4, 4_096
#: How far from length 1 a vector may be, and what the rounding of stored vectors and of cosines may change.
ROUNDING = 1e-4
#: The cell of vectors that have no bound.
APART = -1


def _plain(column: str, size: int) -> Column:
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = (F.size(column) == size) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(fine & (F.abs(norm - 1) <= ROUNDING), F.lit(False))


def learn_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from spread rows of the sample; cells that lose all rows go."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres * centres).sum(1) / 2, 1)


class VectorCells:
    """A clustered table of vectors in a folder, with all columns of the rows it was built from."""

    def __init__(self, spark: SparkSession, folder: str, vector: str = "vector"):
        self.spark, self.folder, self.vector = spark, folder.rstrip("/"), vector

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def cells(self) -> DataFrame:
        """cell, centre, radius, n of each cell."""
        return self.spark.read.parquet(f"{self.folder}/cells")

    def build(self, rows: DataFrame, cells: int | None = None) -> VectorCells:
        """Cluster rows; the number of cells follows their number unless it is given. The sample are rows of the smallest
        hashes of their vectors. One shuffle brings a cell's rows together, in several files where they are many."""
        first = rows.where(F.size(self.vector) > 0).select(F.size(self.vector).alias("n")).limit(1).collect()
        size = first[0]["n"] if first else 0
        fine = rows.where(_plain(self.vector, size)).select(F.transform(self.vector, lambda x: x.cast("double")).alias("v"))
        n = fine.count()
        sample = [r["v"] for r in fine.orderBy(F.xxhash64("v")).limit(SAMPLED).collect()]
        wanted = min(MOST_CELLS, cells or max(1, -(-n // PER_CELL)))
        centres = learn_centres(np.array(sample), wanted) if sample else np.zeros((0, size))

        @F.pandas_udf("cell int, distance double")
        def placed(vectors: pd.Series) -> pd.DataFrame:
            given = np.array(vectors.tolist(), np.float64).reshape(len(vectors), size)
            own = nearest(given, centres)
            return pd.DataFrame({"cell": own.astype(np.int32), "distance": np.sqrt(((given - centres[own]) ** 2).sum(1))})

        own = rows.where(_plain(self.vector, size)).withColumn("_at", placed(F.transform(self.vector, lambda x: x.cast("double")))) if sample else None
        apart = rows.where(~_plain(self.vector, size)).withColumns({"cell": F.lit(APART), "distance": F.lit(None).cast("double")})
        both = apart if own is None else own.select(*rows.columns, "_at.cell", "_at.distance").unionByName(apart)
        both.repartition("cell", F.pmod(F.xxhash64(self.vector), F.lit(8))).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows")
        found = self.rows().groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")) if n or rows.limit(1).count() else None
        table = self.spark.createDataFrame([(APART, None)] + [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        full = table.join(F.broadcast(found), "cell") if found is not None else table.withColumns({"radius": F.lit(None).cast("double"), "n": F.lit(0).cast("long")}).limit(0)
        full.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")
        return self

    def bounds(self, query: list[float]) -> list[tuple[int, float]]:
        """(cell, the most that the cosine of a vector in it can be), best first. The query is of length 1 or scaled to it."""
        q = np.array(query, np.float64)
        norm = float(np.sqrt(q @ q))
        out = []
        for r in self.cells().collect():
            if r["cell"] == APART or not norm or len(r["centre"]) != len(q):
                out.append((r["cell"], math.inf))
                continue
            gap = max(0.0, float(np.sqrt(((q / norm - np.array(r["centre"])) ** 2).sum())) - r["radius"] - ROUNDING)
            out.append((r["cell"], norm * (1 - gap * gap / 2) + ROUNDING * (1 + norm)))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def search(self, query: list[float], k: int, *ties: str) -> DataFrame:
        """The k rows of the largest cosine, ties by the given columns: cosine_top's rows, read from few cells."""
        return self.scored(query, k).orderBy(F.desc("score"), *ties).limit(k)

    def scored(self, query: list[float], k: int) -> DataFrame:
        """The rows, with score, of the cells that can hold one of the k best."""
        bounds = self.bounds(query)
        read = [c for c, b in bounds if b == math.inf]
        read += [c for c, b in bounds if b < math.inf][:FIRST_CELLS]
        found = self._of(read, query)
        best = [r["score"] for r in found.select("score").orderBy(F.desc("score")).limit(k).collect()]
        least = best[-1] if len(best) == k and k else -math.inf
        more = [c for c, b in bounds if c in set(read) or b >= least - 1e-6]
        return self._of(more, query) if bounds else self.rows().withColumn("score", F.lit(0.0)).limit(0)

    def _of(self, cells: list[int], query: list[float]) -> DataFrame:
        return self.rows().where(F.col("cell").isin(cells)).drop("distance", "cell").withColumn("score", cosine(F.col(self.vector), literal_vector(query)))
