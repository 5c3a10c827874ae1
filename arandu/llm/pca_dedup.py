"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes of a bounded sample, so that the leading dimensions carry most of a dot
product. Vectors of a label are laid out in tiles along those axes. Of two tiles, the products of the leading
dimensions are added up first; what the rest can add is bounded by the product of the suffix norms, and a tile pair is
done when no cosine in it can reach the threshold any more. Tile pairs whose boxes in the leading axes are too far
apart are not compared at all.

Neighbouring tiles travel as one block. Blocks meet in the grid cells of the first axes that both can reach, so that
no block is tested against all others, and a tile travels once to each block within reach, not once to each tile.

Equal vectors of a label are one class with a weight. A pair of blocks returns, per class, the number of linked
vectors, and a spanning forest of its links; components are joined from the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts, and those without a label, link
with nothing; vectors of different length link with nothing; null ids count as rows of their own; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import bounded, drop_stored, stored
from .components import connected_components

#: Vectors of a tile and their bytes, at most; vectors of the parts that are compared at once; tiles of a block.
TILE, TILE_BYTES, PART, TILES = 2048, 1 << 20, 256, 8
#: Dimensions added at a time, leading axes in a tile's box, and those of them whose cells blocks meet in.
STEP, BOX, GRID = 16, 6, 3
#: Cosines this near the threshold are taken again from the vectors as given.
EDGE = 1e-9


def unit_rows(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / np.where(top > 0, top, 1)
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), 1e-300)


def axes_of(moments: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling share of the squared length, from the sum of the outer products of unit rows."""
    return np.linalg.eigh(moments)[1][:, ::-1]


def principal_axes(sample: np.ndarray) -> np.ndarray:
    unit = unit_rows(sample)
    return axes_of(unit.T @ unit)


def turned(raw: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit rows along the principal axes of their number of dimensions."""
    unit = unit_rows(raw.astype(np.float64))
    own = axes.get(raw.shape[1])
    return unit if own is None else unit @ own


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Column k: the norm of each row's part from dimension k * STEP on."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], STEP), axis=1)
    return np.sqrt(np.maximum(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], 0))


def links_of(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (turned unit rows) with cosine >= threshold."""
    norms_a, norms_b, dims = suffix_norms(a), suffix_norms(b), a.shape[1]
    cosines = np.zeros((len(a), len(b)))
    for k, lo in enumerate(range(0, dims, STEP)):
        cosines += a[:, lo : lo + STEP] @ b[:, lo : lo + STEP].T
        if lo + STEP < dims and not (cosines + norms_a[:, k + 1 : k + 2] * norms_b[:, k + 1] >= threshold - EDGE).any():
            return np.zeros(0, int), np.zeros(0, int)
    i, j = np.nonzero(cosines >= threshold - EDGE)
    near = cosines[i, j] < threshold + EDGE
    if near.any():
        keep = np.ones(len(i), bool)
        x, y = raw_a[i[near]].astype(float), raw_b[j[near]].astype(float)
        keep[near] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def links_between(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within a tile (same: i < j) or between two, of turned unit rows and the vectors as given."""
    out_i, out_j = [np.zeros(0, int)], [np.zeros(0, int)]
    for lo in range(0, len(a), PART):
        for at in range(lo if same else 0, len(b), PART):
            i, j = links_of(a[lo : lo + PART], b[at : at + PART], raw_a[lo : lo + PART], raw_b[at : at + PART], threshold)
            i, j = i + lo, j + at
            if same and at == lo:
                i, j = i[i < j], j[i < j]
            out_i.append(i)
            out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def compare(raw_a: np.ndarray, raw_b: np.ndarray | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within a tile (raw_b None: i < j) or between two."""
    own_b = raw_a if raw_b is None else raw_b
    return links_between(unit_rows(raw_a) @ axes, unit_rows(own_b) @ axes, raw_a, own_b, threshold, raw_b is None)


def forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each position, the smallest id that the links (i, j) of positions reach."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def _tiles(frames: Iterator[pd.DataFrame], axes: dict[int, np.ndarray], kind: str) -> Iterator[pd.DataFrame]:
    """Tiles of the sorted vectors of a partition; TILES of them in a row and of one label are a block."""
    from pyspark import TaskContext

    part, block, in_block, rows, own, before = TaskContext.get().partitionId(), 0, 0, [], None, None

    def done() -> pd.DataFrame:
        nonlocal block, in_block, before
        if before is not None and (before != own or in_block >= TILES):
            block, in_block = block + 1, 0
        before, in_block = own, in_block + 1
        raw = np.array([r[2] for r in rows], kind)
        lead = turned(raw, axes)[:, :BOX]
        return pd.DataFrame({
            "block": [part << 32 | block], "tile": [in_block], "label": [own[0]], "dims": [own[1]],
            "ids": [np.array([r[0] for r in rows], "<i8").tobytes()], "weights": [np.array([r[1] for r in rows], "<i8").tobytes()], "raw": [raw.tobytes()],
            "low": [lead.min(axis=0).tolist()], "high": [lead.max(axis=0).tolist()],
        })

    for frame in frames:
        for label, dims, rep, weight, vector in zip(frame["label"], frame["dims"], frame["rep"], frame["copies"], frame["vector"], strict=True):
            most = max(1, min(TILE, TILE_BYTES // (dims * np.dtype(kind).itemsize)))
            if rows and (own != (label, dims) or len(rows) >= most):
                yield done()
                rows = []
            own = (label, dims)
            rows.append((rep, weight, vector))
    if rows:
        yield done()


def _block_pair(frame: pd.DataFrame, axes: dict[int, np.ndarray], threshold: float, kind: str) -> pd.DataFrame:
    """rep, n, root of the linked classes of a block (a = b) or of two blocks: every tile of a with every tile of b."""
    rows = list(frame.sort_values(["block", "tile"]).itertuples(index=False))
    raws = [np.frombuffer(r.raw, kind).reshape(-1, r.dims) for r in rows]
    turns = [turned(x, axes) for x in raws]
    starts = np.cumsum([0, *map(len, raws)])
    ids, weights = np.frombuffer(b"".join(r.ids for r in rows), "<i8"), np.frombuffer(b"".join(r.weights for r in rows), "<i8")
    count, position = np.zeros(len(ids), np.int64), {v: k for k, v in enumerate(ids.tolist())}
    ends_a, ends_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for x, a in enumerate(rows):
        for y in range(x, len(rows)):
            b = rows[y]
            if (a.block == b.block) != (a.a == a.b):
                continue  # two blocks: links within one of them are that one's own work
            apart = np.maximum(0, np.maximum(np.subtract(a.low, b.high), np.subtract(b.low, a.high)))
            if (apart * apart).sum() > 2 - 2 * threshold + EDGE:
                continue
            i, j = links_between(turns[x], turns[y], raws[x], raws[y], threshold, x == y)
            if not len(i):
                continue
            i, j = i + starts[x], j + starts[y]
            count += np.bincount(i, weights[j], len(ids)).astype(np.int64) + np.bincount(j, weights[i], len(ids)).astype(np.int64)
            near, own = np.unique(np.concatenate((i, j)), return_inverse=True)
            root = forest(own[: len(i)], own[len(i) :], ids[near])
            ends_a.append(near)
            ends_b.append(np.array([position[v] for v in root.tolist()], int))
    linked = count > 0
    root = forest(np.concatenate(ends_a), np.concatenate(ends_b), ids)
    return pd.DataFrame({"rep": ids[linked], "n": count[linked], "root": root[linked]})


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for dims, some in frame.groupby("dims")["vector"]:
            unit = unit_rows(np.array(some.tolist(), np.float64))
            total[dims] = total.get(dims, 0) + unit.T @ unit
    if total:
        yield pd.DataFrame({"dims": list(total), "moments": [m.tobytes() for m in total.values()]})


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for dims, moments in zip(frame["dims"], frame["moments"], strict=True):
            total[dims] = total.get(dims, 0) + np.frombuffer(moments)
    if total:
        yield pd.DataFrame({"dims": list(total), "moments": [m.tobytes() for m in total.values()]})


def block_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """a, b (a <= b): the blocks of one label whose boxes are within reach, found in the cells of the first GRID axes."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + EDGE
    boxes = [(F.min(F.get("low", F.lit(k))).alias(f"low{k}"), F.max(F.get("high", F.lit(k))).alias(f"high{k}")) for k in range(BOX)]
    blocks = tiles.groupBy("block", "label", "dims").agg(*(c for pair in boxes for c in pair))
    cell = lambda x: F.floor(x / max(reach, 0.05)).cast("int")

    def met(own: DataFrame, name: str, wider: float) -> DataFrame:
        out = own.select("label", "dims", F.col("block").alias(name), *(F.col(f"{c}{k}").alias(f"{c}{k}_{name}") for k in range(BOX) for c in ("low", "high")))
        for k in range(GRID):
            low, high = (F.coalesce(F.col(f"{c}{k}_{name}"), F.lit(0.0)) for c in ("low", "high"))
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(cell(low - wider), cell(high + wider))))
        return out

    both = met(blocks, "a", 0.0).join(met(blocks, "b", reach), ["label", "dims", *(f"cell{k}" for k in range(GRID))]).where("a <= b")
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"low{k}_a") - F.col(f"high{k}_b"), F.col(f"low{k}_b") - F.col(f"high{k}_a")), 2) for k in range(BOX)), F.lit(0.0))
    return both.where(F.coalesce(apart, F.lit(0.0)) <= reach * reach + EDGE).select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, sample: int = 20_000) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable by links), kept (key = component_id).

    sample: most vectors that the principal axes are taken from; the axes change the order of the work, never the links.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kind = "<f4" if isinstance(getattr(rows.schema["vector"].dataType, "elementType", None), FloatType) else "<f8"
    fine = F.expr("label is not null and id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    classes = stored(rows.where(fine).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("vector")), "pca-classes")

    wide = lambda df: df.withColumn("vector", F.col("vector").cast("array<float>" if kind == "<f4" else "array<double>"))
    partial = wide(bounded(classes.select("vector", "dims", "rep"), sample, F.col("rep")).select("vector", "dims")).mapInPandas(_moments, "dims int, moments binary")
    moments = partial.repartition("dims").mapInPandas(_summed, "dims int, moments binary").collect()
    axes = {r["dims"]: axes_of(np.frombuffer(r["moments"]).reshape(r["dims"], r["dims"])) for r in moments}
    turns = spark.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def lead(given: pd.Series) -> pd.Series:
        out, sizes = np.zeros((len(given), GRID + 1)), given.map(len).to_numpy()
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            x = turned(np.array(given.iloc[at].tolist()), turns.value)[:, :GRID]
            out[at, : x.shape[1]] = np.floor(x / 0.35)
            out[at, GRID] = x[:, 0]
        return pd.Series(list(out), dtype=object)

    placed = stored(classes.withColumn("at", lead("vector")), "pca-placed")
    place = [F.col("label"), F.col("dims"), *(F.col("at")[k] for k in range(GRID + 1)), F.col("rep")]
    tiles = wide(placed.repartitionByRange(*place).sortWithinPartitions(*place).select(F.col("label").cast("string").alias("label"), "dims", "rep", "copies", "vector"))
    tiles = stored(tiles.mapInPandas(lambda frames: _tiles(frames, turns.value, kind), "block long, tile int, label string, dims int, ids binary, weights binary, raw binary, low array<double>, high array<double>"), "pca-tiles")
    pairs = stored(block_pairs(tiles.select("block", "label", "dims", "low", "high"), threshold), "pca-pairs")
    work = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(tiles.drop("label"), "block")
    found = work.groupBy("a", "b").applyInPandas(lambda frame: _block_pair(frame, turns.value, threshold, kind), "rep long, n long, root long")
    found = stored(found, "pca-found")

    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    result = classes.where("copies > 1").select("rep", "copies").join(counts, "rep", "full").join(labels.withColumnRenamed("node", "rep"), "rep", "full")
    result = stored(result.select("rep", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "pca-result")
    copies = stored(classes.where("copies > 1").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), F.col("rep").alias("_rep")), "pca-copies")
    drop_stored(placed, tiles, pairs, found, classes)
    out = rows.join(copies, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left").select("id", F.when(fine, F.coalesce("_rep", "id")).alias("rep"))
    out = out.join(result.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
