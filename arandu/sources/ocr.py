"""OCR results: words to lines, statistics, language codes, and engines tried in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import filled
from ..functions.values import CLOUD_LANGUAGES, OCR_PROVIDERS, TESSERACT_LANGUAGES


class ProviderUnavailable(RuntimeError):
    """An engine is not installed or not set up."""


#: What tells the lines of a result apart.
_LINE = ("page", "block", "par", "line")


def _confidence(conf: Column) -> Column:
    return F.when(conf > 1, conf / 100).when(conf >= 0, conf)


def _boxed(lines: DataFrame, *keys: str) -> DataFrame:
    corners = ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    return lines.select(*keys, *_LINE, "text", "confidence", F.array(*(F.col(c).cast("double") for c in corners)).alias("box"))


def group_words(words: DataFrame, *keys: str) -> DataFrame:
    """Lines of words (page, block, par, line, seq, text, conf, left, top, width, height): text, mean confidence, box.

    Confidences over 1 are percentages, negative ones count as missing; blank words are left out. The words may stand
    anywhere, so all are shuffled; group_adjacent_words does the same for words in the order of an engine.
    """
    own = words.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    lines = own.groupBy(*keys, *_LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.avg(_confidence(F.col("conf"))), 4).alias("confidence"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    return _boxed(lines, *keys)


def group_adjacent_words(words: DataFrame, *keys: str) -> DataFrame:
    """group_words where the words of each line follow one another in one partition, as when results are exploded: nothing
    is shuffled, and a task holds a batch of words and the line that the batch ends in.

    Keys are numbers, strings, booleans, dates or times.
    """
    at = [*keys, *_LINE]
    edges = {"x0": F.col("left"), "y0": F.col("top"), "x1": F.col("left") + F.col("width"), "y1": F.col("top") + F.col("height")}
    own = words.select(*at, "seq", F.trim("text").alias("text"), _confidence(F.col("conf")).cast("double").alias("confidence"), *(x.cast("double").alias(c) for c, x in edges.items())).where("text <> ''")
    kinds = [f for f in own.schema if f.name != "seq"]

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([*rest, batch]).combine_chunks()
                starts = _starts(held, at)
                yield from _runs_as_lines(held[: starts[-1]], starts[:-1], at)
                rest = held[starts[-1] :].to_batches()
        if rest:
            yield from _runs_as_lines(pa.Table.from_batches(rest).combine_chunks(), np.zeros(1, "int64"), at)

    lines = own.mapInArrow(lines_of, StructType([StructField(f.name, f.dataType) for f in kinds]))
    return _boxed(lines.withColumn("confidence", F.round("confidence", 4)), *keys)


def _starts(words: pa.Table, at: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in a column of `at`; nulls are alike."""
    new = np.zeros(len(words), bool)
    new[0] = True
    for c in at:
        x, before = words[c][1:], words[c][:-1]
        other = pc.or_(pc.fill_null(pc.not_equal(x, before), False), pc.xor(pc.is_null(x), pc.is_null(before)))
        new[1:] |= other.to_numpy()
    return np.flatnonzero(new)


def _runs_as_lines(words: pa.Table, starts: np.ndarray, at: list[str]) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(words)))
    edges = (("confidence", "mean"), ("x0", "min"), ("y0", "min"), ("x1", "max"), ("y1", "max"))
    found = pa.table({"_run": run} | {c: words[c] for c, _ in edges}).group_by("_run", use_threads=False).aggregate(edges)
    ordered = np.zeros(len(words), bool)
    ordered[1:] = pc.fill_null(pc.greater(words["seq"][1:], words["seq"][:-1]), False).to_numpy()
    ordered[starts] = True
    if not ordered.all():
        by = pa.table({"_run": run, "seq": words["seq"], "text": words["text"]})
        words = words.take(pc.sort_indices(by, [(c, "ascending") for c in by.column_names], null_placement="at_start"))
    text = pa.ListArray.from_arrays(pa.array(np.append(starts, len(words)), pa.int32()), words["text"].combine_chunks())
    columns = {c: words[c].take(pa.array(starts)) for c in at} | {"text": pc.binary_join(text, " ")}
    columns |= {c: found[f"{c}_{how}"] for c, how in edges}
    yield from pa.table(columns).to_batches()


def line_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """line_count, page_count (1 at least) and average_confidence."""
    return lines.groupBy(*keys).agg(F.count("*").alias("line_count"), F.greatest(F.countDistinct(F.nullif("page", F.lit(0))), F.lit(1)).alias("page_count"), F.round(F.avg("confidence"), 4).alias("average_confidence"))


def _codes(hint: Column) -> Column:
    return F.filter(F.transform(F.split(hint, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def _mapped(values: dict[str, str], t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), t)


def tesseract_languages(hint: Column) -> Column:
    """por+eng style codes, each once; por+eng for none."""
    return F.coalesce(filled(F.array_join(F.array_distinct(F.transform(_codes(hint), lambda t: _mapped(TESSERACT_LANGUAGES, t))), "+")), F.lit("por+eng"))


def cloud_language(hint: Column) -> Column:
    """The first code, without its region where that is Brazil's or the United States'; null for none."""
    return _mapped(CLOUD_LANGUAGES, F.get(_codes(hint), F.lit(0)))


def flat_box(polygon: Column) -> Column:
    """x, y, x, y ... of an array of points."""
    return F.flatten(F.transform(polygon, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))


Engine = Callable[[bytes], list[dict]]


def provider_sequence(provider: str | None) -> list[str]:
    name = (provider or "auto").strip().lower().replace("-", "_")
    if name != "auto" and name not in OCR_PROVIDERS:
        raise ValueError(f"unsupported OCR provider: {provider}")
    return list(OCR_PROVIDERS) if name == "auto" else [name]


def read_image(content: bytes, engines: dict[str, Engine], provider: str | None = "auto") -> tuple[str, list[dict], Sequence[str]]:
    """(provider, lines, providers tried) from the first engine that is available; errors of an engine asked for by name are raised."""
    tried = []
    for name in provider_sequence(provider):
        tried.append(name)
        try:
            if name not in engines:
                raise ProviderUnavailable(f"{name} is not set up")
            return name, engines[name](content), tried
        except ProviderUnavailable:
            if provider_sequence(provider) == [name]:
                raise
    raise ProviderUnavailable("no OCR provider is available: " + ", ".join(tried))


def image_parser(engines: dict[str, Engine], provider: str | None = "auto") -> Callable[[bytes], object]:
    """A parser of images for parse_files(..., {"image": ...}): the first engine that is available reads the lines."""

    def parse(content: bytes) -> object:
        from .parsers import parse_ocr_lines

        name, lines, _ = read_image(content, engines, provider)
        return parse_ocr_lines(lines, name)

    return parse
