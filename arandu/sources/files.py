"""Files of a folder as rows: scan, ignore, route by suffix, parse each file in isolation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, file_stem, file_suffix
from ..functions.values import IGNORED_NAMES, PARSERS
from ..operators.blocks import BLOCK_TYPE
from .parsers import PARSERS as FUNCTIONS
from .parsers import Parsed

PARSED_TYPE = f"struct<status: string, error: string, mode: string, root_tag: string, transaction_count: int, stats: map<string, string>, blocks: array<{BLOCK_TYPE}>>"


#: Files and blocks after which a worker hands on what it has parsed, whatever the length of the batch it was given.
HELD_BLOCKS = 2_000


def is_ignored(path: Column) -> Column:
    return F.lower(file_name(path)).isin(IGNORED_NAMES)


def parser_of(path: Column) -> Column:
    """Name of the parser for a path's suffix; null if there is none."""
    known = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])
    return F.try_element_at(known, file_suffix(path))


def only_ignored(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: only_ignored is true for at least one file, all of them ignored."""
    return files.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(is_ignored(F.col(path))), F.lit(False)).alias("all")).select((F.col("some") & F.col("all")).alias("only_ignored"))


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files that are not ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(~is_ignored(F.col("path")))


def file_metadata(files: DataFrame) -> DataFrame:
    """file_name, file_stem, file_type, file_size_bytes, modified_at (ISO, session time zone) and source_path; files keep their content."""
    path = F.col("path")
    return files.select(
        file_name(path).alias("file_name"),
        file_stem(path).alias("file_stem"),
        file_suffix(path).alias("file_type"),
        F.col("length").alias("file_size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"),
        path.alias("source_path"),
        "content",
    )


def _row(parsed: Parsed) -> dict:
    return {"status": "ok", "error": None, "mode": parsed.mode, "root_tag": parsed.root_tag, "transaction_count": parsed.transactions, "stats": {k: str(v) for k, v in parsed.stats.items()}, "blocks": parsed.blocks}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["status", "error", "mode", "root_tag", "transaction_count", "stats", "blocks"]).astype({"transaction_count": "Int32"})


def in_pieces(rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Rows of PARSED_TYPE in frames of about HELD_BLOCKS files and blocks."""
    own, held = [], 0
    for row in rows:
        own.append(row)
        held += 1 + len(row["blocks"])
        if held >= HELD_BLOCKS:
            yield _frame(own)
            own, held = [], 0
    if own:
        yield _frame(own)


def parse_column(content: Column, parser: Column, more: dict[str, Callable[[bytes], Parsed]] | None = None) -> Column:
    """PARSED_TYPE of a file's bytes. An unknown suffix is "skipped", a parser's error "failed"; other files go on.

    more: parsers by name, over the built-in ones; for images an OCR engine's.
    """
    functions = FUNCTIONS | (more or {})

    def one(data: bytes, name: str | None) -> dict:
        empty = {"mode": None, "root_tag": None, "transaction_count": None, "stats": {}, "blocks": []}
        if name not in functions:
            return {"status": "skipped", "error": "no parser for this suffix", **empty}
        try:
            return _row(functions[name](bytes(data)))
        except Exception as e:  # noqa: BLE001  one file's fault is a value of its row
            return {"status": "failed", "error": f"{type(e).__name__}: {e}", **empty}

    @F.pandas_udf(PARSED_TYPE)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from in_pieces((one(data, name) for contents, names in batches for data, name in zip(contents, names, strict=True)))

    return parse(content, parser)


def parse_files(files: DataFrame, more: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """Documents: file metadata, status, error, mode, root_tag, transaction_count, stats and blocks."""
    rows = file_metadata(files).withColumn("parsed", parse_column(F.col("content"), parser_of(F.col("source_path")), more)).drop("content")
    return rows.select("*", "parsed.*").drop("parsed")


def outcomes(documents: DataFrame) -> DataFrame:
    """Numbers of files by status."""
    return documents.groupBy("status").count()


def blocks_of(documents: DataFrame, *keys: str) -> DataFrame:
    """One row for each block, with the keys of its document."""
    return documents.select(*keys, F.explode("blocks").alias("block")).select(*keys, "block.*")
