"""What is handed on of each document: metadata, content, index and AI context, as JSON and Markdown columns.

One row for each document; a document's blocks and entries are gathered in its row, nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PREVIEW_LIMIT, display_title, filled, locator_path, path_text, position_text, shortened, source_reference
from .catalog import OUTLINE, outline


def _gathered(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and an array of the value by pos."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias(name))


def _position() -> Column:
    at = F.col("locator")
    return position_text(at["page"], at["sheet"], at["line_start"], at["line_end"])


def content_items(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: the blocks with id, kind, titles, text, preview, path, place and reference."""
    block_id = F.format_string("block_%04d", "pos")
    shown, path, place = display_title("display_title", "title", "text", "pos"), locator_path(F.col("locator")), _position()
    value = F.struct(block_id.alias("block_id"), "pos", "kind", "title", shown.alias("display_title"), "text", shortened("text", PREVIEW_LIMIT).alias("preview"), "path", path.alias("locator_path"), place.alias("position"), source_reference(shown, "title", path, place, block_id).alias("reference"))
    return _gathered(blocks, key, value, "content")


def index_items(entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, index: the entries with id, parent, level, path and the anchor of their block."""
    from ..sinks.writers import anchors

    name = lambda c: F.format_string("idx_%04d", c)
    value = F.struct(name("pos").alias("entry_id"), F.when(F.col("parent_pos").isNotNull(), name("parent_pos")).alias("parent_id"), "kind", "title", "level", "path", F.array_join("path", " > ").alias("path_text"), "anchor")
    return _gathered(anchors(entries, blocks, key), key, value, "index")


def ai_context(blocks: DataFrame, key: str = "doc_id") -> Column:
    """A block under its heading path and place, as Markdown."""
    heading = path_text("path", "display_title", "title")
    return F.concat(F.lit("### "), heading, F.when(filled(_position()).isNotNull(), F.concat(F.lit("\n_"), _position(), F.lit("_"))).otherwise(""), F.lit("\n\n"), F.coalesce("text", F.lit("")))


def payloads(documents: DataFrame, blocks: DataFrame, entries: DataFrame, summaries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, metadata, content, index (JSON), ai_context and summary_markdown of every document, also of those without blocks.

    documents: key, file_name, file_type, archetype, and what else of domain, primary_structure, mode, source_path,
    file_size_bytes, modified_at they have.
    """
    content, index = content_items(blocks, key), index_items(entries, blocks, key)
    dump = _gathered(blocks, key, ai_context(blocks), "dump")
    rows = documents.join(summaries, key, "left").join(content, key, "left").join(index, key, "left").join(dump, key, "left").join(outline(entries, key, OUTLINE), key, "left")
    none = F.lit(0)
    known = [c for c in ("file_name", "file_type", "archetype", "domain", "primary_structure", "mode", "source_path", "file_size_bytes", "modified_at") if c in documents.columns]
    metadata = F.struct(*known, F.coalesce(F.size("content"), none).alias("block_count"), F.coalesce(F.size("index"), none).alias("index_entry_count"))
    title = F.concat(F.lit("# "), "file_name")
    about = F.concat_ws(" | ", F.concat(F.lit("Tipo: "), "file_type"), F.concat(F.lit("Arquétipo: "), "archetype"))
    index_part = F.when(filled("outline").isNotNull(), F.concat(F.lit("## Índice\n\n"), F.col("outline")))
    body = F.when(F.size("dump") > 0, F.concat(F.lit("## Conteúdo\n\n"), F.array_join("dump", "\n\n")))
    options = {"ignoreNullFields": "false"}
    return rows.select(
        key,
        F.to_json(metadata, options).alias("metadata"),
        F.to_json(F.coalesce("content", F.array()), options).alias("content"),
        F.to_json(F.coalesce("index", F.array()), options).alias("index"),
        F.concat_ws("\n\n", title, about, F.when(filled("summary").isNotNull(), F.concat(F.lit("## Resumo\n\n"), F.col("summary"))), index_part, body).alias("ai_context"),
        F.concat_ws("\n\n", title, F.col("summary")).alias("summary_markdown"),
    )
