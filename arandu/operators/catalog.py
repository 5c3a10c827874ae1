"""Aggregates of documents and collections: counts, catalog, master index, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, has_letter_or_digit
from ..functions.values import ARCHETYPES, LEGAL_KINDS

TOP_TITLES, ROOTS, OUTLINE, PREVIEWS, PREVIEW_CHARS = 8, 6, 14, 5, 300
#: Files of a kind that a collection's summary names.
FILES_SHOWN = 200

# Devices in the plural, in summaries.
PLURALS = {"preamble": "preâmbulo(s)", "part": "parte(s)", "book": "livro(s)", "title": "título(s)", "chapter": "capítulo(s)", "section": "seção(ões)", "subsection": "subseção(ões)", "article": "artigo(s)", "legal_paragraph": "parágrafo(s)", "inciso": "inciso(s)", "alinea": "alínea(s)", "item": "item(ns)"}


def kind_counts(blocks: DataFrame, key: str = "doc_id", kind: str = "kind") -> DataFrame:
    """key and a map of the number of blocks of each kind, by kind."""
    counts = blocks.groupBy(key, kind).count()
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "count")))).alias("kind_counts"))


def kind_ranking(blocks: DataFrame, kind: str = "kind") -> DataFrame:
    """Kinds by falling number of blocks, then by name; a missing kind is unknown."""
    return blocks.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).count().orderBy(F.desc("count"), "kind")


def _times(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind))


def structure_counts(kinds: Column) -> Column:
    """map of the legal kinds that occur, outermost first."""
    counts = F.map_from_arrays(F.array(*map(F.lit, LEGAL_KINDS)), F.array(*(_times(kinds, w) for w in LEGAL_KINDS)))
    return F.map_filter(counts, lambda _, n: n > 0)


def table_stats(rows: DataFrame, key: str | list[str] = "doc_id", row: str = "row", cells: str = "cells") -> DataFrame:
    """row_count, non_empty_row_count, data_row_count (without the header, if the first row has text), column_count."""
    keys = [key] if isinstance(key, str) else key
    text = F.exists(F.coalesce(F.col(cells), F.array().cast("array<string>")), lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    header = F.coalesce(F.bool_or((F.col(row) == 1) & text), F.lit(False))
    n = F.count_if(text)
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count"), n.alias("non_empty_row_count"), F.greatest(n - header.cast("int"), F.lit(0)).alias("data_row_count"), F.coalesce(F.max(F.size(cells)), F.lit(0)).alias("column_count"))


def row_text(cells: Column) -> Column:
    """Cells that are not blank, joined."""
    from ..functions.text import squeeze

    return squeeze(F.array_join(F.filter(cells, lambda c: F.coalesce(F.trim(c) != "", F.lit(False))), " | "))


def catalog(documents: DataFrame, entries: DataFrame, blocks: DataFrame, key: str = "doc_id", top: int = TOP_TITLES) -> DataFrame:
    """One row for each document (key, seq, file_name, file_type, archetype): catalog_id, the first root titles, numbers of blocks and index entries."""
    n = blocks.groupBy(key).agg(F.count("*").alias("block_count"))
    roots = F.filter(F.array_sort(F.collect_list(F.when(F.col("parent_pos").isNull(), F.struct("pos", "title")))), lambda x: filled(x["title"]).isNotNull())
    index = entries.groupBy(key).agg(F.count("*").alias("index_entry_count"), F.transform(F.slice(roots, 1, top), lambda x: x["title"]).alias("top_index_titles"))
    out = documents.join(n, key, "left").join(index, key, "left")
    return out.select(*documents.columns, F.format_string("catalog_%04d", "seq").alias("catalog_id"), F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("index_entry_count", F.lit(0)).alias("index_entry_count"), F.coalesce("top_index_titles", F.array().cast("array<string>")).alias("top_index_titles"))


def collection_counts(rows: DataFrame) -> DataFrame:
    """One row from a catalog: file_count, total_block_count, counts by file type and archetype, normative and procedural files."""
    types = rows.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("file_type_counts"))
    kinds = rows.groupBy(F.coalesce("archetype", F.lit(ARCHETYPES[-1])).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("archetype_counts"))
    total = rows.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("block_count"), F.lit(0)).alias("total_block_count"))
    return total.join(F.broadcast(types), how="full").join(F.broadcast(kinds), how="full")


def files_of_types(rows: DataFrame, archetypes: list[str]) -> DataFrame:
    """file_name of the catalog's documents of some archetypes, in order."""
    return rows.where(F.col("archetype").isin(archetypes)).orderBy("seq").select("file_name")


def top_titles(titles: DataFrame, title: str = "title", seq: str = "seq", limit: int = 10) -> DataFrame:
    """The most frequent titles; ties by first appearance."""
    own = titles.where(filled(title).isNotNull())
    return own.groupBy(title).agg(F.count("*").alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").limit(limit)


def master_index(documents: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """A node for each document (key, seq, file_name, file_type, archetype) at level 1 and its entries one level deeper, under names of their own."""
    node = F.format_string("master_%04d", "seq")
    files = ["file_name", "file_type", "archetype"]
    roots = documents.select(F.col(key), F.lit(0).alias("pos"), node.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("kind"), F.col("file_name").alias("title"), F.lit(1).alias("level"), F.array("file_name").alias("path"), *files)
    name = lambda c: F.concat(node, F.lit("_"), F.format_string("idx_%04d", c))
    own = entries.drop("archetype").join(documents.select(key, "seq", *files), key)
    below = own.select(F.col(key), "pos", name("pos").alias("node_id"), F.when(F.col("parent_pos").isNull(), node).otherwise(name("parent_pos")).alias("parent_id"), "kind", "title", (F.coalesce("level", F.lit(1)) + 1).alias("level"), F.concat(F.array("file_name"), "path").alias("path"), *files)
    return roots.unionByName(below)


def outline(entries: DataFrame, key: str = "doc_id", limit: int = OUTLINE) -> DataFrame:
    """key and the first lines of the index, indented by depth."""
    line = F.concat(F.repeat(F.lit("  "), F.size("ancestors")), F.lit("- ["), F.coalesce("kind", F.lit("None")), F.lit("] "), F.col("title"))
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= limit).withColumn("_line", line)
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias("outline"))


def block_previews(blocks: DataFrame, key: str = "doc_id", limit: int = PREVIEWS) -> DataFrame:
    """key and the first texts with a letter or digit, cut at 300 characters, tables last."""
    own = blocks.withColumn("_text", F.trim(F.coalesce("text", F.lit("")))).where(has_letter_or_digit("_text"))
    order = Window.partitionBy(key).orderBy((F.coalesce("kind", F.lit("")) == "table").cast("int"), "pos")
    first = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("_text", 1, PREVIEW_CHARS).alias("t")))), lambda x: x["t"]).alias("previews"))


def document_summaries(documents: DataFrame, entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, summary: file, archetype, devices, index and previews in words."""
    kinds = blocks.groupBy(key).agg(F.count("*").alias("n_blocks"), F.collect_list("kind").alias("kinds"))
    roots = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("parent_pos").isNull(), F.struct("pos", "title")))), lambda x: x["title"]), 1, ROOTS)
    index = entries.groupBy(key).agg(F.count("*").alias("n_entries"), roots.alias("roots"))
    rows = documents.join(kinds, key, "left").join(index, key, "left").join(outline(entries, key), key, "left").join(block_previews(blocks, key), key, "left")
    devices = F.concat_ws(", ", *(F.when(_times(F.col("kinds"), w) > 0, F.concat(_times(F.col("kinds"), w).cast("string"), F.lit(" " + PLURALS[w]))) for w in LEGAL_KINDS))
    previews = F.array_join("previews", "\n\n")
    parts = [
        F.concat(F.lit("Arquivo `"), "file_name", F.lit("` do tipo `"), F.col("file_type"), F.lit("` com "), F.coalesce("n_blocks", F.lit(0)).cast("string"), F.lit(" bloco(s) extraído(s).")),
        F.concat(F.lit("Arquétipo documental: `"), F.coalesce("archetype", F.lit("unknown")), F.lit("`.")),
        F.when(devices != "", F.concat(F.lit("Estrutura identificada: "), devices, F.lit("."))),
        F.when(F.col("n_entries") > 0, F.concat(F.lit("Índice hierárquico com "), F.col("n_entries").cast("string"), F.lit(" entrada(s) navegáveis."))),
        F.when(F.size("roots") > 0, F.concat(F.lit("Entradas de alto nível: "), F.array_join("roots", " | "), F.lit("."))),
        F.when(filled("outline").isNotNull(), F.concat(F.lit("Primeiros itens do índice:\n\n"), F.col("outline"))),
        F.when(F.size("previews") > 0, F.concat(F.lit("Prévia de conteúdo:\n\n"), previews)).otherwise("Não foi possível extrair conteúdo textual relevante."),
    ]
    return rows.select(key, F.concat_ws("\n\n", *parts).alias("summary"))


def collection_summary(name: str, counts: DataFrame, titles: DataFrame, rows: DataFrame, entry_count: int) -> str:
    """Prose about a collection from its counts, top titles and catalog; reads only their first rows, FILES_SHOWN of a
    kind of files at most, and says how many more there are (files_of_types has them all)."""
    c = counts.first()
    named = lambda label, values, joint=", ": [f"{label}: {joint.join(values)}."] if values else []

    def files(kinds: list[str]) -> list[str]:
        own = files_of_types(rows, kinds)
        first = [r["file_name"] for r in own.limit(FILES_SHOWN).collect()]
        more = own.count() - FILES_SHOWN if len(first) == FILES_SHOWN else 0
        return [*first, f"e mais {more}"] if more else first

    out = [f"Coleção `{name}` com {c['file_count']} arquivo(s) processado(s).", f"Total de blocos extraídos: {c['total_block_count']}. Entradas no índice mestre: {entry_count}."]
    out += named("Arquivos por tipo", [f"{k}: {n}" for k, n in (c["file_type_counts"] or {}).items()])
    out += named("Arquivos por arquétipo", [f"{k}: {n}" for k, n in (c["archetype_counts"] or {}).items()])
    out += named("Principais títulos encontrados", [r["title"] for r in titles.collect()], " | ")
    out += named("Arquivos com estrutura normativa", files(ARCHETYPES[:2]))
    out += named("Arquivos com estrutura procedural", files(ARCHETYPES[2:3]))
    first = [r["file_name"] for r in rows.orderBy("seq").limit(10).collect()]
    return "\n\n".join(out + named("Arquivos do catálogo", first, " | ") + named("Primeiras raízes do índice mestre", first, " | "))


def batch_counters(events: DataFrame, batch: str = "batch", outcome: str = "outcome") -> DataFrame:
    """Numbers of copied, generated, converted and preserved files and of warnings of each batch."""
    names = ("copied", "generated", "converted", "preserved", "warning")
    return events.groupBy(batch).agg(*(F.count_if(F.col(outcome) == n).alias(f"{n}_count") for n in names))
