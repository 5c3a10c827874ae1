"""Chunks of documents by archetype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, locator_path, position_text
from ..functions.values import ARCHETYPES
from .numbering import numbered
from .structure import future, heading_stack

GROUP = 3


def joined_text(positions_and_texts: Column) -> Column:
    """Trimmed texts in order of position, blank ones left out."""
    texts = F.filter(F.transform(F.array_sort(positions_and_texts), lambda x: F.trim(F.coalesce(x["text"], F.lit("")))), lambda t: t != "")
    return F.array_join(texts, "\n\n")


def _sizes(chunks: DataFrame) -> DataFrame:
    return chunks.where("text <> ''").withColumn("text_length", F.length("text")).withColumn("token_count", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")))


def in_groups(rows: Column | str, size: int = GROUP) -> Column:
    """An array's items in arrays of `size`, the last with the rest: what an explode of it copies is linear in the items."""
    own = F.col(rows) if isinstance(rows, str) else rows
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(own, at, size))


def generic_groups(blocks: DataFrame, key: str = "doc_id", size: int = GROUP) -> DataFrame:
    """Groups of three blocks with text, the rest kept: key, first_pos, positions, heading, heading_path, text, sizes."""
    own = blocks.where("trim(coalesce(text, '')) <> ''")
    own = own.withColumn("_group", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1) / size))
    first = F.min(F.struct("pos", F.coalesce(filled("display_title"), filled("title")).alias("heading"), "path", "locator"))
    out = own.groupBy(key, "_group").agg(first.alias("_first"), F.sort_array(F.collect_set("pos")).alias("positions"), joined_text(F.collect_list(F.struct("pos", "text"))).alias("text"))
    return _sizes(out.select(key, F.col("_first.pos").alias("first_pos"), "positions", F.col("_first.heading").alias("heading"), F.col("_first.path").alias("heading_path"), F.col("_first.locator").alias("locator"), F.lit("block_group").alias("kind"), F.lit(1).alias("level"), "text"))


def index_roots(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """The entries that chunks of legal texts begin at, with act_pos and act_title for articles quoted into another act.

    Normative: articles, else all. Amending: the articles below an act's article, else that article; without articles of
    the act, every article.
    """
    document = Window.partitionBy(key)
    article = F.col("kind") == "article"
    normative = entries.where(F.col("archetype") == ARCHETYPES[0]).withColumn("_some", F.bool_or(article).over(document)).where(article | ~F.col("_some")).drop("_some")
    acts = entries.where((F.col("archetype") == ARCHETYPES[1]) & article)
    top = acts.where("parent_pos is null").select(key, F.col("pos").alias("act_pos"), F.col("title").alias("act_title"))
    below = acts.withColumn("_above", F.explode("ancestors")).join(top, (acts[key] == top[key]) & (F.col("_above") == F.col("act_pos"))).drop(top[key]).drop("_above")
    alone = acts.where("parent_pos is null").join(below.select(F.col(key), F.col("act_pos").alias("pos")).distinct(), [key, "pos"], "left_anti")
    orphans = acts.join(top.select(key).distinct(), key, "left_anti")
    bare = normative.unionByName(alone.select(normative.columns)).unionByName(orphans.select(normative.columns))
    bare = bare.withColumns({"act_pos": F.lit(None).cast("int"), "act_title": F.lit(None).cast("string")})
    return bare.unionByName(below.select(bare.columns))


def index_chunks(entries: DataFrame, blocks: DataFrame, key: str = "doc_id", roots: DataFrame | None = None) -> DataFrame:
    """One chunk for each root: the texts of the root and of the entries below it.

    Each entry goes to itself and to its ancestors, which is linear in the depth, and only roots are kept.
    """
    roots = index_roots(entries, key) if roots is None else roots
    spread = entries.select(key, "pos", F.explode(F.array_append("ancestors", F.col("pos"))).alias("root_pos"))
    texts = spread.join(blocks.select(key, "pos", "text"), [key, "pos"])
    own = roots.select(F.col(key), F.col("pos").alias("root_pos"), F.col("title").alias("heading"), F.col("path").alias("heading_path"), "locator", "kind", "level", "act_pos", "act_title")
    out = own.join(texts, [key, "root_pos"]).groupBy(*own.columns).agg(F.sort_array(F.collect_set("pos")).alias("positions"), joined_text(F.collect_list(F.struct("pos", "text"))).alias("text"))
    return _sizes(out.withColumnRenamed("root_pos", "first_pos"))


def span_chunks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One chunk for each heading of generic documents: from it to the next heading of level 1.

    All roots are at level 1 of a flat index, so that the spans of deeper headings overlap.
    """
    closes = (F.col("kind") == "heading") & (F.col("heading_level") <= 1)
    own = blocks.withColumn("_section", F.count(F.when(closes, 1)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    title = F.coalesce(filled("index_title"), filled("display_title"), filled("title"), F.lit("Sem título"))
    roots = own.where("kind = 'heading'").select(key, "_section", F.col("pos").alias("first_pos"), title.alias("heading"), F.array(title).alias("heading_path"), "locator", F.lit("heading").alias("kind"), F.lit(1).alias("level"))
    texts = own.select(key, "_section", "pos", "text")
    spans = roots.join(texts, [key, "_section"]).where("pos >= first_pos")
    out = spans.groupBy(key, "first_pos", "heading", "heading_path", "locator", "kind", "level").agg(F.sort_array(F.collect_set("pos")).alias("positions"), joined_text(F.collect_list(F.struct("pos", "text"))).alias("text"))
    return _sizes(out)


def manual_chunks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One chunk for each paragraph of a manual but its overview, with the headings and the interface it stands under; then
    headings without paragraphs of their own and without headings below.

    part is 1 for paragraphs and 2 for headings; chunks are in order of part and position.
    """
    order = Window.partitionBy(key).orderBy("pos")
    past, later = order.rowsBetween(Window.unboundedPreceding, 0), future(key)
    own = heading_stack(blocks, key)
    group = F.coalesce(F.col("heading_group"), F.col("manual_group"), F.lit(""))
    body = F.coalesce(F.col("manual_group"), F.lit("body"))
    heading, level = F.col("kind") == "heading", F.coalesce(F.col("heading_level"), F.lit(1))
    shown = F.trim(F.coalesce(filled("display_title"), filled("title"), filled("text"), F.lit("")))
    interface = F.when(heading, group == "interface").otherwise((F.col("kind") == "paragraph") & (body == "interface_label"))
    own = own.withColumns(
        {
            "_at_interface": F.max(F.when(interface, F.struct("pos", shown.alias("title")))).over(past),
            "_at_heading": F.max(F.when(heading & (group != "interface"), F.col("pos"))).over(past),
            "_next": F.min(F.when(heading & (group != "interface"), F.struct("pos", level.alias("level")))).over(later)["level"],
            "_under": F.get("stack", F.size("stack") - 1)["pos"],
        }
    )
    titles = F.filter(F.transform("stack", lambda x: x["title"]), lambda t: t != "")
    fallback = F.array(F.coalesce(filled("display_title"), filled("title"), F.concat(F.lit("Bloco "), F.col("pos").cast("string"))))
    paragraphs = own.where((F.col("kind") == "paragraph") & (body != "overview")).withColumn("heading_path", F.when(F.size(titles) > 0, titles).otherwise(fallback))
    single = F.when(body.isin("interface_label", "list_item", "micro_action"), "paragraph").otherwise("heading")
    in_interface = F.when(F.col("_at_interface.pos") > F.coalesce("_at_heading", F.lit(0)), filled(F.col("_at_interface.title")))
    first = paragraphs.select(key, F.lit(1).alias("part"), F.col("pos").alias("first_pos"), F.element_at("heading_path", -1).alias("heading"), "heading_path", "locator", single.alias("kind"), F.size("heading_path").alias("level"), body.alias("manual_group"), in_interface.alias("interface_context"), F.array("pos").alias("positions"), F.trim("text").alias("text"))
    covered = paragraphs.where("_under is not null").select(F.col(key), F.col("_under").alias("pos")).distinct()
    leaf = heading & ~group.isin("interface", "document_title", "styled_heading") & ~F.coalesce(F.col("_next") > level, F.lit(False))
    bare = own.where(leaf).join(covered, [key, "pos"], "left_anti")
    second = bare.select(key, F.lit(2).alias("part"), F.col("pos").alias("first_pos"), shown.alias("heading"), titles.alias("heading_path"), "locator", "kind", level.alias("level"), F.coalesce(filled(group), F.lit("heading_only")).alias("manual_group"), F.lit(None).cast("string").alias("interface_context"), F.array("pos").alias("positions"), F.trim("text").alias("text"))
    return _sizes(first.unionByName(second))


def manual_roots(entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings that chunks of a manual without paragraphs begin at: from level 2, but no titles, and no level 2 with level 3 right below; else all."""
    headings = entries.where("kind = 'heading'").join(blocks.select(key, "pos", F.coalesce("heading_group", "manual_group").alias("group")), [key, "pos"], "left")
    children = headings.where("level = 3").select(F.col(key), F.col("parent_pos").alias("pos")).distinct().withColumn("split", F.lit(True))
    marked = headings.join(children, [key, "pos"], "left").withColumn("fine", (F.col("level") >= 2) & ~F.coalesce(F.col("group").isin("document_title", "interface"), F.lit(False)) & ~((F.col("level") == 2) & F.coalesce("split", F.lit(False))))
    marked = marked.withColumn("some", F.bool_or("fine").over(Window.partitionBy(key)))
    return marked.where("fine or not some").select(entries.columns)


def document_chunks(documents: DataFrame, entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of all documents (key, archetype): by devices, steps or headings as the archetype asks (a
    manual that gives no step by its headings from level 2), in groups of three
    blocks where that gives nothing. Chunks of a document with the same positions are one. blocks have a path column."""
    types = documents.select(key, "archetype")
    typed = blocks.join(types, key)
    common = [key, "part", "first_pos", "heading", "heading_path", "locator", "kind", "level", "positions", "text", "text_length", "token_count", "act_pos", "act_title", "manual_group", "interface_context"]

    def same(df: DataFrame) -> DataFrame:
        missing = {"part": "int", "act_pos": "int", "act_title": "string", "manual_group": "string", "interface_context": "string"}
        return df.withColumns({c: F.lit(1 if c == "part" else None).cast(t) for c, t in missing.items() if c not in df.columns}).select(common)

    plain = {"act_pos": F.lit(None).cast("int"), "act_title": F.lit(None).cast("string")}
    legal = index_chunks(entries.where(F.col("archetype").isin(ARCHETYPES[:2])), typed, key)
    manual = manual_chunks(typed.where(F.col("archetype") == ARCHETYPES[2]), key)
    generic = span_chunks(typed.where(F.col("archetype") == ARCHETYPES[-1]), key)
    others = entries.where(F.col("archetype").isin(ARCHETYPES[3:-1]) & (F.col("kind") == "heading"))
    single = index_chunks(others, typed, key, roots=others.withColumns(plain))
    headed = entries.where((F.col("archetype") == ARCHETYPES[2]) & (F.col("kind") == "heading")).join(manual.select(key).distinct(), key, "left_anti")
    fallback = index_chunks(headed, typed, key, roots=manual_roots(headed, typed, key).withColumns(plain))
    made = same(legal).unionByName(same(manual)).unionByName(same(fallback)).unionByName(same(generic)).unionByName(same(single))
    made = made.withColumn("_first", F.row_number().over(Window.partitionBy(key, "positions").orderBy("part", "first_pos"))).where("_first = 1").drop("_first")
    rest = generic_groups(typed.join(made.select(key).distinct(), key, "left_anti"), key)
    return made.unionByName(same(rest))


def with_chunk_ids(chunks: DataFrame, documents: DataFrame, key: str = "doc_id", order: str | None = None, before: int = 0) -> DataFrame:
    """chunks with chunk_seq and chunk_id, which count on over the collection in order of documents, after the number before.

    Chunks are numbered within their documents; a document's start is a sum over the documents before, taken on the small
    table of counts: partial sums of ranges of documents first, then within each range.
    """
    order = order or key
    own = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("part", "first_pos")) if "part" in chunks.columns else F.row_number().over(Window.partitionBy(key).orderBy("first_pos")))
    counts = documents.select(key, *({order} - {key})).join(chunks.groupBy(key).agg(F.count("*").alias("_count")), key)
    start = numbered(counts, [order, *({key} - {order})], "_start", "_count")
    out = own.join(start.select(key, "_start"), key).withColumn("chunk_seq", (F.col("_start") + F.col("_n") + before).cast("long"))
    return out.withColumn("chunk_id", F.format_string("chunk_%05d", "chunk_seq")).drop("_n", "_start")


def chunk_locations(chunks: DataFrame) -> DataFrame:
    """chunks with heading_path_text, position_text and locator_path (the first of legal path, position and heading path)."""
    at = F.col("locator")
    text = F.coalesce(filled(F.array_join("heading_path", " > ")), F.trim("heading"))
    where = position_text(at["page"], at["sheet"], at["line_start"], at["line_end"])
    return chunks.withColumns({"heading_path_text": text, "position_text": where, "locator_path": F.coalesce(locator_path(at), where, filled(text))})



