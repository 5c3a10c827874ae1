"""Hierarchy of blocks as adjacency lists, by windows over a document's blocks in order: no nested trees, no recursion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOCATOR_KEYS, entry_title, filled
from ..functions.values import ARCHETYPES, EMBEDDED_LEVELS, HEADING_KINDS, NORMATIVE_LEVELS
from .scoring import lookup

#: Levels that an index can have.
LEVELS = range(1, 20)


def _past(key: str | list[str], order: str = "pos", own: bool = False):
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def future(key: str | list[str], order: str = "pos"):
    """The rows after the own one. In the reversed order they come before it: such a frame grows row by row, while one
    that reaches from the own row to the end is worked out anew for each row."""
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _greatest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def parents(rows: DataFrame, key: str | list[str] = "doc_id", level: str = "level", title: str = "title", levels=LEVELS) -> DataFrame:
    """rows (key, pos, level, title) with parent_pos, ancestors (positions, outermost first), path (titles, the own last)
    and last_pos (of the last descendant).

    The parent is the nearest row before with a smaller level. One shuffle by key serves all windows, and a sort by
    position in either direction.
    """
    past, later = _past(key), future(key)
    seen = F.array(*(F.max(F.when(F.col(level) == k, F.struct("pos", F.coalesce(filled(title), F.lit("Sem título")).alias("title")))).over(past) for k in levels))
    before = F.lag("pos").over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("pos"))
    ends = F.array(*(F.min(F.when(F.col(level) == k, F.struct("pos", "_before"))).over(later) for k in levels))
    out = rows.withColumn("_before", before).withColumn("_seen", seen).withColumn("_ends", ends).withColumn("_count", F.max("pos").over(Window.partitionBy(*([key] if isinstance(key, str) else key))))
    above = F.filter(F.slice("_seen", 1, F.greatest(F.col(level) - levels[0], F.lit(0))), lambda x: x.isNotNull())
    #: Of those, the ones that no later row of a smaller level has closed.
    stack = F.filter(above, lambda x, i: ~F.exists(F.slice(above, 1, i), lambda y: y["pos"] > x["pos"]))
    end = F.array_min(F.slice("_ends", 1, F.col(level) - levels[0] + 1))
    out = out.withColumn("_stack", stack)
    return out.select(
        *rows.columns,
        F.get(F.col("_stack"), F.size("_stack") - 1)["pos"].alias("parent_pos"),
        F.transform("_stack", lambda x: x["pos"]).alias("ancestors"),
        F.concat(F.transform("_stack", lambda x: x["title"]), F.array(F.coalesce(filled(title), F.lit("Sem título")))).alias("path"),
        F.coalesce(end["_before"], F.col("_count")).alias("last_pos"),
    )


def structural_context(rows: DataFrame, key: str = "doc_id", locator_key: str = "locator_key", title: str = "title") -> DataFrame:
    """rows (key, pos, locator_key, title) with context: a struct with the device that the row stands in for each locator key.

    A device holds until one of its own or of an outer kind comes.
    """
    window = _past(key, own=True)
    at = {k: F.max(F.when((F.col(locator_key) == k) & filled(title).isNotNull(), F.struct("pos", F.col(title).alias("title")))).over(window) for k in LOCATOR_KEYS}
    out = rows.withColumn("_at", F.struct(*(at[k].alias(k) for k in LOCATOR_KEYS)))
    values, outer = [], F.lit(-1)
    for k in LOCATOR_KEYS:
        own = F.col(f"_at.{k}")
        values.append(F.when(own["pos"] > outer, own["title"]).alias(k))
        outer = F.greatest(outer, F.coalesce(own["pos"], F.lit(-1)))
    return out.select(*rows.columns, F.struct(*values).alias("context"))


def heading_stack(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with stack: array of (level, pos, title, group) of the headings that a block stands under, its own included.

    A heading closes those of its level and deeper; interface headings close them too, but are not put on the stack.
    """
    window = _past(key, own=True)
    group = F.coalesce(F.col("heading_group"), F.col("manual_group"), F.lit(""))
    heading, level = F.col("kind") == "heading", F.coalesce(F.col("heading_level"), F.lit(1))
    title = F.trim(F.coalesce(filled("display_title"), filled("title"), F.lit("")))
    pushed = heading & (group != "interface") & (title != "")
    last = F.array(*(F.max(F.when(pushed & (level == k), F.struct(F.col("pos"), level.alias("level"), title.alias("title"), group.alias("group")))).over(window) for k in LEVELS))
    closed = F.array(*(F.max(F.when(heading & (level == k), F.col("pos"))).over(window) for k in LEVELS))
    out = blocks.withColumn("_last", last).withColumn("_closed", closed)
    stack = F.filter("_last", lambda x, i: x.isNotNull() & ~F.coalesce(F.exists(F.slice("_closed", 1, i + 1), lambda p: p > x["pos"]), F.lit(False)))
    return out.withColumn("stack", stack).drop("_last", "_closed")


def block_paths(blocks: DataFrame, key: str = "doc_id", hierarchy: Column | None = None) -> DataFrame:
    """blocks with path: a heading's stack; else its place in the legal structure, the stack above it, or its own title."""
    own = hierarchy if hierarchy is not None else F.array_compact(F.array(*(filled(F.col("locator")[k]) for k in LOCATOR_KEYS)))
    titles = F.transform("stack", lambda x: x["title"])
    shown = F.array(F.trim(F.coalesce(filled("display_title"), filled("title"), F.concat(F.lit("Bloco "), F.col("pos").cast("string")))))
    path = F.when(F.col("kind") == "heading", titles).when(F.size(own) > 0, own).when(F.size("stack") > 0, titles).otherwise(shown)
    return heading_stack(blocks, key).withColumn("path", F.filter(path, lambda x: x != ""))


#: Acts whose blocks a worker holds as Python values at once.
ACTS_AT_ONCE = 64

#: States of an amending act's reader: outside a change, under an article that announces one, inside the changed text;
#: (state, event) -> (whether the block is of the changed act, next state).
_PLAIN, _ANNOUNCED, _INSIDE = "plain", "announced", "inside"
_STEPS = {
    (_PLAIN, "announcing"): (False, _ANNOUNCED),
    (_ANNOUNCED, "quoted"): (True, _INSIDE),
    (_ANNOUNCED, "scope"): (True, _INSIDE),
    (_ANNOUNCED, "elsewhere"): (True, _ANNOUNCED),
    (_INSIDE, "quoted"): (True, _INSIDE),
    (_INSIDE, "scope"): (True, _INSIDE),
    (_INSIDE, "elsewhere"): (True, _INSIDE),
    (_INSIDE, "device"): (True, _INSIDE),
    **{(s, "reset"): (False, _PLAIN) for s in (_PLAIN, _ANNOUNCED, _INSIDE)},
    **{(s, "opening"): (False, _ANNOUNCED) for s in (_PLAIN, _ANNOUNCED, _INSIDE)},
    **{(s, "closing"): (False, _PLAIN) for s in (_PLAIN, _ANNOUNCED, _INSIDE)},
}
_ARTICLE_NUMBER = re.compile(r"Art\.\s*(\d+)", re.IGNORECASE)


def _event(b: dict, state: str, title: str | None, number: int | None) -> str:
    """What a block does to the reader, under the act's article of that title and number."""
    from .lines import amends

    opens = bool(b["amendment_context"]) or amends(b["text"] or "")
    if b["kind"] == "preamble":
        return "reset"
    if b["kind"] == "article":
        own = _article_number(b)
        leaps = own is not None and number is not None and own > number + 1
        if state != _PLAIN and (b["starts_with_quote"] or leaps):
            return "quoted"
        return "opening" if opens else "closing"
    if b["kind"] in HEADING_KINDS:
        return "reset" if state == _PLAIN else "scope" if title else "device"
    if state == _PLAIN:
        return "announcing" if title and opens else "device"
    return "elsewhere" if title and b["article"] and b["article"] != title else "device"


def _article_number(b: dict) -> int | None:
    found = _ARTICLE_NUMBER.search(b["title"] or b["text"] or "")
    return int(found[1]) if found else None


def _amending_levels(blocks: list[dict]) -> list[int | None]:
    """Level of each block of an amending act; devices of the changed act lie under the article that changes it."""
    state, title, number, out = _PLAIN, None, None, []
    for b in blocks:
        if b["kind"] not in NORMATIVE_LEVELS:
            out.append(None)
            continue
        event = _event(b, state, title, number)
        changed, state = _STEPS.get((state, event), (False, state))
        if event == "reset":
            title = number = None
        elif event in ("opening", "closing"):
            title, number = b["title"], _article_number(b)
        levels = EMBEDDED_LEVELS if changed else NORMATIVE_LEVELS
        out.append(levels.get(b["kind"], NORMATIVE_LEVELS[b["kind"]]))
    return out


def amending_levels(blocks: Column) -> Column:
    """array<int> of levels for an array of blocks in order."""

    @F.arrow_udf("array<int>")
    def levels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            for i in range(0, len(rows), ACTS_AT_ONCE):
                yield pa.array([None if r is None else _amending_levels(r) for r in rows.slice(i, ACTS_AT_ONCE).to_pylist()], pa.list_(pa.int32()))

    fields = ("kind", "title", "text", "amendment_context", "starts_with_quote")
    return levels(F.transform(blocks, lambda b: F.struct(*(b[f].alias(f) for f in fields), b["locator"]["article"].alias("article"))))


def index_entries(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Index of documents (key, archetype, blocks): key, archetype, pos, kind, title, level, parent_pos, ancestors, path, last_pos, locator.

    Legal texts are indexed by device, manuals by heading, others block by block at level 1; so are texts without devices
    or headings. A preamble is a root that nothing lies under.
    """
    docs = documents.select(key, "archetype", "blocks", amending_levels(F.when(F.col("archetype") == ARCHETYPES[1], F.col("blocks"))).alias("levels"))  # only these reach Python
    rows = docs.select(key, "archetype", F.posexplode("blocks").alias("i", "block"), "levels")
    kind, level = F.col("block.kind"), F.coalesce(F.col("block.heading_level"), F.lit(1))
    by_type = (
        F.when(F.col("archetype") == ARCHETYPES[0], lookup(NORMATIVE_LEVELS, kind, 0))
        .when(F.col("archetype") == ARCHETYPES[1], F.coalesce(F.get("levels", F.col("i")), F.lit(0)))
        .when(F.col("archetype") == ARCHETYPES[2], F.when(kind == "heading", F.greatest(F.lit(1), F.least(level, F.lit(6)))).otherwise(0))
        .otherwise(1)
    )
    rows = rows.withColumn("level", by_type).withColumn("any", F.max("level").over(Window.partitionBy(key)) > 0)
    rows = rows.where("level > 0 or not any").select(
        key,
        "archetype",
        "block.pos",
        kind.alias("kind"),
        entry_title("block.index_title", "block.display_title", "block.title", "block.text", "block.pos").alias("title"),
        F.when(F.col("any"), F.col("level")).otherwise(1).alias("level"),
        "block.locator",
    )
    roots = rows.where("kind = 'preamble'")
    nested = parents(rows.where("kind is null or kind <> 'preamble'"), key)
    none = roots.select(*rows.columns, F.lit(None).cast("int").alias("parent_pos"), F.array().cast("array<int>").alias("ancestors"), F.array("title").alias("path"), F.col("pos").alias("last_pos"))
    return nested.unionByName(none)


def descendant_counts(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, descendants of each entry: the entries that name it as an ancestor."""
    below = entries.select(key, F.explode("ancestors").alias("pos")).groupBy(key, "pos").agg(F.count("*").alias("descendants"))
    return entries.select(key, "pos").join(below, [key, "pos"], "left").select(key, "pos", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def entries_with_blocks(entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Index entries with their block's columns, prefixed block_; entries without a block keep nulls."""
    own = blocks.select(F.col(key), F.col("pos"), *(F.col(c).alias(f"block_{c}") for c in blocks.columns if c not in (key, "pos")))
    return entries.join(own, [key, "pos"], "left")
