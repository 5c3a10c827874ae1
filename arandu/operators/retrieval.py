"""Search over records and chunks: filters, scores, top k, hybrid candidates, context and previews."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plain import tokens_plain
from ..functions.text import filled, path_text, position_text, snippet, squeeze, tokens
from ..functions.text import locator_path as path_of_locator
from ..functions.values import LEAST_COSINE, PREVIEW_STOPWORDS
from .scoring import CountedFacts, FoldedFacts, breakdown, lexical_score, lexical_terms, profile_name, rerank_parts, rerank_score, rerank_signals, terms_struct, with_lexical_inputs, without_lexical_inputs
from .vectors import cosine, embed, embed_plain, literal_vector

FILTERS = ("file_type", "archetype", "file_name")
#: Chunks that a filter names.
MOST_NAMED = 1_000


def matches(filters: Mapping[str, Any] | None) -> Column:
    """Equality, or membership for lists, of each filter that has a value."""
    tests = []
    for name, value in (filters or {}).items():
        if name not in FILTERS:
            continue
        values = [v for v in value if v not in (None, "")] if isinstance(value, (list, tuple, set, frozenset)) else [value]
        if values and value not in (None, ""):
            tests.append(F.col(name).isin(*values))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def cli_filters(archetype: str | None = None, file_name: str | None = None, file_type: str | None = None) -> dict[str, str]:
    return {k: v for k, v in (("archetype", archetype), ("file_name", file_name), ("file_type", file_type)) if v}


def search_records(records: DataFrame, query: str, filters: Mapping[str, Any] | None = None, limit: int = 10, profile: str = "legal") -> DataFrame:
    """The best records: score descending, then shorter texts, file and heading. One narrow stage and a top k."""
    text = F.coalesce(filled("text"), F.col("title"))
    path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ")
    words = tokens_plain(query)
    rows = with_lexical_inputs(records.where(matches(filters)), F.col("title"), path, text, F.col("file_name"), F.col("archetype"), words)
    return best_records(rows, query, limit, profile, CountedFacts(words))


def best_records(rows: DataFrame, query: str, limit: int, profile: str, facts: FoldedFacts | None = None) -> DataFrame:
    """search_records over rows that have what with_lexical_inputs gives, worked out or stored.

    Rows without a score are the last, and left out of the best: a filter before these would work out the score twice.
    """
    terms = lexical_terms(query, F.col("source_kind"), profile, facts)
    found = rows.withColumn("_terms", terms_struct(terms)).withColumn("score", lexical_score(F.col("_terms"), list(terms)))
    shown = F.coalesce(filled("heading"), F.col("title")) if "heading" in rows.columns else F.col("title")
    top = found.withColumn("heading", shown).orderBy(F.desc("score"), "_lex_length", "file_name", "heading", *(c for c in ("seq", "record_id") if c in rows.columns)).limit(limit).where("score > 0")
    text = F.coalesce(filled("text"), F.col("title"))
    return without_lexical_inputs(top.withColumns({"score_breakdown": breakdown(F.col("_terms"), list(terms)), "snippet": snippet(text, query)})).drop("_terms")


def hybrid_candidates(chunks: DataFrame, query: str, filters: Mapping[str, Any] | None = None, query_vector: list[float] | None = None, profile: str = "legal") -> DataFrame:
    """chunks with text_score and vector_score that pass: a text score, or a cosine of 0.12 or more."""
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    words = tokens_plain(query)
    terms = lexical_terms(query, F.lit("chunk"), profile, CountedFacts(words))
    vector = F.col("vector") if "vector" in chunks.columns else F.lit(None).cast("array<double>")
    near = cosine(vector, literal_vector(query_vector)) if query_vector else F.lit(0.0)
    length = F.coalesce(F.nullif("text_length", F.lit(0)), F.length(squeeze(F.coalesce("text", F.lit(""))))) if "text_length" in chunks.columns else F.length(squeeze(F.coalesce("text", F.lit(""))))
    rows = with_lexical_inputs(chunks.where(matches(filters)), F.col("heading"), F.array_join(path, " "), F.col("text"), F.col("file_name"), F.col("archetype"), words)
    rows = without_lexical_inputs(rows.withColumn("_terms", terms_struct(terms)))
    out = rows.withColumns({"text_score": lexical_score(F.col("_terms"), list(terms)).cast("double"), "vector_score": near, "has_embedding": vector.isNotNull(), "text_length": length})
    text = path_text("heading_path", "heading", "heading") if "heading_path_text" not in chunks.columns else F.coalesce(filled("heading_path_text"), F.array_join(path, " > "))
    out = out.where((F.col("text_score") > 0) | (F.col("vector_score") >= LEAST_COSINE))
    return out.withColumns({"heading_path_text": text, "text_score_breakdown": breakdown(F.col("_terms"), list(terms))}).drop("_terms")


def rerank(candidates: DataFrame, query: str, limit: int = 6, profile: str = "legal") -> DataFrame:
    """The best candidates by seven weighted signals; ties by text score, cosine, length, file and path."""
    kind = F.col("source_kind") if "source_kind" in candidates.columns else F.lit("chunk")
    signals = rerank_signals(query, F.col("text_score"), F.col("vector_score"), F.col("heading_path_text"), F.col("archetype"), kind, F.col("text"), F.col("text_length"), profile)
    parts = rerank_parts(signals, profile)
    out = candidates.withColumn("parts", F.struct(*(v.alias(k) for k, v in parts.items())))
    out = out.withColumn("score", rerank_score({k: F.col(f"parts.{k}") for k in parts})).withColumn("retrieval_mode", F.when(F.col("has_embedding"), "hybrid").otherwise("textual"))
    ties = [c for c in ("chunk_seq", "chunk_id") if c in candidates.columns][:1]
    return out.orderBy(F.desc("score"), F.desc("text_score"), F.desc("vector_score"), "text_length", "file_name", "heading_path_text", *ties).limit(limit)


def vector_size(chunks: DataFrame) -> int | None:
    """Length of the vectors of chunks, from the first one that has any."""
    row = chunks.where("vector is not null").select(F.size("vector").alias("n")).limit(1).collect()
    return row[0]["n"] if row else None


def search_chunks(chunks: DataFrame, query: str, filters: Mapping[str, Any] | None = None, limit: int = 6, profile: str = "legal") -> DataFrame:
    """Hybrid search: candidates, then rerank, with snippets."""
    size = vector_size(chunks) if "vector" in chunks.columns else None
    found = rerank(hybrid_candidates(chunks, query, filters, embed_plain(query, size) if size else None, profile), query, limit, profile)
    return found.withColumn("snippet", snippet("text", query, 260))


def context_lines(results: DataFrame) -> DataFrame:
    """results of a search (few rows) with rank and context: a numbered header and the text."""
    order = [F.desc("score"), F.desc("text_score"), F.desc("vector_score"), F.col("text_length"), F.col("file_name"), F.col("heading_path_text")]
    at = F.col("locator") if "locator" in results.columns else None
    place = [] if at is None else [path_of_locator(at), position_text(at["page"], at["sheet"], at["line_start"], at["line_end"])]
    place = F.coalesce(*([filled("locator_path")] if "locator_path" in results.columns else []), *place, F.lit(None).cast("string"))
    numbers = [F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in (("score", "score"), ("text", "text_score"), ("vector", "vector_score"))]
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    header = F.concat_ws(" | ", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("file_name"), F.lit(" ("), F.col("archetype"), F.lit(")")), filled("heading_path_text"), *numbers, F.col("retrieval_mode"), place)
    return ranked.withColumn("context", F.concat(header, F.lit("\n"), F.col("text")))


def preview_queries(chunks: DataFrame, limit: int = 3, seq: str = "chunk_seq") -> DataFrame:
    """seq, query: the first distinct queries of up to three words from headings, heading paths from their ends, and archetypes."""
    sources = F.concat(F.array(F.coalesce("heading", F.lit(""))), F.reverse(F.coalesce("heading_path", F.array().cast("array<string>"))), F.array(F.replace(F.coalesce("archetype", F.lit("")), F.lit("_"), F.lit(" "))))
    rows = chunks.select(seq, F.posexplode(sources).alias("n", "source"))
    words = F.filter(tokens("source"), lambda t: (F.length(t) >= 4) & ~t.isin(PREVIEW_STOPWORDS) & ~t.rlike(r"^\p{Nd}+$"))
    made = rows.select(F.struct(seq, "n").alias("at"), F.array_join(F.slice(words, 1, 3), " ").alias("query")).where("query <> ''")
    return made.groupBy("query").agg(F.min("at").alias("at")).orderBy("at").limit(limit).select("at", "query")


def preview(chunks: DataFrame, profile: str = "legal", per_query: int = 3) -> list[tuple[str, DataFrame]]:
    """Results of each preview query (three at most, each the best three chunks); "documento" if there is no query."""
    queries = [r["query"] for r in preview_queries(chunks).collect()] or ["documento"]
    return [(q, search_chunks(chunks, q, limit=per_query, profile=profile)) for q in queries]


def least_scores(rows: DataFrame, queries: int, limit: int) -> list[float]:
    """For each query the limit-th largest of its scores (an array, _scores) above 0; 0 if there are fewer. Scores are whole
    numbers within narrow bounds, so that they are counted by value."""
    counts = rows.select(F.posexplode("_scores").alias("n", "score")).where("score > 0").groupBy("n", "score").count().collect()
    least = []
    for n in range(queries):
        left, cut = limit, 0.0
        for score, count in sorted(((r["score"], r["count"]) for r in counts if r["n"] == n), reverse=True):
            left -= count
            if left <= 0:
                cut = score
                break
        least.append(cut)
    return least


def search_many(chunks: DataFrame, queries: list[str], limit: int = 3, profile: str = "legal", filters: Mapping[str, Any] | None = None, embed_size: int | None = None) -> DataFrame:
    """Results of several queries, known on the driver, over all of them at once: query, rank and the chunk's columns.

    Each chunk gets an array of its scores; an explode and a top k for each query follow. With embed_size, chunks have no
    vector but a context, which is embedded in that size only where the cosine can matter: as text scores come first, in
    chunks whose text score reaches a query's limit-th best. A scan finds these scores, and one more the chunks: few by
    their ids, many by their scores. A query that fewer chunks have a text score for asks for the cosines of all.
    """
    profile_name(profile)
    path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ")
    size = embed_size or (vector_size(chunks) if "vector" in chunks.columns else None)
    words = list(dict.fromkeys(w for q in queries for w in tokens_plain(q)))

    def scored(own: DataFrame) -> DataFrame:
        rows = with_lexical_inputs(own, F.col("heading"), path, F.col("text"), F.col("file_name"), F.col("archetype"), words)
        scores = []
        for i, q in enumerate(queries):
            terms = lexical_terms(q, F.lit("chunk"), profile, CountedFacts(words))
            rows = rows.withColumn(f"_terms{i}", terms_struct(terms))
            scores.append(lexical_score(F.col(f"_terms{i}"), list(terms)).cast("double"))
        return without_lexical_inputs(rows).withColumn("_scores", F.array(*scores)).drop(*(f"_terms{i}" for i in range(len(queries))))

    asked = chunks.where(matches(filters))
    rows, least = scored(asked), [0.0] * len(queries)
    if embed_size:
        found = rows.select("chunk_id", "_scores").persist(StorageLevel.DISK_ONLY)
        try:
            least = least_scores(found, len(queries), limit)
            reached = reduce(lambda a, b: a | b, [F.get("_scores", F.lit(i)) >= cut for i, cut in enumerate(least)], F.lit(False))
            ids = [r["chunk_id"] for r in found.where(reached).select("chunk_id").limit(MOST_NAMED + 1).collect()]
        finally:
            found.unpersist()
        if len(ids) <= MOST_NAMED and None not in ids:
            rows = scored(asked.where(F.col("chunk_id").isin(ids)))
        rows = rows.where(reached).withColumn("vector", embed("context", embed_size))
    near = [cosine(F.col("vector"), literal_vector(embed_plain(q, size))) if size else F.lit(0.0) for q in queries]
    hits = [F.struct(F.lit(i).alias("n"), F.lit(q).alias("query"), F.get("_scores", F.lit(i)).alias("text_score"), near[i].alias("vector_score"), F.lit(least[i]).alias("least")) for i, q in enumerate(queries)]
    own = rows.withColumn("_hit", F.explode(F.array(*hits))).drop("_scores")
    own = own.where((F.col("_hit.text_score") >= F.col("_hit.least")) & ((F.col("_hit.text_score") > 0) | (F.col("_hit.vector_score") >= LEAST_COSINE)))
    order = Window.partitionBy("n").orderBy(F.desc("text_score"), F.desc("vector_score"), F.length("text"), "chunk_id")
    return own.select("*", "_hit.*").drop("_hit", "least").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def block_filter(blocks: DataFrame, text: str = "", kind: str = "") -> DataFrame:
    """Blocks of a report whose kind is the given one and whose label, title, text or place contains the folded text."""
    from ..functions.plain import fold_plain
    from ..functions.text import fold, kind_label

    at = F.col("locator")
    haystack = fold(F.concat_ws(" ", kind_label("kind"), "title", "text", path_of_locator(at), position_text(at["page"], at["sheet"], at["line_start"], at["line_end"])))
    return blocks.where(F.lit(not kind) | (F.col("kind") == kind)).where(haystack.contains(fold_plain(text)))


def tree_filter(entries: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """Index entries that contain the folded text in their title or kind, and all their ancestors."""
    from ..functions.plain import fold_plain
    from ..functions.text import fold

    hits = entries.where(fold(F.concat_ws(" ", "title", "kind")).contains(fold_plain(text)))
    kept = hits.select(key, F.explode(F.array_append("ancestors", F.col("pos"))).alias("pos")).distinct()
    return entries.join(kept, [key, "pos"], "left_semi")


def resolve_reference(rows: DataFrame, wanted: str, keys: list[str], key: str = "doc_id") -> DataFrame:
    """For each document the first row that one of the keys names exactly, else the first that contains the name or is contained in it."""
    from ..functions.plain import fold_plain
    from ..functions.text import fold

    name = fold_plain(wanted)
    folded = [fold(k) for k in keys]
    exact = reduce(lambda a, b: a | b, [f == name for f in folded])
    near = reduce(lambda a, b: a | b, [(f != "") & (f.contains(name) | F.lit(name).contains(f)) for f in folded])
    hits = rows.withColumn("_rank", F.when(exact, 0).when(near, 1)).where("_rank is not null")
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank", "pos"))).where("_n = 1").drop("_n", "_rank")
