"""Lexical scores and reranking as column expressions: the query is known on the driver, so that its words become literals
and a search is one narrow stage of generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legal import match_counts, primary_reference, references, references_plain
from ..functions.plain import fold_plain, tokens_plain
from ..functions.text import fold, once, squeeze
from ..functions.values import ARCHETYPE_BONUS, ARCHETYPES, FULL_TEXT_SCORE, OTHER_BONUS, RERANK_WEIGHTS, SOURCE_BOOST, SOURCE_PRIORITY

PROFILES = ("legal", "generic")


def profile_name(profile: str | None) -> str:
    """A known ranking profile; the default is legal."""
    name = str(profile or "legal").strip().lower()
    if name not in PROFILES:
        raise ValueError(f"unsupported ranking profile {profile!r}: use one of {', '.join(PROFILES)}")
    return name


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def occurrences(folded: Column, word: str) -> Column:
    """Whole-word occurrences; if there are none, occurrences anywhere."""
    # The word comes first in the pattern: a search for fixed letters is much cheaper than one that looks behind at each.
    own = re.escape(word)
    whole = F.regexp_count(folded, F.lit(rf"{own}(?<![\p{{L}}\p{{N}}_]{own})(?![\p{{L}}\p{{N}}_])"))
    anywhere = ((F.length(folded) - F.length(F.replace(folded, F.lit(word), F.lit("")))) / len(word)).cast("int")
    return F.when(folded.contains(word), once(whole, lambda n: F.when(n > 0, n).otherwise(anywhere))).otherwise(0)


def with_lexical_inputs(df: DataFrame, title: Column, heading: Column, text: Column, file_name: Column, archetype: Column, words: Sequence[str] = ()) -> DataFrame:
    """df with what lexical_terms reads, worked out once for each row: folded texts, references and the text's length.

    heading: the path's parts joined by a blank. words: those whose occurrences in the text are counted here
    (CountedFacts reads them), beside the folding, which Spark does not repeat in each term and filter that asks for it.
    """
    own = {f"_lex_{k}": fold(c) for k, c in (("title", title), ("heading", heading), ("body", text), ("file", file_name), ("archetype", archetype))}
    if words:
        own["_lex_counted"] = once(fold(text), lambda f: F.struct(f.alias("body"), F.array(*(occurrences(f, w) for w in words)).alias("counts")))
        own.pop("_lex_body")
    refs = {f"_ref_{k}": references(c) for k, c in (("title", title), ("heading", heading), ("body", text))}
    more = {"_ref_primary": primary_reference(title), "_lex_length": F.length(squeeze(F.coalesce(text, F.lit("")))), "_lex_type": archetype}
    out = df.withColumns(own | refs | more)
    return out.withColumns({"_lex_body": F.col("_lex_counted.body"), "_lex_counts": F.col("_lex_counted.counts")}).drop("_lex_counted") if words else out


def without_lexical_inputs(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(("_lex_", "_ref_"))))


class FoldedFacts:
    """What the score asks of a row, from the columns of with_lexical_inputs."""

    fields = ("title", "heading", "body", "file", "archetype")

    def has(self, field: str, word: str) -> Column:
        return F.col(f"_lex_{field}").contains(word).cast("int")

    def phrase(self, field: str, whole: str) -> Column:
        return self.has(field, whole)

    def count(self, word: str) -> Column:
        return occurrences(F.col("_lex_body"), word)

    def has_reference(self, field: str, reference: str) -> Column:
        """Whether a field has a reference, or ("primary") the title begins with it."""
        return F.col("_ref_primary").eqNullSafe(reference) if field == "primary" else F.array_contains(F.col(f"_ref_{field}"), reference)

    def length(self) -> Column:
        return F.col("_lex_length")

    def archetype(self) -> Column:
        return F.col("_lex_type")


class CountedFacts(FoldedFacts):
    """The same where with_lexical_inputs has counted the words."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)

    def count(self, word: str) -> Column:
        return F.get(F.col("_lex_counts"), F.lit(self.words.index(word)))


def lexical_terms(query: str, source_kind: Column, profile: str = "legal", facts: FoldedFacts | None = None) -> dict[str, Column]:
    """The terms of the score over with_lexical_inputs (or other facts), each an int column that is 0 where it does not apply."""
    profile, whole, words, facts = profile_name(profile), fold_plain(query), tokens_plain(query), facts or FoldedFacts()
    if not whole:
        return {}
    hits = {k: _sum([facts.has(k, w) for w in words]) for k in facts.fields}
    phrase = {k: facts.phrase(k, whole) for k in ("title", "heading", "body", "file")}
    counts = [facts.count(w) for w in words]
    terms = {
        "title_phrase": phrase["title"] * 12,
        "heading_phrase": phrase["heading"] * F.when(phrase["title"] == 1, 4).otherwise(10),
        "body_phrase": phrase["body"] * 4,
        "file_name_phrase": phrase["file"] * 5,
        "title_tokens": hits["title"] * 6,
        "heading_tokens": hits["heading"] * 5,
        "body_tokens": F.least(_sum([F.least(n, F.lit(3)) for n in counts]), F.lit(3 * max(len(words), 1))) * 2,
        "file_name_tokens": hits["file"] * 3,
        "archetype_tokens": hits["archetype"] * 2,
    }
    asked = references_plain(query)
    if profile == "legal" and asked:
        for name, exact_score, partial_score in (("title", 26, -14), ("heading", 24, -12), ("body", 8, -4)):
            exact, partial = match_counts(asked, lambda r, name=name: facts.has_reference(name, r))
            terms[f"legal_ref_{name}_exact"] = exact * exact_score
            terms[f"legal_ref_{name}_partial_penalty"] = partial * partial_score
        exact, partial = match_counts(asked, lambda r: facts.has_reference("primary", r))
        terms["legal_ref_primary_title_exact"] = exact * 42
        terms["legal_ref_primary_title_partial_penalty"] = partial * -20
    hit = (hits["title"] + hits["heading"] + hits["body"] + hits["file"] + phrase["body"]) > 0
    terms["source_kind"] = F.when(hit, lookup(SOURCE_BOOST, source_kind, 0)).otherwise(0)
    if profile == "legal":
        terms["archetype_specificity"] = facts.archetype().isin(ARCHETYPES[:-1]).cast("int")
    n = facts.length()
    terms["length_fit"] = n.between(80, 900).cast("int") * 2
    terms["length_penalty"] = F.when((n > 0) & (n < 40), -1).when(n > 2200, -4).when(n > 1400, -2).otherwise(0)
    terms["repetition_penalty"] = -F.least(_sum([F.greatest(k - 6, F.lit(0)) for k in counts]), F.lit(6))
    return {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in terms.items()}


def terms_struct(terms: dict[str, Column]) -> Column:
    return F.struct(*(v.alias(k) for k, v in terms.items())) if terms else F.struct(F.lit(0).alias("none"))


def lexical_score(terms: Column, names: list[str]) -> Column:
    """The sum of the terms of a struct; 0 without a positive term or if the sum is not positive."""
    if not names:
        return F.lit(0)
    total = _sum([terms[k] for k in names])
    positive = reduce(lambda a, b: a | b, [terms[k] > 0 for k in names])
    return F.when(positive & (total > 0), total).otherwise(0)


def breakdown(terms: Column, names: list[str]) -> Column:
    """map of the terms that are not 0."""
    if not names:
        return F.create_map().cast("map<string,int>")
    return F.map_filter(F.create_map(*[x for k in names for x in (F.lit(k), terms[k])]), lambda _, v: v != 0)


def _share(query: str, folded: Column) -> Column:
    words = tokens_plain(query)
    return _sum([folded.contains(w).cast("int") for w in words]) / max(len(words), 1) if words else F.lit(0.0)


def rerank_signals(query: str, text_score: Column, vector_score: Column, path: Column, archetype: Column, source_kind: Column, text: Column, text_length: Column, profile: str = "legal") -> dict[str, Column]:
    """Signals between 0 and 1. path: the heading path as text."""
    profile, whole = profile_name(profile), fold_plain(query)
    archetype, path = F.coalesce(archetype, F.lit("")), F.coalesce(path, F.lit(""))
    folded_type = F.replace(fold(archetype), F.lit("_"), F.lit(" "))
    clamp = lambda c: F.greatest(F.least(c.cast("double"), F.lit(1.0)), F.lit(0.0))
    signals = {
        "textual": clamp(text_score / FULL_TEXT_SCORE),
        "vector": clamp(vector_score),
        "legal_reference": F.lit(0.0),
        "heading": once(fold(path), lambda p: F.when(p == "", 0.0).when(F.lit(bool(whole)) & p.contains(whole), 1.0).otherwise(clamp(_share(query, p)))),
        "document_archetype": once(folded_type, lambda t: F.when(t == "", 0.0).otherwise(clamp(lookup(ARCHETYPE_BONUS[profile], archetype, OTHER_BONUS[profile]) + _share(query, t) * 0.4))),
        "source_kind": lookup(SOURCE_PRIORITY, F.coalesce(source_kind, F.lit("chunk")), 1) / max(SOURCE_PRIORITY.values()),
        "chunk_size": F.when(text_length <= 0, 0.0)
        .when(text_length.between(80, 900), 1.0)
        .when(text_length.between(40, 79) | text_length.between(901, 1500), 0.75)
        .when(text_length.between(20, 39) | text_length.between(1501, 2200), 0.45)
        .otherwise(0.2),
    }
    asked = references_plain(query)
    if profile == "legal" and asked:
        primary = primary_reference(F.element_at(F.split(path, " > "), -1))
        own, base = [primary.eqNullSafe(r) for r in asked], [primary.eqNullSafe(r.split("-")[0]) for r in asked if "-" in r]
        (path_exact, path_partial), (body_exact, body_partial) = (match_counts(asked, lambda r, c=c: F.array_contains(references(c), r)) for c in (path, text))
        mentions = (path_exact - path_partial) * 0.6 + (body_exact - body_partial) * 0.1
        any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
        signals["legal_reference"] = F.when(any_of(own), 1.0).when(any_of(base), 0.0).otherwise(F.greatest(F.least(mentions, F.lit(0.45)), F.lit(0.0)))
    return signals


def rerank_parts(signals: dict[str, Column], profile: str = "legal") -> dict[str, Column]:
    weights = RERANK_WEIGHTS[profile_name(profile)]
    return {k: F.round(v * weights[k], 4) for k, v in signals.items()}


def rerank_score(parts: dict[str, Column]) -> Column:
    return F.round(_sum(list(parts.values())), 4)
