"""A stored index for searches: the rows that can be among the best are found without a scan of texts, and the results
are those of the scan.

Four tables under one folder:

  rows      what was indexed, with its folded texts, references and length, and a key; one folder for each part
  words     the distinct words (runs of letters, digits and _) of all folded fields
  grams     for each three letters in a row the words that hold them
  postings  for each word, and each block of keys, the keys whose rows hold it, with the fields and how often; a block's
            maxima stand beside the arrays, so that they are read alone

A query's word that stands anywhere in a text stands within one of its words: the words table gives all words that hold
it. A search takes (1) the maxima of those words' blocks and from them an upper bound of each block's best score, (2)
the postings of the most promising blocks, whose k-th best score is a lower bound of the result's, (3) the postings of
the other blocks whose bound reaches it, (4) the rows, by key, that still can be among the best, and scores these as the
scan does. Words in a row (phrases) are only confirmed in step 4; before, a row that has all words may have them.

Rows without a word of the query score by their length and archetype alone. They are asked for, in the order of lengths,
only if fewer than k rows score more.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.legal import references_plain
from ..functions.plain import fold_plain, tokens_plain
from ..functions.text import NON_WORD, filled, once
from ..functions.values import SOURCE_BOOST
from .retrieval import best_records, matches
from .scoring import FoldedFacts, lexical_score, lexical_terms, profile_name, terms_struct, with_lexical_inputs

#: Bits of the number of a row within a part, and within a block.
ROW_BITS, BLOCK_BITS = 33, 10
#: Folders of words and postings.
SHARDS = 64
#: Bits of a posting's fields.
FIELDS = {"title": 1, "heading": 2, "file": 4, "archetype": 8}
#: Marks the entries of references among the words; no folded word has it.
REFERENCE = "§"
#: Words, keys and parts that a filter names; beyond that Spark joins.
MOST_NAMED = 400
#: Words of the index that the driver takes, to name or to broadcast them.
MOST_WORDS = 20_000
#: Postings that are scored without a look at blocks, and candidates that the driver takes before it asks Spark to join them.
FEW_POSTINGS, TAKEN = 200_000, 2_000
#: Postings for each row of the index from which on its rows are read as they are: most rows have a word of the query,
#: and to score their folded texts is one narrow stage, while postings must be grouped by row.
SCANNED = 0.25
#: Blocks whose rows give the first bound of the k-th score.
FIRST_BLOCKS = 64
GRAM = 3


def _shard(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, 2)), F.lit(SHARDS)).cast("int")


def _words(c: str) -> Column:
    return F.filter(F.split(F.col(c), NON_WORD), lambda w: w != "")


def _counted_words(x: Column) -> Column:
    """word, fields and n (how often it is in the text) of each distinct word of a row: of its text, in order, and of its fields."""
    starts = F.filter(F.transform(x["body"], lambda w, i: F.when((i == 0) | (F.get(x["body"], i - 1) != w), i)), lambda i: i.isNotNull())
    runs = once(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(x["body"], i).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(x["body"])) - i).alias("n"))))
    others = F.array_except(F.concat(*(x[k] for k in FIELDS)), x["body"])
    bits = lambda w: reduce(lambda a, b: a + b, [F.array_contains(x[k], w).cast("int") * bit for k, bit in FIELDS.items()])
    every = F.concat(runs, F.transform(others, lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"))))
    return F.transform(every, lambda e: F.struct(e["word"].alias("word"), bits(e["word"]).alias("fields"), e["n"].alias("n")))


def _named(column: str, values: list, most: int = MOST_NAMED) -> Column:
    """A filter that Parquet can use: the values of a sorted column, or where they are more than `most` the ranges with
    the fewest others between."""
    values = sorted(values)
    if not values:
        return F.lit(False)
    step = -(-len(values) // most)
    tests = [F.col(column) == v[0] if len(v) == 1 else F.col(column).between(v[0], v[-1]) for v in (values[i : i + step] for i in range(0, len(values), step))]
    while len(tests) > 1:  # a balanced tree
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


class PostedFacts(FoldedFacts):
    """The facts of lexical_terms over sums of postings; which decides on phrases: as if there were none, or as if rows
    that have all the words had them."""

    def __init__(self, words: list[str], whole: str, asked: list[str], upper: bool):
        self.words, self.whole, self.asked, self.upper = words, whole, asked, upper

    def has(self, field: str, word: str) -> Column:
        return F.col(f"has_{field}_{self.words.index(word)}")

    def phrase(self, field: str, whole: str) -> Column:
        if self.words == [whole]:
            return self.has(field, whole)
        return reduce(F.least, [self.has(field, w) for w in self.words]) if self.upper and len(self.words) > 1 else self.has(field, self.words[0]) if self.upper else F.lit(0)

    def count(self, word: str) -> Column:
        i = self.words.index(word)
        return F.when(F.col(f"whole_{i}") > 0, F.col(f"whole_{i}")).otherwise(F.col(f"any_{i}"))

    def has_reference(self, field: str, reference: str) -> Column:
        return F.col(f"ref_{field}_{self.asked.index(reference)}") > 0

    def length(self) -> Column:
        return F.col("length")

    def archetype(self) -> Column:
        return F.col("archetype")


def _asked(query: str, profile: str) -> list[str]:
    """References of the query, and their numbers without the letter."""
    found = references_plain(query) if profile == "legal" else []
    return list(dict.fromkeys([*found, *(r.split("-")[0] for r in found)]))


class SearchIndex:
    """An index in a folder. Rows have title, heading_path, text, file_name, file_type, archetype, source_kind, record_id
    and may have further columns. Searches order and cut as search_records does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the index; its schema is stored beside it, as an empty table has no file."""
        if name not in self._schemas:
            self._schemas[name] = StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schemas/{name}").first()[0]))
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.folder}/{name}")

    def _write(self, name: str, df: DataFrame, *by: str) -> None:
        self._schemas[name] = df.schema
        self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schemas/{name}")
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}")

    # Building

    def build(self, records: DataFrame) -> SearchIndex:
        """Index all records anew; few partitions are dealt out to all cores first."""
        cores = self.spark.sparkContext.defaultParallelism
        self._put_rows(records if records.rdd.getNumPartitions() >= cores else records.repartition(cores))
        self._put_postings(self.table("rows"))
        return self

    def _put_rows(self, records: DataFrame) -> None:
        text = F.coalesce(filled("text"), F.col("title"))
        path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ")
        rows = with_lexical_inputs(records, F.col("title"), path, text, F.col("file_name"), F.col("archetype"))
        rows = rows.withColumn("row_key", F.monotonically_increasing_id()).withColumn("row_part", F.shiftright("row_key", ROW_BITS).cast("int"))
        self._write("rows", rows, "row_part")

    def _put_postings(self, rows: DataFrame) -> None:
        """Words are counted in their row; one shuffle by ranges of word and block, so that a frequent word is dealt out by its blocks."""
        keep = ["row_key", "length", "source_kind", "file_type", "archetype"]
        own = rows.withColumn("length", F.col("_lex_length"))
        reference = lambda kind, refs: F.transform(refs, lambda r: F.struct(F.concat(F.lit(f"{REFERENCE}{kind}:"), r).alias("word"), F.lit(0).alias("fields"), F.lit(1).alias("n")))
        entries = F.concat(
            once(F.struct(F.sort_array(_words("_lex_body")).alias("body"), *(_words(f"_lex_{k}").alias(k) for k in FIELDS)), _counted_words),
            *(reference(k, F.col(f"_ref_{k}")) for k in ("title", "heading", "body")),
            reference("primary", F.array_compact(F.array("_ref_primary"))),
        )
        counted = own.select(*keep, F.explode(entries).alias("e")).select("e.word", *keep, "e.fields", "e.n")
        block = counted.withColumn("block", F.shiftright("row_key", BLOCK_BITS)).withColumn("shard", _shard(F.col("word")))
        ranged = block.repartitionByRange("shard", "word", "block").sortWithinPartitions("shard", "word", "block", "row_key")
        made = ranged.groupBy("shard", "word", "block").agg(
            F.count("*").cast("int").alias("rows"), F.bit_or("fields").alias("any_fields"), F.max("n").alias("most"),
            F.max(F.col("length").between(80, 900).cast("int")).alias("some_fit"), F.collect_list(F.struct(*keep, "fields", "n")).alias("posted"),
        )
        self._write("postings", made.sortWithinPartitions("shard", "word", "block"), "shard")
        words = self.table("postings").groupBy("word").agg(F.sum("rows").alias("rows")).where(~F.col("word").startswith(REFERENCE))
        self._write("words", words.repartitionByRange("word").sortWithinPartitions("word"))
        grams = self.table("words").where(F.length("word") >= GRAM).select("rows", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring("word", i, GRAM)))).alias("gram"), "word")
        grams = grams.withColumn("shard", _shard(F.col("gram")))
        self._write("grams", grams.repartitionByRange("shard", "gram", "word").sortWithinPartitions("shard", "gram", "word"), "shard")

    # Searching

    def words_with(self, wanted: list[str]) -> DataFrame:
        """word, rows: all indexed words that hold one of the wanted, with the numbers of their rows."""
        long, short = [w for w in wanted if len(w) >= GRAM], [w for w in wanted if len(w) < GRAM]
        anyone = lambda ws: reduce(lambda a, b: a | b, [F.col("word").contains(w) for w in ws])
        found = []
        if long:
            first = sorted({w[:GRAM] for w in long})
            found.append(self.table("grams").where(F.col("shard").isin(self._shards(first)) & _named("gram", first) & anyone(long)).select("word", "rows"))
        if short:
            found.append(self.table("words").where(anyone(short)).select("word", "rows"))
        return found[0] if len(found) == 1 and len(first if long else short) == 1 else reduce(DataFrame.unionByName, found).distinct()

    def _shards(self, words: list[str]) -> list[int]:
        return sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in words], "word string").select(_shard(F.col("word"))).collect()})

    def _postings(self, words: list[str], references: list[str]) -> tuple[DataFrame, bool]:
        """The postings of the words that hold those of the query, and of references; whether they are few.

        Few words are named: their folders and, in these, their rows are read. More are joined, from a broadcast if they
        are at most MOST_WORDS.
        """
        own, with_them = self.table("postings"), self.words_with(words)
        taken = with_them.limit(MOST_WORDS + 1).collect()
        if len(taken) > MOST_WORDS:
            return own.join(with_them.select("word").unionByName(self.spark.createDataFrame([(r,) for r in references], "word string")), "word", "left_semi"), False
        found, few = [*(r["word"] for r in taken), *references], sum(r["rows"] for r in taken) <= FEW_POSTINGS
        own = own.where(F.col("shard").isin(self._shards(found)) & _named("word", found)) if found else own.where(F.lit(False))
        return (own if len(found) <= MOST_NAMED else own.join(F.broadcast(self.spark.createDataFrame([(w,) for w in found], "word string")), "word", "left_semi")), few

    def _bounds(self, postings: DataFrame, words: list[str], whole: str, asked: list[str], query: str, profile: str) -> DataFrame:
        """block and the most that a row of it can score."""
        word, fields, most = F.col("word"), F.col("any_fields"), F.col("most")
        sums = []
        for i, w in enumerate(words):
            inside = word.contains(w) & ~word.startswith(REFERENCE)
            for field, bit in FIELDS.items():
                sums.append(F.max((inside & (fields.bitwiseAND(bit) > 0)).cast("int")).alias(f"has_{field}_{i}"))
            sums.append(F.max((inside & (most > 0)).cast("int")).alias(f"has_body_{i}"))
            sums.append(F.coalesce(F.sum(F.when(inside, most * _times(word, w))), F.lit(0)).alias(f"any_{i}"))
        out = postings.groupBy("block").agg(*sums, *_reference_sums(asked, F.col("rows")), F.max("some_fit").alias("some_fit"))
        # A count is at most what stands anywhere, and counts beyond what is rewarded are not held against a row here.
        out = out.select("*", *(F.lit(0).alias(f"whole_{i}") for i in range(len(words)))).withColumns({f"any_{i}": F.least(f"any_{i}", F.lit(6)) for i in range(len(words))})
        out = out.withColumn("length", F.when(F.col("some_fit") == 1, 80).otherwise(40)).withColumn("archetype", F.lit(_TYPED))
        terms = lexical_terms(query, F.lit(max(SOURCE_BOOST, key=SOURCE_BOOST.get)), profile, PostedFacts(words, whole, asked, True))
        return out.select("block", reduce(lambda a, b: a + b, [v for k, v in terms.items() if not k.endswith("penalty")]).alias("bound"))

    def _scored(self, postings: DataFrame, words: list[str], whole: str, asked: list[str], query: str, profile: str) -> DataFrame:
        """row_key, length, low and high: the score without and with the phrases that it may have."""
        keep = ["row_key", "length", "source_kind", "file_type", "archetype"]
        rows = postings.select("word", F.explode("posted").alias("p")).select("word", "p.*")
        word, sums = F.col("word"), []
        for i, w in enumerate(words):
            inside = word.contains(w) & ~word.startswith(REFERENCE)
            for field, bit in FIELDS.items():
                sums.append(F.max((inside & (F.col("fields").bitwiseAND(bit) > 0)).cast("int")).alias(f"has_{field}_{i}"))
            sums.append(F.max((inside & (F.col("n") > 0)).cast("int")).alias(f"has_body_{i}"))
            sums.append(F.coalesce(F.sum(F.when(word == w, F.col("n"))), F.lit(0)).alias(f"whole_{i}"))
            sums.append(F.coalesce(F.sum(F.when(inside, F.col("n") * _times(word, w))), F.lit(0)).alias(f"any_{i}"))
        own = rows.groupBy(*keep).agg(*sums, *_reference_sums(asked, F.lit(1)))
        for name, upper in (("low", False), ("high", True)):
            terms = lexical_terms(query, F.col("source_kind"), profile, PostedFacts(words, whole, asked, upper))
            own = own.withColumn(f"_{name}", terms_struct(terms)).withColumn(name, lexical_score(F.col(f"_{name}"), list(terms)))
        return own.select(*keep, "low", "high")

    def candidates(self, query: str, filters: Mapping[str, Any] | None, limit: int, profile: str) -> DataFrame | list[int] | None:
        """row_key of all rows that can be among the `limit` best, and few others; None for all rows: if the query has no
        word, or words that stand in too many rows."""
        whole, words, asked = fold_plain(query), tokens_plain(query), _asked(query, profile)
        if not words:
            return None
        held = self.words_with(words).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if held > FEW_POSTINGS and held >= SCANNED * self.table("rows").count():
            return None
        args = (words, whole, asked, query, profile)
        fit = matches({k: v for k, v in (filters or {}).items() if k != "file_name"})
        named = self.table("rows").where(matches(filters)).select("row_key") if (filters or {}).get("file_name") else None
        postings, few = self._postings(words, [f"{REFERENCE}{k}:{r}" for k in ("title", "heading", "body", "primary") for r in asked])

        def scored(own: DataFrame) -> DataFrame:
            rows = self._scored(own, *args).where(fit & (F.col("high") > 0))
            return rows if named is None else rows.join(named, "row_key", "left_semi")

        floor = 3 if profile == "legal" else 2  # of rows without a word: their length fits, their archetype is favoured
        rows = scored(postings)
        if not few:
            bounds = self._bounds(postings.select("word", "block", "rows", "any_fields", "most", "some_fit"), *args)
            first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
            least = _cut(scored(postings.where(F.col("block").isin(first))).orderBy(F.desc("low"), "length").limit(limit).collect(), limit)
            if least and least[0] > floor:
                rows = scored(postings.join(bounds.where(F.col("bound") >= least[0]).select("block"), "block", "left_semi"))
        top = rows.orderBy(F.desc("high"), "length").limit(max(TAKEN, limit)).collect()
        least = _cut(top, limit)
        if least and least[0] > floor:
            if len(top) < max(TAKEN, limit) or not _reaches(top[-1], least):
                return [r["row_key"] for r in top if _reaches(r, least)]
            return rows.where(_reached(least)).select("row_key")
        # Rows that have no word of the query: those of the best lengths, as far as they are needed.
        terms = lexical_terms(query, F.col("source_kind"), profile, _Nothing())
        others = self.table("rows").where(matches(filters)).select("row_key", F.col("_lex_length").alias("length"), "archetype", "source_kind")
        others = others.withColumn("_t", terms_struct(terms)).withColumn("low", lexical_score(F.col("_t"), list(terms))).where("low > 0")
        others = others.join(rows.select("row_key"), "row_key", "left_anti").select("row_key", "length", "low", F.col("low").alias("high"))
        both = rows.select("row_key", "length", "low", "high").unionByName(others)
        least = _cut(both.orderBy(F.desc("low"), "length").limit(limit).collect(), limit)
        return both.where(_reached(least)).select("row_key") if least else both.select("row_key")

    def rows_of(self, keys: DataFrame | list[int]) -> DataFrame:
        """The indexed rows of some keys: of few, from their parts' files by a filter; of many, by a join."""
        few = keys if isinstance(keys, list) else [r[0] for r in keys.limit(MOST_NAMED + 1).collect()]
        rows = self.table("rows")
        if len(few) > MOST_NAMED:
            return rows.join(self.spark.createDataFrame([(k,) for k in keys], "row_key long") if isinstance(keys, list) else keys, "row_key", "left_semi")
        parts = sorted({k >> ROW_BITS for k in few})
        return rows.where(F.col("row_part").isin(parts) & _named("row_key", few)) if few else rows.where(F.lit(False))

    def search(self, query: str, filters: Mapping[str, Any] | None = None, limit: int = 10, profile: str = "legal") -> DataFrame:
        """The rows of search_records, in the same order with the same columns."""
        profile = profile_name(profile)
        found = self.candidates(query, filters, limit, profile)
        rows = self.table("rows") if found is None else self.rows_of(found)
        return best_records(rows.where(matches(filters)), query, limit, profile).drop("row_key", "row_part")


def _cut(rows: list, limit: int) -> tuple[int, int] | None:
    """(score, length) of the limit-th of rows by their lower bounds; None if they are fewer."""
    best = sorted((-r["low"], r["length"]) for r in rows if r["low"] > 0)[:limit]
    return (-best[-1][0], best[-1][1]) if len(best) == limit and limit > 0 else None


def _reaches(row, least: tuple[int, int]) -> bool:
    return row["high"] > least[0] or (row["high"] == least[0] and row["length"] <= least[1])


def _reached(least: tuple[int, int]) -> Column:
    return (F.col("high") > least[0]) | ((F.col("high") == least[0]) & (F.col("length") <= least[1]))


class _Nothing(FoldedFacts):
    """The facts of rows that have nothing of the query."""

    def has(self, field: str, word: str) -> Column:
        return F.lit(0)

    def count(self, word: str) -> Column:
        return F.lit(0)

    def has_reference(self, field: str, reference: str) -> Column:
        return F.lit(False)

    def length(self) -> Column:
        return F.col("length")

    def archetype(self) -> Column:
        return F.col("archetype")


#: Any archetype that the score favours.
_TYPED = "legislation_normative"


def _times(word: Column, part: str) -> Column:
    """How often a part stands in a word, without overlaps."""
    return ((F.length(word) - F.length(F.replace(word, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _reference_sums(asked: list[str], n: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("word") == f"{REFERENCE}{k}:{r}", n)), F.lit(0)).alias(f"ref_{k}_{i}") for k in ("title", "heading", "body", "primary") for i, r in enumerate(asked)]
