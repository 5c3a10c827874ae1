"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, free_name, stored
from .hdc_langid import DIM

#: A document's cosine with its language below which it resembles no known language: four deviations of the noise.
LEAST_COSINE = 4 / DIM**0.5
#: Chance that two trigrams of one language are equal, and the part of the cosine so expected that a short text must reach.
SAME_TRIGRAM, LEAST_PART = 0.005, 1 / 3
#: The word share of each source, language and topic is its share raised to this, the budget a share of all words.
ALPHA, KEEP = 0.5, 0.6


def topic_of(text, n_words):
    """A coarse topic from the text's form: tables, dialogue-like exclamations, short notes, articles, long reads."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|")))
    marks = F.length(text) - F.length(F.replace(text, F.lit("!")))
    return F.when(bars * 8 > n_words, "table").when(marks * 8 > n_words, "exclamation").when(n_words < 100, "note").when(n_words < 800, "article").otherwise("long")


def words_in(text):
    """The number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def least_cosine(text):
    """LEAST_COSINE, or less for a text of n < 30 or so trigrams: LEAST_PART of the cosine that n trigrams of a language are expected to have with it."""
    n = F.length(F.regexp_replace(text, r"\P{L}+", " ")) * F.lit(SAME_TRIGRAM)
    return F.least(F.lit(LEAST_COSINE), F.sqrt(n / (1 + n)) * LEAST_PART)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no known language; those that stay have the predicted one as lang, which the mixing stage uses.

    The profiles are learned from the stage's own input. Rejected are null and empty texts, texts without letters, those
    nearer to random letters than to any language, and those whose cosine is that of noise. Of texts of one or two words
    some in no known language stay, as their cosines are alike. Without a known language nothing stays; repeated rows
    fare alike; further columns stay as they are.
    """
    from .hdc_langid import learn, with_random_letters

    model = with_random_letters(learn(docs.where(F.coalesce(fold_of("doc_id", 5) != 0, F.lit(True)))))
    name = free_name(docs, "langid")
    found = docs.withColumn(name, model.column(F.col("text")))
    score = F.col(f"{name}.score")
    enough = F.when(score >= LEAST_COSINE, True).otherwise(score >= least_cosine(F.col("text")))
    kept = found.where((F.col(f"{name}.lang_pred") != "und") & enough)
    return kept.select(*(F.col(f"{name}.lang_pred").alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier, fitted on labelled documents, finds of low quality.

    Without a labelled document in docs all stay. Null and empty texts are scored by their (empty) structure; null
    n_chars counts as the mean; repeated rows fare alike; an empty table gives an empty one; further columns stay.
    """
    from .fm_quality import scored
    from .queries import quality_model

    model = quality_model(spark, docs, sf_dir)
    if not model.fitted:
        return docs
    return scored(docs.select(F.struct("*").alias("row"), "text", "n_chars"), model, meta=("n_chars",)).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near copies (five words, similarity 0.8).

    Texts without a word are copies of nothing and stay. Rows that share an id, and those without one, get numbers of
    their own, in the order of the ids, so that each is judged by its own text; of equal rows one stays. An empty table
    gives an empty one.
    """
    from .oph_dedup import near_duplicates

    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    key, rows = "doc_id", docs
    if again:
        key, place = free_name(docs, "dedup_key"), (F.col("doc_id"), F.xxhash64("text"))
        rows = stored(docs.repartitionByRange(*place).sortWithinPartitions(*place).withColumn(key, F.monotonically_increasing_id()), "pipeline-keys")
    found = near_duplicates(rows, key=key, percent=80).where("not kept").select(F.col(key).alias("_dropped"))
    return rows.join(found, F.col(key) == F.col("_dropped"), "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by probabilities raked to source, language and topic shares.

    A null source or language is a value of its own; null and empty texts have no words and the probability of their
    cell; rows that share an id (null ids share one) fare alike within a cell; an empty table gives an empty one.
    """
    from .ipf_mix import mix

    words = words_in(F.col("text"))
    tmp = free_name(docs, "mix_words")
    rows = docs.withColumn(tmp, words)
    mixed = mix(rows, F.col(tmp), topic_of(F.col("text"), F.col(tmp)), alpha=ALPHA, keep=KEEP)
    return mixed.where("selected").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of each document; a null text has no ids, repeated rows come back repeated."""
    import public_tokenizers

    from .bpe_automaton import round_trip

    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
