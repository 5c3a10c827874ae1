"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_gbt import Rule

#: The rules of op6_url_trees.
URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .hdc_langid import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query
def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_automaton import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .ipf_mix import mix
    from .stages import ALPHA, KEEP, topic_of, words_in

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("words", words_in(F.col("text")))
    docs = stored(docs.withColumn("form", topic_of(F.col("text"), F.col("words"))).drop("text"), "mix-rows")
    mixed = mix(docs, F.col("words"), F.col("form"), alpha=ALPHA, keep=KEEP)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), F.round("marginal_gap", 6).alias("marginal_gap"), "selected")


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bitpack import read_shards, write_shards
    from .common import new_path

    shards = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_shards(spark, shards, digest=True).withColumnRenamed("key", "doc_id")


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pca_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, quality of the labels that are learned from: those whose crc32(doc_id as text) mod 4 is not 2, MOST_LABELS at
    most. Of several labels of a document the highest counts; null labels and ids teach nothing."""
    from .common import bounded, fold_of

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality").where(F.col("quality").isNotNull() & (fold_of("doc_id", 4) != 2))
    return bounded(labels.groupBy("_id").agg(F.max("quality").alias("quality")), MOST_LABELS, F.col("_id"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on the labelled documents of docs."""
    from .common import small_side
    from .fm_quality import train

    rows = docs.select("doc_id", "text", "n_chars").join(small_side(labels_of(spark, sf_dir), MOST_LABELS), F.col("doc_id") == F.col("_id"))
    return train(rows, "quality", meta=("n_chars",), most=MOST_LABELS)


#: Labelled documents that the quality models are fitted on, at most.
MOST_LABELS = 6000


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .fm_quality import scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_model(spark, docs, sf_dir)
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    return scored(docs.withColumn("held_out", held_out), model, meta=("n_chars",)).select("doc_id", "held_out", "score", "predicted")


@query
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .oph_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of, small_side
    from .decision_list import judged, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs.join(small_side(labels_of(spark, sf_dir), MOST_LABELS), F.col("doc_id") == F.col("_id")), "quality", most=MOST_LABELS)
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    return judged(docs.withColumn("held_out", held_out), rules).drop("text")


@query
def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_gbt import judged, label_by_rules, train

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, URL_RULES, train(label_by_rules(pages, URL_RULES), "url", "label")).drop("url")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scanned

    docs = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "candidates", F.size("spans").alias("n_licensed_blocks"), F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least_docs=30, most=50)


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crc_resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)


@query
def op13_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_transducer import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ORACLE_SQL["op7_embedding_dedup"] = """
with recursive fine as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
    where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed as (
    select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from fine
), links as (
    select a.vec_id as a, b.vec_id as b from normed a join normed b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
    where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93
), reach as (
    select vec_id as node, vec_id as other from embeddings union select r.node, l.b from reach r join links l on r.other = l.a
)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select node, min(other) as component_id from reach group by node) c on c.node = e.vec_id
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
"""

ORACLE_SQL["op10_minhash_dedup"] = """
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), each_ as (
    select doc_id, unnest(s) as x from sets
), links as (
    select p.a, p.b from (select a.doc_id as a, b.doc_id as b, count(*) as both_ from each_ a join each_ b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2) p
    join sets l on l.doc_id = p.a join sets r on r.doc_id = p.b where 100 * p.both_ >= 85 * (len(l.s) + len(r.s) - p.both_)
), reach as (
    select doc_id as node, doc_id as other from documents union select r.node, l.b from reach r join links l on r.other = l.a
)
select s.doc_id, len(s.s) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select node, min(other) as component_id from reach group by node) c on c.node = s.doc_id
"""

ORACLE_SQL["op11_source_divergence"] = """
with docs as (
    select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents
), words as (
    select i, lang, source, unnest(terms) as term from docs
), kept as (
    select lang, term from words group by lang, term having count(distinct i) >= 30
), groups as (
    select distinct lang, source from docs
), found as (
    select lang, source, term, count(*)::hugeint as n from words semi join kept using (lang, term) group by all
), full_ as (
    select g.lang, g.source, k.term, coalesce(f.n, 0) as n from groups g join kept k on k.lang = g.lang left join found f on f.lang = g.lang and f.source = g.source and f.term = k.term
), shares as (
    select lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as p from full_
), of_lang as (
    select lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)) as q from (select lang, term, sum(n) as n from full_ group by all)
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(abs(p.p - q.p)), 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join shares p on p.lang = a.lang and p.source = a.source left join shares q on q.lang = b.lang and q.source = b.source and q.term = p.term group by all
), terms as (
    select s.lang, s.source, s.term as item, s.p - l.q as value from shares s join of_lang l on l.lang = s.lang and l.term = s.term where s.n > 0 and s.p > l.q
)
select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select lang, source, 'term' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms qualify rank <= 50
"""

_RUNS = """
    select i, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]), list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])))) as run from
"""
_HASHED_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB has no crc32: a table of the 256 remainders, and a fold over the bytes.
ORACLE_SQL["op12_importance_resampling"] = f"""
with recursive steps as (
    select b, b::bigint as x, 0 as k from range(256) t(b) union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from steps where k < 8
), remainders as (
    select list(x order by b) as r from steps where k = 8
), own as (
    select row_number() over () as i, doc_id, {_HASHED_WORDS} as w from documents
), wanted as (
    select row_number() over () as i, {_HASHED_WORDS} as w from benchmark
), runs as ({_RUNS} own), wanted_runs as ({_RUNS} wanted), all_runs as (
    select distinct run from (select run from runs union all select run from wanted_runs)
), hashed as (
    select run, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(run)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket from all_runs, remainders
), source_counts as (
    select bucket, count(*) as n from runs join hashed using (run) group by bucket
), wanted_counts as (
    select bucket, count(*) as n from wanted_runs join hashed using (run) group by bucket
), gains as (
    select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from source_counts) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from wanted_counts) + 10000)::double)))::bigint as gain
    from range(10000) b(bucket) left join source_counts s using (bucket) left join wanted_counts t using (bucket)
), weights as (
    select i, count(*) as n_features, sum(gain)::bigint as weight from runs join hashed using (run) join gains using (bucket) group by i
), scored as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::bigint + 0.5) / 4294967296::double))))::bigint as score from own left join weights using (i)
), placed as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) filter (n_words >= 20) over () as n from scored
)
select doc_id, n_features, weight, score, (case when n_words >= 20 and place <= 5 * n // 100 then place end)::bigint as rank from placed
"""


# The parts of operators that SQL can express, as queries of their own


@query
def mix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words of each cell that op2_mixing rakes."""
    from .stages import topic_of, words_in

    docs = table(spark, sf_dir, "documents").withColumn("words", words_in(F.col("text")))
    cell = ("source", "lang", topic_of(F.col("text"), F.col("words")).alias("topic"))
    return docs.groupBy(*cell).agg(F.count("*").alias("n_docs"), F.sum("words").cast("long").alias("n_tokens"))


ORACLE_SQL["mix_cells"] = """
with d as (select source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as words, length(text) - length(replace(text, '|', '')) as bars, length(text) - length(replace(text, '!', '')) as marks from documents)
select source, lang, case when bars * 8 > words then 'table' when marks * 8 > words then 'exclamation' when words < 100 then 'note' when words < 800 then 'article' else 'long' end as topic,
       count(*) as n_docs, sum(words)::bigint as n_tokens from d group by all
"""


@query
def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op5_decision_list, without learned rules."""
    from .decision_list import judged

    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "base_failed")


ORACLE_SQL["quality_base_counts"] = """
with d as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from documents
), windows as (
    select doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
), often as (
    select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from windows) where n >= 2
), inside as (
    select doc_id, count(distinct i + k) as n from often cross join (values (0), (1), (2)) as o(k) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
       (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(list_distinct(w))::bigint as n_distinct, len(lines)::bigint as n_lines,
       len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from d left join inside i on i.doc_id = d.doc_id
"""


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict of those that a rule judges."""
    from .url_gbt import Booster, judged

    pages = judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, Booster(-30.0, [], {}))
    return pages.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


ORACLE_SQL["url_rules"] = """
with u as (
    select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u
), r as (
    select * from (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) as t(h, s, verdict)
)
select p.page_id, p.host, p.path, arg_max(r.h || r.s, length(r.h || r.s)) as rule, arg_max(r.verdict, length(r.h || r.s)) as verdict
from p left join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.s) group by p.page_id, p.host, p.path
"""
