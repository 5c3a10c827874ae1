"""Operators on inline rows: names, mentions, rules, OCR words, statements and answers, against DuckDB on the same rows."""

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from test_oracles import canonical

from arandu.functions import legal, text
from arandu.operators import answers, chunks, classify, retrieval, structure
from arandu.plans import expected
from arandu.plans import fixtures as fx
from arandu.plans import sql as q
from arandu.plans.queries import LEGAL_TOPIC, frame
from arandu.plans.table_queries import _read_pages
from arandu.sources import files, ocr

CASES, SQL = {}, {}


def query(sql=None):
    def register(f):
        CASES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    f"""with o as (select doc_id, regexp_extract_all(content, '(?s)<STMTTRN>(.*?)</STMTTRN>', 1) as t from {q.values(fx.OFX, ['doc_id', 'content'])}),
    e as (select doc_id, length(t) as transaction_count, unnest(t[1:200]) as x, generate_subscripts(t[1:200], 1) as pos from o)
    select doc_id, pos::int as pos, transaction_count::int as transaction_count, strftime(strptime(regexp_extract(x, '<DTPOSTED>(\\d{{8}})', 1), '%Y%m%d'), '%Y-%m-%d 00:00:00') || ' | ' || lower(regexp_extract(x, '<TRNTYPE>(\\w+)', 1)) || ' | ' || regexp_extract(x, '<TRNAMT>([-0-9.]+)', 1) || ' | ' || trim(regexp_extract(x, '<MEMO>([^<]*)', 1)) as text from e"""
)
def ofx_transactions(spark, sf_dir):
    rows = frame(spark, fx.OFX, "doc_id int, content string").select("doc_id", files.parse_column(F.col("content").cast("binary"), F.lit("ofx")).alias("p"))
    return rows.select("doc_id", F.explode("p.blocks").alias("b"), F.col("p.transaction_count")).select("doc_id", "b.pos", "transaction_count", "b.text")


@query(
    f"""select page, block, par, line, string_agg(trim(text), ' ' order by seq) as text, round(avg(case when conf > 1 then conf / 100 when conf >= 0 then conf end), 4) as confidence,
    min("left")::double as x0, min(top)::double as y0, max("left" + width)::double as x1, max(top + height)::double as y1
    from {q.values(fx.OCR_WORDS, ['page', 'block', 'par', 'line', 'seq', 'text', 'conf', '"left"', 'top', 'width', 'height'])} where trim(coalesce(text, '')) <> '' group by page, block, par, line"""
)
def ocr_line_grouping(spark, sf_dir):
    words = frame(spark, fx.OCR_WORDS, "page int, block int, par int, line int, seq int, text string, conf double, left int, top int, width int, height int")
    box = F.col("box")
    return ocr.group_words(words).select("page", "block", "par", "line", "text", "confidence", box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[5].alias("y1"))


@query(f"select count(*) as line_count, greatest(count(distinct page), 1) as page_count, round(avg(c), 4) as average_confidence from (select page, block, par, line, round(avg(case when conf > 1 then conf / 100 when conf >= 0 then conf end), 4) as c from {q.values(fx.OCR_WORDS, ['page', 'block', 'par', 'line', 'seq', 'text', 'conf', 'x', 'y', 'w', 'h'])} where trim(coalesce(text, '')) <> '' group by page, block, par, line)")
def ocr_stats(spark, sf_dir):
    words = frame(spark, fx.OCR_WORDS, "page int, block int, par int, line int, seq int, text string, conf double, left int, top int, width int, height int")
    return ocr.line_stats(ocr.group_words(words))


@query(
    f"""select path, lower(regexp_extract(path, '[^/]*$')) in ('.gitkeep', '.ds_store', 'thumbs.db') as ignored,
    {q.mapped({k: q.quoted(v) for k, v in fx.PARSERS.items()}, "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))", 'null')} as parser
    from {q.values(fx.PATHS, ['path'])}"""
)
def file_routing(spark, sf_dir):
    return frame(spark, fx.PATHS, "path string").select("path", files.is_ignored(F.col("path")).alias("ignored"), files.parser_of(F.col("path")).alias("parser"))

#: RE2 takes the ordinal sign for no letter, so that a number before it would end at a word boundary.
_NO_ORDINALS = f"replace(text, {q.quoted('º')}, {q.quoted('_')})"


@query(
    f"""select doc_id, pos, text, coalesce(array_to_string(list_sort(list_distinct({q.references(_NO_ORDINALS)})), ','), '') as refs from {q.values(fx.LINES, ['doc_id', 'pos', 'text'])}"""
)
def legal_refs(spark, sf_dir):
    return frame(spark, fx.LINES, "doc_id int, pos int, text string").withColumn("refs", F.array_join(F.array_sort(legal.references("text")), ","))


@query(
    f"""with d as (select * from {q.values(fx.ARCHETYPES, ['doc_id', 'file_name', 'file_type', 'mode', 'root_tag', 'transaction_count', 'kinds', 'body'])}),
    t as (select *, lower(file_name || chr(10) || coalesce(body, '')) as s from d)
    select doc_id, case
        when file_type = 'ofx' or root_tag = 'ofx' or list_contains(kinds, 'transaction') or transaction_count is not null then 'financial_statement_ofx'
        when mode = 'structured_legal' or list_has_any(kinds, ['article', 'chapter', 'preamble']) then (case when contains(s, 'passa a vigorar com as seguintes alteracoes') and contains(s, 'emenda constitucional') then 'legislation_amending_act' else 'legislation_normative' end)
        when mode in ('structured_manual', 'structured_faq') or contains(s, 'procedimentos') then 'manual_procedural'
        when file_type in ('csv', 'xlsx') or list_has_any(kinds, ['table_row', 'sheet_row']) then 'spreadsheet_structured'
        when file_type = 'xml' or mode = 'xml_tree' or root_tag is not null or list_contains(kinds, 'xml_node') then 'xml_structured'
        when contains(s, 'acordao') or contains(s, 'tribunal') then 'judicial_case'
        else 'generic_document' end as archetype from t"""
)
def archetype_rules(spark, sf_dir):
    d = frame(spark, fx.ARCHETYPES, "doc_id int, file_name string, file_type string, mode string, root_tag string, transaction_count int, kinds array<string>, body string")
    block = F.transform("kinds", lambda k, i: F.struct(k.alias("kind"), F.lit(None).cast("string").alias("title"), F.when(i == 0, F.col("body")).alias("text")))
    docs = d.select("doc_id", "file_name", text.file_stem("file_name").alias("file_stem"), "file_type", F.lit("").alias("source_path"), "mode", "root_tag", "transaction_count", block.alias("blocks"))
    return classify.archetypes(docs).select("doc_id", "archetype")


@query(
    f"""select name, folder, case when folder = 'normas_procedimento' or contains(s, 'norma_de_procedimento') then 'normas_procedimento' when contains(s, 'lei') then 'leis' when contains(s, 'decreto') then 'decretos' when contains(s, 'portaria') then 'portarias' when contains(s, 'resol') or contains(s, 'sumula') or regexp_matches(s, '(^|_)\\d{{1,4}}_r($|_)') then 'resolucoes' else 'normas_mistas' end as target,
    coalesce(nullif(regexp_extract(name, '(?:19|20)\\d{{2}}'), ''), 'sem_ano_definido') as year
    from (select *, trim(regexp_replace({q.fold('name')}, '[^a-z0-9]+', '_', 'g'), '_') as s from {q.values(fx.BATCH_FILES, ['name', 'folder'])})"""
)
def batch_routing(spark, sf_dir):
    return frame(spark, fx.BATCH_FILES, "name string, folder string").select("name", "folder", classify.legislation_folder(F.col("name"), F.col("folder")).alias("target"), classify.year_folder(F.col("name")).alias("year"))

_LEGAL_ROWS = q.values(fx.CHUNKS, ["chunk_id", "file_name", "archetype", "heading", "text", "refs_heading", "refs_text", "primary_ref"])

_LEGAL_FOLDED = f"folded as (select *, {q.fold('heading')} as f_title, {q.fold('heading')} as f_heading, {q.fold('text')} as f_body, {q.words_of(q.fold('text'))} as w_body, {q.fold('file_name')} as f_file, {q.fold('archetype')} as f_type, length({q.squeeze('text')}) as n, refs_heading as r_title, refs_heading as r_heading, refs_text as r_body, primary_ref as r_primary from {_LEGAL_ROWS})"


def legal_fixture_chunks(spark: SparkSession) -> DataFrame:
    rows = [r[:5] for r in fx.CHUNKS]
    return frame(spark, rows, "chunk_id string, file_name string, archetype string, heading string, text string").withColumns({"heading_path": F.array("heading"), "source_kind": F.lit("chunk"), "file_type": F.lit("txt")})


@query(f"with {_LEGAL_FOLDED}, scored as (select *, {q.lexical(LEGAL_TOPIC, 'legal')} as score from folded) select chunk_id, score from scored where score > 0 order by score desc, n, file_name, heading limit 10")
def search_topk_legal(spark, sf_dir):
    rows = legal_fixture_chunks(spark).withColumns({"title": F.col("heading"), "record_id": F.col("chunk_id")})
    return retrieval.search_records(rows, LEGAL_TOPIC, limit=10, profile="legal").select("chunk_id", "score")


@query()
def rerank_legal(spark, sf_dir):
    """The fixture's chunks for a legal query; 156-A stands above 156 in the tests."""
    top = retrieval.rerank(retrieval.hybrid_candidates(legal_fixture_chunks(spark), LEGAL_TOPIC), LEGAL_TOPIC, 6)
    return top.select("chunk_id", "text_score", "score")


@query(
    f"""with a as (select answer_id, answer_text, ids, list_filter(list_transform(regexp_extract_all(answer_text, '\\[(\\d+)\\]', 1), lambda x: x::int), lambda x: list_contains(ids, x)) as hit from {q.values(fx.ANSWERS, ['answer_id', 'answer_text', 'ids'])})
    select answer_id, case when length(hit) > 0 then array_to_string(list_filter(hit, lambda x, i: list_position(hit, x) = i), ',') else array_to_string(ids, ',') end as cited from a"""
)
def citations(spark, sf_dir):
    rows = frame(spark, fx.ANSWERS, "answer_id int, answer_text string, ids array<int>")
    rows = rows.withColumn("grounding", F.transform("ids", lambda i: F.struct(i.alias("id"), F.concat(F.lit("ref "), i.cast("string")).alias("reference"))))
    return answers.cited(rows).select("answer_id", F.array_join(F.transform("citations", lambda c: c["id"].cast("string")), ",").alias("cited"))


def legal_documents(spark: SparkSession, given: list[tuple] = fx.LINES, parser: str = "txt") -> DataFrame:
    """A fixture's lines as documents with blocks, read as a TXT file or as page texts of a PDF ("pages")."""
    rows = frame(spark, given, "doc_id int, pos int, text string")
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))
    parsed = whole.select("doc_id", files.parse_column(F.col("t").cast("binary"), F.lit(parser), {"pages": _read_pages}).alias("p"))
    own = parsed.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("file_name"), F.concat(F.lit("doc_"), "doc_id").alias("file_stem"), F.lit("txt").alias("file_type"), F.lit("").alias("source_path"), F.col("p.mode"), F.col("p.root_tag"), F.col("p.transaction_count"), F.col("p.blocks"))
    made = classify.archetypes(own)
    return spark.createDataFrame(made.collect(), made.schema)  # three documents: a plain table keeps later plans small


@query(f"select * from {q.values(expected.LEGAL_BLOCKS, ['doc_id', 'archetype', 'pos', 'kind', 'title', 'text', 'locator_path', 'display_title'])}")
def legal_blocks(spark, sf_dir):
    """Blocks of the fixture's documents, against rows written from the rules."""
    return files.blocks_of(legal_documents(spark), "doc_id", "archetype").select("doc_id", "archetype", "pos", "kind", "title", "text", text.locator_path(F.col("locator")).alias("locator_path"), "display_title")


@query(f"select * from {q.values(expected.LEGAL_INDEX, ['doc_id', 'pos', 'kind', 'title', 'level', 'parent_pos', 'path', 'last_pos'])}")
def legal_index(spark, sf_dir):
    """Index of the fixture's documents, against rows written from the rules."""
    return structure.index_entries(legal_documents(spark)).select("doc_id", "pos", "kind", "title", "level", "parent_pos", F.array_join("path", " > ").alias("path"), "last_pos")


def _fixture_chunks(spark: SparkSession, given: list[tuple], parser: str = "txt") -> DataFrame:
    docs = legal_documents(spark, given, parser)
    local = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  34 lines: plain tables keep the plan small
    blocks, entries = local(structure.block_paths(files.blocks_of(docs, "doc_id")).drop("stack")), local(structure.index_entries(docs))
    return chunks.with_chunk_ids(chunks.document_chunks(docs, entries, blocks), docs)


@query(f"select * from {q.values(expected.MANUAL_BLOCKS, ['doc_id', 'pos', 'kind', 'title', 'heading_level', 'grp'])}")
def manual_blocks(spark, sf_dir):
    """Blocks of the manual, against rows written from the rules."""
    blocks = files.blocks_of(legal_documents(spark, fx.MANUAL_LINES, "pages"), "doc_id")
    return blocks.select("doc_id", "pos", "kind", "title", "heading_level", F.coalesce("heading_group", "manual_group").alias("grp"))


@query(f"select * from {q.values(expected.MANUAL_INDEX, ['doc_id', 'pos', 'title', 'level', 'parent_pos', 'path', 'last_pos'])}")
def manual_index(spark, sf_dir):
    """Index of the manual, against rows written from the rules."""
    return structure.index_entries(legal_documents(spark, fx.MANUAL_LINES, "pages")).select("doc_id", "pos", "title", "level", "parent_pos", F.array_join("path", " > ").alias("path"), "last_pos")


@query(f"select * from {q.values(expected.MANUAL_CHUNKS, ['doc_id', 'chunk_id', 'heading', 'positions', 'manual_group', 'text'])}")
def manual_chunks(spark, sf_dir):
    """Chunks of the manual, against rows written from the rules."""
    made = _fixture_chunks(spark, fx.MANUAL_LINES, "pages")
    return made.select("doc_id", "chunk_id", "heading", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"), "manual_group", "text")


@query(f"select * from {q.values(expected.LEGAL_CHUNKS, ['doc_id', 'chunk_id', 'heading', 'heading_path', 'positions', 'text_length', 'token_count', 'act_title', 'manual_group'])}")
def legal_chunks(spark, sf_dir):
    """Chunks of the fixture's documents with ids over the collection, against rows written from the rules."""
    return _fixture_chunks(spark, fx.LINES).select("doc_id", "chunk_id", "heading", F.array_join("heading_path", " > ").alias("heading_path"), F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"), "text_length", "token_count", "act_title", "manual_group")


@pytest.mark.parametrize("name", sorted(SQL))
def test_inline_rows(spark, name):
    df, other = CASES[name](spark, ""), duckdb.sql(SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    rows = canonical([tuple(r) for r in df.collect()], df.columns)
    assert rows == canonical(other.fetchall(), other.columns) and rows


def test_reference_with_letter_stands_above(spark):
    ids = [r["chunk_id"] for r in CASES["rerank_legal"](spark, "").collect()]
    assert ids[0] == "c1" and ("c2" not in ids or ids.index("c2") > ids.index("c1"))


def test_only_ignored(spark):
    def asked(*paths):
        return files.only_ignored(frame(spark, [(p,) for p in paths], "path string")).collect()[0]["only_ignored"]

    assert asked("/a/.gitkeep", "/a/Thumbs.db") and not asked("/a/.gitkeep", "/a/x.txt") and not asked()


def test_domain_and_primary_structure(spark):
    rows = [
        (1, "legislation_normative", "line_text", ["line"], "legal_normative", "line_text"),
        (2, "judicial_case", None, ["line"], "judicial_document", "flat_blocks"),
        (3, "manual_procedural", "", ["article"], "legal_normative", "structured_legal"),
        (4, "generic_document", None, ["sheet_row"], "tabular_document", "flat_blocks"),
        (5, "xml_structured", "xml_tree", [], "structured_data_document", "xml_tree"),
        (6, "generic_document", None, [], "general_text_document", "flat_blocks"),
    ]
    given = frame(spark, rows, "id int, archetype string, mode string, kinds array<string>, domain string, structure string")
    made = given.select("id", "domain", "structure", classify.domain(F.col("archetype"), F.col("mode"), F.col("kinds")).alias("d"), classify.primary_structure(F.col("mode"), F.col("kinds")).alias("s"))
    assert [(r["id"], r["d"], r["s"]) for r in made.orderBy("id").collect()] == [(r[0], r[4], r[5]) for r in rows]
