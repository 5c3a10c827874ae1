"""What keeps the work of a query in proportion to its input."""

from pyspark.sql import functions as F

from arandu.functions.plain import tokens_plain
from arandu.plans import queries as Q
from arandu.plans.registry import QUERIES
from arandu.sources import files, ocr

SF = "/root/testdata/sf0.001"


def test_parsed_files_leave_a_worker_in_pieces(spark):
    rows = ({"status": "ok", "error": None, "mode": "m", "root_tag": None, "transaction_count": None, "stats": {}, "blocks": [{}] * (i % 900)} for i in range(3000))
    pieces = [sum(len(b) + 1 for b in piece["blocks"]) for piece in files.in_pieces(rows)]
    assert max(pieces) < files.HELD_BLOCKS + 900 and sum(pieces) == sum(i % 900 + 1 for i in range(3000))
    data = spark.range(2500).select("id", F.concat(F.lit("a\nb "), F.col("id").cast("string")).cast("binary").alias("c")).coalesce(1)
    got = data.select("id", files.parse_column(F.col("c"), F.when(F.col("id") % 7 == 0, "none").otherwise("txt")).alias("p")).collect()
    assert all(r["p"]["status"] == ("skipped" if r["id"] % 7 == 0 else "ok") for r in got)
    assert all([b["text"] for b in r["p"]["blocks"]] == ["a", f"b {r['id']}"] for r in got if r["id"] % 7)


def test_a_search_counts_each_word_once(spark):
    for name in ("search_topk_scan", "rerank_generic", "grounding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == len(tokens_plain(Q.TOPIC)), name


def test_a_query_of_frequent_words_reads_the_indexed_rows(spark, tmp_path, monkeypatch):
    from arandu.operators import retrieval, search_index

    rows = Q.line_chunks(spark, SF).withColumns({"title": F.col("heading"), "record_id": F.col("chunk_id")})
    index = search_index.SearchIndex(spark, str(tmp_path)).build(rows)
    monkeypatch.setattr(search_index, "FEW_POSTINGS", 10)
    assert index.candidates(Q.TOPIC, None, 10, "generic") is None
    names = ["doc_id", "grp", "score"]
    expected = [tuple(r[n] for n in names) for r in retrieval.search_records(rows, Q.TOPIC, limit=10, profile="generic").collect()]
    for share in (search_index.SCANNED, 1_000_000):  # by the rows, by the postings
        monkeypatch.setattr(search_index, "SCANNED", share)
        assert [tuple(r[n] for n in names) for r in index.search(Q.TOPIC, None, 10, "generic").collect()] == expected


def test_only_amending_acts_reach_python(spark):
    from arandu.operators import structure
    from arandu.plans import table_queries

    plan = structure.index_entries(table_queries.acts(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    call = plan[plan.index("levels(") :]
    assert call.startswith("levels(CASE WHEN") or "CASE WHEN" in call[:200]


def test_words_of_lines_are_not_shuffled(spark):
    from arandu.plans import table_queries  # noqa: F401  registers them

    grouped, counted = (QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString() for name in ("ocr_line_grouping", "ocr_stats"))
    assert "Exchange" not in grouped and "collect_list" not in counted


def test_adjacent_words_give_the_lines_of_words_anywhere(spark):
    def word(key, i):
        text = [None, "", "  ", " a ", "é\u00a0", "zz", "b"][(i * 5 + (key or 0)) % 7]
        conf = [None, -1.0, 0.5, 96.0, 1.0, 13.0, 0.0][(i * 3) % 7]
        return (None if i // 9 == 1 else i // 40, 1, 1, i // 9, None if i % 8 == 5 else (i * 7) % 5, text, conf, None if key == 3 else i * 3 % 50, i % 4, 7, None if key == 3 else i % 6)

    results = [(key, "x" if key else None, [word(key, i) for i in range(n)]) for key, n in ((None, 30), (0, 0), (1, 1), (2, 100), (3, 25), (4, 7))]
    fields = "page int, block int, par int, line int, seq int, text string, conf double, left int, top int, width int, height int"
    rows = spark.createDataFrame(results, f"key int, name string, words array<struct<{fields.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double')}>>")
    words = rows.select("key", "name", F.inline("words"))
    expected = sorted(map(repr, ocr.group_words(words, "key", "name").collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for most in ("1", "4", before):  # lines end in a later batch, or many are in one
            spark.conf.set(size, most)
            assert sorted(map(repr, ocr.group_adjacent_words(words, "key", "name").collect())) == expected and len(expected) > 20
    finally:
        spark.conf.set(size, before)
    assert ocr.group_adjacent_words(words.where("key = 0"), "key").collect() == []
