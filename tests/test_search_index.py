"""Searches through the stored index give the rows of the scan."""

import pytest
from pyspark.sql import functions as F

from arandu.operators import retrieval, search_index
from arandu.operators.search_index import SearchIndex
from arandu.plans import fixtures as fx
from arandu.plans.queries import line_chunks

SF = "/root/testdata/sf0.001"
QUERIES = ["the thing and of", "42", "a", "straße thethe", "doc_17", "--", ""]


@pytest.fixture(scope="module")
def records(spark):
    legal = [(i, "doc_L", "txt", kind, heading, text, ["chunk", "block", "index", "metadata"][i % 4]) for i, (_, _, kind, heading, text, *_) in enumerate(fx.CHUNKS)]
    legal += [(100 + i, "norma", "pdf", "legislation_normative", t, t, "block") for i, t in enumerate(["Art. 156", "art. 156-A do imposto", "Art. 156-A", "imposto", "", "x" * 85, "156-a " * 9])]
    rows = spark.createDataFrame(legal, "seq long, file_name string, file_type string, archetype string, heading string, text string, source_kind string")
    lines = line_chunks(spark, SF).where("doc_id < 90").select((F.col("doc_id") * 1000 + F.col("grp") + 1000).alias("seq"), "file_name", "file_type", "archetype", "heading", "text", "source_kind")
    out = lines.unionByName(rows).withColumns({"title": F.col("heading"), "heading_path": F.array("heading"), "record_id": F.col("seq").cast("string")})
    return spark.createDataFrame(out.collect(), out.schema).repartition(3)


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    return SearchIndex(spark, str(tmp_path_factory.mktemp("index"))).build(records)


def both(index, records, query, filters, profile, limit=10):
    given = [[(r["record_id"], r["score"], r["score_breakdown"], r["snippet"]) for r in df.collect()] for df in (index.search(query, filters, limit, profile), retrieval.search_records(records, query, filters, limit, profile))]
    assert given[0] == given[1], (query, filters, profile)
    return given[0]


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_the_scan(index, records, query):
    both(index, records, query, {"file_type": ["en", "fr"]} if len(query) % 2 else None, "generic")


@pytest.mark.parametrize("query", ["imposto art. 156-A", "portos zzzz"])
def test_index_equals_the_scan_for_references(index, records, query):
    assert both(index, records, query, None, "legal")
    both(index, records, query, {"file_name": "norma"}, "legal", limit=3)


@pytest.mark.parametrize("query", ["the thing and of", "imposto art. 156-A"])
def test_every_way_of_the_index_gives_the_same(index, records, query, monkeypatch):
    for name, value in (("FEW_POSTINGS", 10), ("TAKEN", 12), ("FIRST_BLOCKS", 1), ("MOST_NAMED", 3)):
        monkeypatch.setattr(search_index, name, value)
    both(index, records, query, None, "legal")
    monkeypatch.setattr(search_index, "MOST_WORDS", 2)
    both(index, records, query, {"file_type": "en"}, "generic")


def test_plan_reads_the_postings_of_the_query(index):
    postings, few = index._postings(["zzzz"], [])
    assert few and postings.count() == 0
    plan = index._postings(["schiffahrt", "42"], [])[0]._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0] and "word" in plan.split("PushedFilters: [")[1].split("]")[0]
    rows = index.rows_of([5])._jdf.queryExecution().toString()
    assert "row_part" in rows.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(row_key,5)" in rows


def test_index_of_an_empty_table(spark, records, tmp_path):
    empty = SearchIndex(spark, str(tmp_path)).build(records.limit(0))
    assert empty.search("the", profile="generic").count() == 0


@pytest.mark.parametrize("name", ["search_topk_generic", "search_topk_filtered"])
def test_one_search_builds_no_index(spark, name, monkeypatch):
    from arandu.plans import queries as Q
    from arandu.plans.registry import QUERIES as named

    monkeypatch.setattr(Q, "_INDEXES", {})
    scanned = named[name](spark, SF).collect()
    assert not Q._INDEXES and len(scanned) == 10
    index = Q.chunk_index(spark, SF)
    monkeypatch.setattr(Q, "line_chunks", None)  # what is built is used
    assert named[name](spark, SF).collect() == scanned and list(Q._INDEXES.values()) == [index]
