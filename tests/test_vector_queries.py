"""Searches with vectors of chunks of documents, against brute force over embed_plain."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arandu.functions.values import LEAST_COSINE, RERANK_WEIGHTS
from arandu.operators.vectors import embed_many, embed_plain
from arandu.plans import queries as Q
from arandu.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chunks(spark):
    """By (document, group): the row, its text score without a filter, and its vector from a context put together here."""
    rows = {(r["doc_id"], r["grp"]): r for r in Q.line_chunks(spark, SF).collect()}
    context = lambda r: " | ".join([r["heading"], r["heading"], r["heading"], r["file_name"], "generic document", " ".join(r["text"].split())])
    return {k: (r, embed_plain(context(r))) for k, r in rows.items()}


def cosine(a, b):
    return round(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)))), 6) if a and b else 0.0


def test_candidates_by_cosine(spark, chunks):
    asked = embed_plain(Q.TOPIC)
    lexical = {(r["doc_id"], r["grp"]): r["text_score"] for r in QUERIES["hybrid_candidates"](spark, SF).collect()}
    near = {k: cosine(v, asked) for k, (r, v) in chunks.items() if r["file_type"] == "en"}
    got = {(r["doc_id"], r["grp"]): (r["text_score"], r["vector_score"]) for r in QUERIES["hybrid_candidates_vectors"](spark, SF).collect()}
    assert set(got) == set(lexical) | {k for k, c in near.items() if c >= LEAST_COSINE}
    assert all(text == lexical.get(k, 0) and c == pytest.approx(near[k], abs=2e-6) for k, (text, c) in got.items())
    assert any(c > 0 for _, c in got.values())


def test_rerank_counts_the_cosine(spark, chunks):
    top = QUERIES["rerank_generic_vectors"](spark, SF).collect()
    asked, weight = embed_plain(Q.TOPIC), RERANK_WEIGHTS["generic"]["vector"]
    plain = Q.retrieval.rerank(Q.retrieval.hybrid_candidates(Q.line_chunks(spark, SF), Q.TOPIC, profile="generic"), Q.TOPIC, 1_000_000, "generic")
    scores = {k: 0.0 for k in chunks} | {(r["doc_id"], r["grp"]): r["score"] for r in plain.collect()}
    whole = {k: s + weight * max(0.0, cosine(chunks[k][1], asked)) for k, s in scores.items() if s}
    assert [r["score"] for r in top] == pytest.approx(sorted(whole.values(), reverse=True)[:6], abs=2e-3)
    assert all(whole[r["doc_id"], r["grp"]] == pytest.approx(r["score"], abs=2e-3) for r in top)
    refs = [r["reference"] for r in sorted(QUERIES["grounding_vectors"](spark, SF).collect(), key=lambda r: r["id"])]
    assert [x.rsplit(" | ", 1)[1] for x in refs] == [f"{r['doc_id']}_{r['grp']}" for r in top]


def test_many_queries_with_cosines(spark, chunks):
    got = QUERIES["multi_query_search_vectors"](spark, SF).collect()
    assert len(got) == 9
    for r in got:
        assert r["vector_score"] == pytest.approx(cosine(chunks[r["doc_id"], r["grp"]][1], embed_plain(Q._MANY[r["n_query"]])), abs=2e-6)


def test_many_queries_embed_what_can_be_among_the_best(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(text, size):
        @F.pandas_udf("array<double>")
        def vectors(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return pd.Series(embed_many(list(texts), size), dtype=object)

        return vectors(text)

    monkeypatch.setattr(Q.retrieval, "embed", counted)
    rows, names = Q.chunk_contexts(spark, SF).where("doc_id < 30").drop("locator_path"), ["n", "rank", "chunk_id", "text_score", "vector_score"]
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    number = rows.count()
    for column in ({}, {"heading": F.lit("x"), "text": F.concat("text", F.lit("x" * 900))}):  # without a length that fits, few have a text score
        own = rows.withColumns(column)
        stored = own.withColumn("vector", Q.vectors.embed("context"))
        for queries, limit, most in ((Q._MANY, 3, number // 5), (["qqqq", "der und"], 3, number), (Q._MANY, number + 1, number)):
            monkeypatch.setattr(Q.retrieval, "MOST_NAMED", 5 if column else 1_000)
            before = seen.value
            got = [tuple(r[n] for n in names) for r in Q.retrieval.search_many(own, queries, limit, "generic", embed_size=192).select(*names).collect()]
            whole = [tuple(r[n] for n in names) for r in Q.retrieval.search_many(stored, queries, limit, "generic").select(*names).collect()]
            assert sorted(got) == sorted(whole) and got and 0 < seen.value - before <= most


def test_vectors_and_reuse_of_chunks(spark, chunks):
    got = {r["chunk_id"]: r["v"] for r in QUERIES["embed_hash_chunks"](spark, SF).collect()}
    assert got == {f"{d}_{g}": v for (d, g), (_, v) in chunks.items()}
    reused = {r["chunk_id"]: r["reused"] for r in QUERIES["embedding_reuse_chunks"](spark, SF).collect()}
    assert reused == {f"{d}_{g}": d % 2 == 0 and d % 3 != 0 and v is not None for (d, g), (_, v) in chunks.items()}
