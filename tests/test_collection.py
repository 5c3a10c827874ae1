import io
import json
import zipfile

from pyspark.sql import functions as F

from arandu.cli import parser
from arandu.collection import Collection
from arandu.config import read_env, settings
from arandu.operators import records, retrieval
from arandu.operators.answers import answer, citations, service_url
from arandu.plans.queries import _line_records
from arandu.sinks.writers import json_text, report_html, result_lines
from arandu.sources.ocr import ProviderUnavailable, cloud_language, read_image, tesseract_languages
from arandu.sources.parsers import parse_docx, parse_xlsx
from arandu.streaming.ingest import ingest


def xlsx() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Um" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>nome</t></is></c><c r="C1"><v>3</v></c></row><row r="3"><c r="B3" s="1"><v>45000</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def docx() -> bytes:
    out, w = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Título do texto', 'T1')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('um parágrafo simples.')}</w:body></w:document>")
    return out.getvalue()


def test_office_files():
    book = parse_xlsx(xlsx())
    assert [(b["kind"], b["text"]) for b in book.blocks] == [("sheet", "Sheet Um"), ("sheet_row", "nome | 3"), ("sheet_row", "2023-03-15T00:00:00")]
    doc = parse_docx(docx())
    assert [(b["kind"], b["text"]) for b in doc.blocks] == [("heading", "Título do texto"), ("table", "a | b"), ("paragraph", "um parágrafo simples.")]


def test_ocr(spark):
    df = spark.createDataFrame([("pt,en, pt-br",), ("",), ("en_us",)], "h string")
    assert [tuple(r) for r in df.select(tesseract_languages(F.col("h")), cloud_language(F.col("h"))).collect()] == [("por+eng", "pt"), ("por+eng", None), ("eng", "en")]

    def down(_):
        raise ProviderUnavailable("off")

    assert read_image(b"", {"azure_vision": down, "tesseract": lambda _: [{"text": "x"}]})[0] == "tesseract"


def test_collection_end_to_end(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    (source / "sub").mkdir(parents=True)
    (source / "lei.txt").write_text("LEI N. 1\nTrata de taxas.\nCAPÍTULO I\nDas taxas\nArt. 1º A taxa é anual.\n§ 1º Há multa.\nArt. 156-A O imposto é devido por barco.\n")
    (source / "sub" / "t.csv").write_text("a,b\n1,2\n")
    (source / "bad.xml").write_text("<a>")
    (source / "x.bin").write_text("?")
    (source / ".gitkeep").write_text("")
    c = Collection(spark, folder)
    assert c.ingest(str(source), embeddings=True) == {"ok": 2, "failed": 1, "skipped": 1}
    assert c.is_collection() and c.table("catalog").count() == 2
    top = c.query("imposto 156-A").first()
    assert top["heading"].startswith("Art. 156-A") and top["retrieval_mode"] == "hybrid"
    assert c.search("taxa", {"file_type": "csv"}).where("file_type <> 'csv'").count() == 0
    n = c.table("chunks").count()
    assert c.build_embeddings() == {"embedding_count": n, "reused_count": n, "built_count": 0}
    assert c.build_embeddings(force=True)["built_count"] == n
    found = c.answer("imposto 156-A", lambda instructions, prompt: "É devido [1].")
    assert found.status == "ok" and [x["id"] for x in found.citations] == [1]
    assert c.answer("imposto", None).status == "config_error"
    assert c.context("imposto")["total_hits"] <= 6


def plain_merging(keyed):
    """The rules of records.deduplicate over rows with their keys, by comparison of all classes."""
    classes = {}
    for r in sorted(keyed, key=lambda r: r["seq"]):
        classes.setdefault((r["_file"], r["_path"], r["_exact"]), []).append(r)
    long = {k: max((r["_long"] for r in rows), key=lambda x: (len(x), x)) for k, rows in classes.items()}
    groups = {}
    for k in classes:
        inside = [o for o in classes if o != k and o[:2] == k[:2] and o[2][:140] == k[2][:140] and min(len(long[o]), len(long[k])) >= 140 and long[o] in long[k]]
        groups.setdefault((*k[:2], min(inside, key=lambda o: (len(long[o]), o[2]))[2] if inside else k[2]), []).append(k)
    out = []
    for own in groups.values():
        rows = sorted((r for k in own for r in classes[k]), key=lambda r: r["seq"])
        best = max(rows, key=lambda r: (r["_priority"], r["_located"], r["_length"], r["_path_length"], -r["seq"]))
        text = max((r for r in rows if r["_priority"] >= best["_priority"] - 1), key=lambda r: (r["_length"], -r["seq"]))
        first = next(k for k in own if rows[0] in classes[k])
        filled = {c: best[c] or next((r[c] for r in rows if r[c]), best[c]) for c in records._FILLED}
        out.append((best["record_id"], text["text"] if text["_length"] > best["_length"] else best["text"], len(classes[first]) - 1, len(rows) - len(classes[first]), *map(str, filled.values())))
    return sorted(out)


def merged_rows(rows):
    got = records.deduplicate(rows)
    return sorted((r["record_id"], r["text"], r["exact_removed"], r["near_removed"], *(str(r[c]) for c in records._FILLED)) for r in got.collect())


def test_merging_equals_a_comparison_of_all_classes(spark):
    rows = _line_records(spark, "/root/testdata/sf0.001").where("seq < 6000000").withColumns({"record_id": F.col("seq").cast("string")}).withColumns({c: F.lit(None).cast("string") for c in ("position_text", "output_dir") if c not in _line_records(spark, "/root/testdata/sf0.001").columns})
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert merged_rows(rows) == plain_merging([r.asDict() for r in records.with_keys(rows).collect()])
    stats = records.dedup_stats(records.deduplicate(rows)).first()
    assert stats["raw_record_count"] == rows.count() and stats["deduplicated_record_count"] + stats["exact_duplicates_removed"] + stats["near_duplicates_removed"] == rows.count()


def test_merging_of_kinds_and_contained_texts(spark):
    import random

    rng, rows = random.Random(8), []
    base = ["".join(rng.choice("abcdefg ") for _ in range(330)).strip() for _ in range(4)] + ["ab" * 200, "short", ""]
    for i in range(240):
        text = rng.choice(base)
        text = text[: rng.choice([20, 139, 140, 150, 200, 239, 241, 300, 320, 330])] + rng.choice(["", "", "!", " tail"])
        rows.append((i, rng.choice(["block", "index", "metadata", "chunk", "catalog"]), f"r{i}", rng.choice(["f", "F"]), rng.choice([None, "txt"]), rng.choice(["", "a"]), "", "", rng.choice([[], ["p"]]), "p", text, rng.choice([None, "", "Art. 1"]), rng.choice([None, "Linha 2"]), rng.choice([None, "out"])))
    schema = "seq long, source_kind string, record_id string, file_name string, file_type string, archetype string, title string, heading string, heading_path array<string>, heading_path_text string, text string, locator_text string, position_text string, output_dir string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    found = merged_rows(df)
    assert found == plain_merging([r.asDict() for r in records.with_keys(df).collect()])
    assert len(found) < 120 and any(r[3] for r in found) and records.deduplicate(df.limit(0)).count() == 0


def test_filters_never_add_rows(spark):
    rows = spark.createDataFrame([("txt", "a", "x"), ("csv", "b", "y"), (None, "a", "x")], "file_type string, archetype string, file_name string")
    assert rows.where(retrieval.matches(None)).count() == 3
    assert rows.where(retrieval.matches({"file_type": ["txt", "csv"], "archetype": ""})).count() == 2
    assert rows.where(retrieval.matches({"file_type": "TXT"})).count() == 0


def test_answers():
    items = [{"id": 1, "reference": "r1"}, {"id": 2, "reference": "r2"}]
    assert [c["id"] for c in citations("x [2] y [2] z [9]", items)] == [2] and len(citations("x", items)) == 2
    assert answer("q", [], None).status == "no_context"
    assert answer("q", items, lambda i, p: 1 / 0).status == "provider_error"
    assert service_url("https://h/openai/") == "https://h/openai/v1/" and service_url("https://h") == "https://h/openai/v1/" and service_url(None) == ""


def test_settings_and_cli():
    assert read_env("# c\nA=1\nB = 'x'\nC") == {"A": "1", "B": "x"}
    assert settings({"ARANDU_OCR_PROVIDER": " tesseract "}).ocr_provider == "tesseract" and settings({}).missing_for_answers()
    args = parser().parse_args(["x", "--query", "q", "--no-build-search", "--ranking-profile", "generic"])
    assert args.limit == 6 and args.build_search is False and args.build_chunks is True


def test_sinks():
    assert json.loads(json_text({"á": 1})) == {"á": 1} and "\n" not in json_text({"a": [1]}, "chunks")
    assert result_lines([]) == "Nenhum resultado."
    assert "block_0001" in report_html("t", [{"pos": 1, "kind": "line", "label": "Linha", "title": None, "text": "<x>"}], [{"kind": "line", "count": 1}])


def test_stream_reads_each_file_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.txt").write_text("um")
    ingest(spark, str(inbox), out, mark, "b1").awaitTermination()
    (inbox / "b.txt").write_text("dois")
    ingest(spark, str(inbox), out, mark, "b2").awaitTermination()
    assert sorted((r["file_name"], r["batch"]) for r in spark.read.parquet(out).collect()) == [("a.txt", "b1"), ("b.txt", "b2")]


def test_outputs_of_a_collection(spark, tmp_path, capsys):
    source, folder = tmp_path / "in", str(tmp_path / "cols" / "20300101_c")
    source.mkdir()
    (source / "a.txt").write_text("LEI N. 1\nTrata de taxas.\nArt. 1º A taxa é anual.\nArt. 2º O imposto é devido por barco.\n")
    (source / "b.csv").write_text("nome,valor\nporto,3\n")
    c = Collection(spark, folder)
    assert c.ingest(str(source)) == {"ok": 2}
    rows = {json.loads(r["metadata"])["file_name"]: r for r in c.table("payloads").collect()}
    content, index = json.loads(rows["a.txt"]["content"]), json.loads(rows["a.txt"]["index"])
    assert json.loads(rows["a.txt"]["metadata"])["block_count"] == len(content) == 3 and [b["block_id"] for b in content] == ["block_0001", "block_0002", "block_0003"]
    assert content[1]["reference"].startswith("Art. 1º") and index[1]["anchor"] == "block_0002"
    assert rows["a.txt"]["ai_context"].startswith("# a.txt\n\nTipo: txt | Arquétipo: legislation_normative") and "O imposto é devido por barco." in rows["a.txt"]["ai_context"]
    pages = {r["html"][: r["html"].index("</h1>")]: r["html"] for r in c.table("reports").collect()}
    assert len(pages) == 2 and any('id="block_0003"' in p and "Artigo: Art. 2º" in p for p in pages.values())
    assert "a.txt" in (tmp_path / "cols/20300101_c/summary.md").read_text() and "<table>" in (tmp_path / "cols/20300101_c/report.html").read_text()
    assert json.loads((tmp_path / "cols/20300101_c/preview.json").read_text())
    meta = c.table("metadata").first()
    assert (meta["file_count"], meta["state"]) == (2, "not_built")
    c.context("imposto", persist=True)
    assert json.loads((tmp_path / "cols/20300101_c/query_results.json").read_text())["total_hits"] >= 1
    fs, path = c._at("chunks")
    ids = sorted(r["chunk_id"] for r in c.table("chunks").collect())
    fs.delete(path, True)
    assert sorted(r["chunk_id"] for r in c.ensure_chunks().collect()) == ids
    from arandu.cli import main

    assert main([str(tmp_path / "cols"), "--latest", "--query", "imposto por barco", "--answer"], model=lambda i, p: "Por barco [1].") == 0
    assert "status: ok" in capsys.readouterr().out
    assert "Por barco [1]." in (tmp_path / "cols/20300101_c/answer_results.md").read_text()


def test_files_added_to_a_collection(spark, tmp_path):
    from arandu.streaming.ingest import follow

    source, folder, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.txt").write_text("um texto sobre portos\n")
    follow(spark, str(source), folder, mark).awaitTermination()
    (source / "b.txt").write_text("outro texto sobre canais\ne mais uma linha\n")
    follow(spark, str(source), folder, mark).awaitTermination()
    c = Collection(spark, folder)
    assert sorted((r["file_name"], r["seq"]) for r in c.table("documents").collect()) == [("a.txt", 1), ("b.txt", 2)]
    assert sorted(r["chunk_id"] for r in c.table("chunks").collect()) == ["chunk_00001", "chunk_00002"]
    assert c.search("canais").first()["file_name"] == "b.txt" and c.table("metadata").first()["file_count"] == 2
    (source / "a.txt").write_text("um texto novo sobre lagoas\n")
    from arandu.sources.files import parse_files, scan

    c.add(parse_files(scan(spark, str(source / "a.txt"))))
    assert c.table("documents").count() == 2 and c.search("lagoas").first()["file_name"] == "a.txt"
    terms = [r["score_breakdown"] for r in c.search("portos").collect()]
    assert all(set(t) <= {"length_fit", "length_penalty"} for t in terms), "records without the word may score by their length alone"
    assert c.table("search_records").where("contains(text, 'portos')").count() == 0
    assert c.table("files").count() == 2 and c.table("payloads").count() == 2


def test_adding_equals_deriving_all_and_keeps_old_files(spark, tmp_path):
    from arandu.sources.files import parse_files, scan

    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"d{i}.txt").write_text(f"um texto {i} sobre portos\ne canais\n")
    c = Collection(spark, str(tmp_path / "one"))
    c.ingest(str(source))
    files = lambda name: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "one" / name).glob("part-*")}
    before = {name: files(name) for name in ("documents", "blocks", "entries", "chunks", "search_records", "payloads", "reports")}
    (source / "e.txt").write_text("outro texto\n")
    c.add(parse_files(scan(spark, str(source / "e.txt"))))
    for name, own in before.items():
        assert own.items() <= files(name).items(), f"{name}: the others' files stand as they were"
    whole = Collection(spark, str(tmp_path / "two"))
    whole.ingest(str(source))
    for name, columns in (("documents", ["source_path", "archetype"]), ("blocks", ["doc_id", "pos", "text"]), ("entries", ["doc_id", "pos", "title"]), ("search_records", ["source_kind", "file_name", "title", "exact_removed", "near_removed"]), ("payloads", ["doc_id", "content"]), ("reports", ["doc_id"]), ("chunks", ["doc_id", "text"])):
        assert sorted(map(str, c.table(name).select(columns).collect())) == sorted(map(str, whole.table(name).select(columns).collect())), name
    assert c.table("metadata").first()["file_count"] == whole.table("metadata").first()["file_count"] == 3


def test_replacing_a_table_survives_a_lost_driver(spark, tmp_path):
    c = Collection(spark, str(tmp_path))
    c.save("t", spark.range(3))
    c.replace("t", c.table("t").where("id > 0"))
    assert c.table("t").count() == 2
    spark.range(9).write.parquet(f"{tmp_path}/_t_new")  # lost after the new table was whole, before or after the old one went
    fs, old = c._at("t")
    fs.delete(old, True)
    assert c.has("t") and c.table("t").count() == 9
    spark.range(5).write.parquet(f"{tmp_path}/_t_new")
    fs.delete(c._at("_t_new/_SUCCESS")[1], True)  # lost before it was whole
    assert c.table("t").count() == 9 and c.replace("t", spark.range(4)).count() == 4


def test_records_without_a_word_score_by_their_length_and_archetype_alone(spark):
    rows = [(f"r{n}", "t" * 3, "x" * n, a) for n, a in ((10, "generic_document"), (60, "generic_document"), (80, "generic_document"), (900, "generic_document"), (1000, "manual_procedural"), (1500, "manual_procedural"), (85, "judicial_case"))]
    df = spark.createDataFrame(rows, "record_id string, title string, text string, archetype string").withColumns({"file_name": F.lit("f"), "file_type": F.lit("txt"), "heading_path": F.array(F.lit("h")), "source_kind": F.lit("block")})
    found = {p: {r["record_id"]: r["score"] for r in retrieval.search_records(df, "zzz", profile=p).collect()} for p in ("legal", "generic")}
    assert found["legal"] == {"r80": 2, "r900": 2, "r1000": 1, "r85": 3} and found["generic"] == {"r80": 2, "r900": 2, "r85": 2}


def test_output_names_of_one_stem(spark):
    from arandu.operators.numbering import numbered
    from arandu.sinks.writers import output_dirs

    docs = spark.createDataFrame([(i, "a b" if i % 2 else "c") for i in range(1, 60)], "seq long, file_stem string")
    got = {r["seq"]: r["output_name"] for r in output_dirs(docs).collect()}
    assert got == {i: ("a_b" if i % 2 else "c") + ("" if (i - 1) // 2 == 0 else f"_{(i - 1) // 2 + 1}") for i in range(1, 60)}
    rows = numbered(docs.withColumn("n", F.lit(3)), ["seq"], "start", "n").collect()
    assert all(r["start"] == 3 * (r["seq"] - 1) for r in rows)


def test_records_against_an_independent_fold(spark):
    """The rules, read line by line with plain lists: signature equal, or the beginning equal and one signature in the other."""
    rows = _line_records(spark, "/root/testdata/sf0.001").orderBy("seq").limit(1500)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    keyed = [r.asDict() for r in records.with_keys(rows).orderBy("seq").collect()]
    groups: dict[tuple, list[dict]] = {}
    for r in keyed:
        own = groups.setdefault((r["_file"], r["_path"], r["_exact"][:140]), [])
        same = [k for k in own if r["_exact"] in k["seen"]]
        last = own[-1] if own else None
        short, long = sorted((last["long"], r["_long"]), key=len) if last else ("", "")
        if same:
            kept = same[0]
            kept["seen"].append(r["_exact"])
        elif last and short and (short == long or (len(short) >= 48 and short in long)):
            kept = last
        else:
            own.append({"seen": [r["_exact"]], "long": r["_long"], "n": 1})
            continue
        kept["n"] += 1
    stats = records.dedup_stats(records.deduplicate(rows)).first()
    assert stats["raw_record_count"] == 1500 and stats["deduplicated_record_count"] == sum(map(len, groups.values()))


def test_a_chat_service(tmp_path):
    from arandu.operators.answers import service_model

    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, json.loads(request.data), request.headers))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "sim [1]"}}]}).encode())

    assert service_model("https://h/openai", "k", "m", opener=opener)("regras", "pergunta") == "sim [1]"
    assert asked[0][0] == "https://h/openai/v1/chat/completions" and asked[0][1]["model"] == "m" and asked[0][1]["messages"][1]["content"] == "pergunta"
