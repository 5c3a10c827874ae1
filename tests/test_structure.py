import random

from test_inline_rows import CASES, legal_documents

from arandu.operators import structure
from arandu.operators.blocks import legal_blocks, manual_blocks
from arandu.operators.lines import Line, looks_legal, looks_manual, manual, normative
from arandu.plans import fixtures as fx
from arandu.sources.pages import blocks_of_pages, page_lines, question
from arandu.sources.parsers import parse_csv, parse_html, parse_ofx, parse_txt, parse_xml


def plain_parents(levels):
    stack, out = [], []
    for pos, level in levels:
        while stack and stack[-1][1] >= level:
            stack.pop()
        out.append((pos, stack[-1][0] if stack else None, [p for p, _ in stack]))
        stack.append((pos, level))
    return out


def test_parents_equal_a_stack(spark):
    rng = random.Random(4)
    docs = {d: [(p, rng.randint(1, 19)) for p in range(1, 40)] for d in range(6)}
    rows = spark.createDataFrame([(d, p, lv, f"t{p}") for d, ls in docs.items() for p, lv in ls], "doc_id int, pos int, level int, title string")
    got = {(r["doc_id"], r["pos"]): r for r in structure.parents(rows).collect()}
    for d, ls in docs.items():
        expected = plain_parents(ls)
        for pos, parent, above in expected:
            r = got[d, pos]
            assert r["parent_pos"] == parent and r["ancestors"] == above
            below = [p for p, _, a in expected if pos in a]
            assert r["last_pos"] == max([pos, *below])


def test_legal_document_has_its_structure():
    blocks = legal_blocks([Line(t, start=p, end=p) for d, p, t in fx.LINES if d == 1])
    kinds = [b["kind"] for b in blocks]
    assert kinds == ["preamble", "part", "book", "title", "chapter", "section", "article", "legal_paragraph", "inciso", "alinea", "item", "legal_paragraph", "article", "article", "chapter", "article"]
    assert blocks[4]["title"] == "Capítulo I - Da incidência"
    item = next(b for b in blocks if b["kind"] == "item")
    assert item["locator"]["alinea"] == "Alínea a" and item["locator"]["article"] == "Art. 1º"
    third = blocks[13]
    assert third["title"] == "Art. 3º" and "art. 156-A desta Lei" in third["text"]
    assert all(b["locator"]["line_end"] >= b["locator"]["line_start"] for b in blocks)


def test_mentions_are_no_articles():
    assert normative("Art. 108 desta Lei") is None
    assert normative("art. 3º Texto") is None
    assert normative("Art. 3º Texto próprio.").kind == "article"
    assert normative("1. item") is None and normative("1. item", context={"article": "Art. 1"}).kind == "item"
    assert normative("mil - coisas").kind == "inciso"


def test_document_kinds():
    assert looks_legal([t for d, _, t in fx.LINES if d == 1]) and not looks_legal([t for d, _, t in fx.LINES if d == 3])
    assert looks_manual(["Manual do Sistema", "Objetivo", "1. Entrar", "Clique no botão"]) and not looks_manual(["um texto comum.", "outro texto."])


def test_manual_levels_and_groups():
    lines = ["Manual do Porto", "Objetivo", "Descrever o uso do porto.", "ETAPA 1 - Entrada", "Clique em entrar", "a) primeiro item", "Portal do Porto", "ETAPA 2 - Saída", "Texto final do manual."]
    blocks = manual_blocks([Line(t, start=i, end=i) for i, t in enumerate(lines, 1)])
    heads = [(b["title"], b["heading_level"], b["heading_group"]) for b in blocks if b["kind"] == "heading"]
    assert heads == [("Manual do Porto", 1, "document_title"), ("Objetivo", 2, "marker"), ("Etapa 1 - Entrada", 3, "step"), ("Etapa 2 - Saída", 3, "step")]
    assert [b["manual_group"] for b in blocks if b["kind"] == "paragraph"] == ["body", "micro_action", "list_item", "interface_label", "body"]
    assert manual("2.1 Nome", last=1).level == 3


def test_amending_act_levels(spark):
    docs = legal_documents(spark)
    assert {r["doc_id"]: r["archetype"] for r in docs.select("doc_id", "archetype").collect()} == {1: "legislation_normative", 2: "legislation_amending_act", 3: "generic_document"}
    rows = CASES["legal_index"](spark, "").where("doc_id = 2").orderBy("pos").collect()
    levels = [(r["kind"], r["level"]) for r in rows]
    assert levels[0] == ("preamble", 1) and ("article", 15) in levels and levels[-1] == ("article", 8)
    by_pos = {r["pos"]: r for r in rows}
    quoted = [r for r in rows if r["level"] == 15]
    assert all(by_pos[r["parent_pos"]]["level"] == 8 for r in quoted)
    assert all(r["parent_pos"] is None or by_pos[r["parent_pos"]]["level"] < r["level"] for r in rows)


def test_legal_chunks(spark):
    rows = CASES["legal_chunks"](spark, "").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == [f"chunk_{i:05d}" for i in range(1, len(rows) + 1)]
    first = [r for r in rows if r["doc_id"] == 1]
    assert len(first) == 4 and first[0]["positions"] == "7,8,9,10,11,12"
    assert any(r["act_title"] for r in rows if r["doc_id"] == 2)


def test_sources():
    assert [b["kind"] for b in parse_csv(b"a,b\n1,2\n,\n3,").blocks] == ["table_header", "table_row", "table_row"]
    xml = parse_xml(b"<r>um<a>dois<b>tres</b></a>fim</r>")
    assert [b["text"] for b in xml.blocks] == ["um", "dois", "fim", "tres"] and xml.root_tag == "r"
    html = parse_html(b"<title>T</title><h2>H</h2><ul><li>x <p>y</p></li></ul><script>no</script>")
    assert [(b["kind"], b["text"], b["heading_level"]) for b in html.blocks] == [("paragraph", "T", None), ("heading", "H", 2), ("list_item", "x y", None), ("paragraph", "y", None)]
    ofx = parse_ofx(fx.OFX[0][1].encode())
    assert ofx.transactions == 203 and len(ofx.blocks) == 200
    assert parse_txt(b"").blocks == [] and parse_txt("á\n\n  b ".encode()).blocks[1]["locator"]["line_start"] == 3


def test_pages():
    assert page_lines("12\nPágina Inicial\nTexto\n" + "-" * 30) == [(3, "Texto")]
    assert question("Como pagar a taxa anual do porto? Assim.")[2] == "Como pagar a taxa anual do porto?"
    assert blocks_of_pages(["Como pagar a taxa anual do porto? No portal."])[1] == "structured_faq"
    assert blocks_of_pages(["um texto", "", "outro texto"])[1] == "page_text"
    assert len(blocks_of_pages(["um texto", "", "outro texto"])[0]) == 2
