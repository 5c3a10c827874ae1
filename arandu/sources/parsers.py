"""Parsers from a file's bytes to blocks. Each returns a Parsed; a parser that fails raises, and the caller keeps the error."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

from ..functions.plain import shortened_plain, squeeze_plain
from ..functions.text import LOCATOR_KEYS
from ..functions.values import OFX_BLOCKS
from ..operators.blocks import Block, block, legal_blocks, locator, manual_blocks, numbered, plain_blocks
from ..operators.lines import Line, enter, looks_legal, looks_manual, paragraph
from .pages import blocks_of_pages, prefers_manual


@dataclass
class Parsed:
    blocks: list[Block]
    mode: str | None = None
    root_tag: str | None = None
    transactions: int | None = None
    stats: dict[str, Any] = field(default_factory=dict)


def decoded(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


def _line(i: int, text: str, **more: Any) -> Line:
    return Line(text, start=i, end=i, **more)


def _legal_or(lines: list[Line], other: Callable[[], list[Block]], mode: str) -> tuple[list[Block], str]:
    return (legal_blocks(lines), "structured_legal") if looks_legal([x.text for x in lines]) else (other(), mode)


def parse_txt(content: bytes) -> Parsed:
    """A line for each line with text, by its number in the file."""
    raw = decoded(content).splitlines()
    lines = [_line(i, squeeze_plain(x)) for i, x in enumerate(raw, 1) if squeeze_plain(x)]
    blocks, mode = _legal_or(lines, lambda: plain_blocks(lines), "line_text")
    return Parsed(blocks, mode, stats={"line_count": len(raw)})


def row_text(cells: list[Any]) -> str:
    """Cells that are not blank, joined."""
    return squeeze_plain(" | ".join(str(c) for c in cells if c is not None and str(c).strip()))


def parse_csv(content: bytes) -> Parsed:
    """The first row is the header; all rows with text are kept."""
    rows = list(csv.reader(io.StringIO(decoded(content), newline="")))
    texts = [row_text(r) for r in rows]
    lines = [_line(i, t, extra={"values": json.dumps(r, ensure_ascii=False)}) for i, (r, t) in enumerate(zip(rows, texts, strict=True), 1) if t]
    headed = bool(texts and texts[0]) and not looks_legal([x.text for x in lines])

    def table() -> list[Block]:
        out = []
        for x in lines:
            if x.start == 1:
                out.append(block("table_header", "Header", x.text, locator(x), extra={"columns": x.extra["values"]}))
            else:
                out.append(block("table_row", shortened_plain(x.text), x.text, locator(x), extra=x.extra))
        return numbered(out)

    blocks, mode = _legal_or(lines, table, "table_full")
    stats = {"row_count": len(rows), "non_empty_row_count": len(lines), "data_row_count": max(len(lines) - headed, 0), "column_count": max(map(len, rows), default=0), "header_present": headed}
    return Parsed(blocks, mode, stats=stats)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx_dates(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_SHEET}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)}
    styles = root.find(f"{_SHEET}cellXfs")
    return {i for i, x in enumerate([] if styles is None else styles) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}


def _xlsx_value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> Any:
    kind, value = cell.get("t", "n"), cell.find(f"{_SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "e", "d"):
        return value.text
    number = float(value.text)
    if int(cell.get("s", 0)) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=number)).isoformat()
    return int(number) if number.is_integer() and "." not in value.text else number


def xlsx_sheets(content: bytes) -> list[tuple[str, list[tuple[int, list[Any]]], int]]:
    """(name, [(row number, cells)], number of rows) of each sheet."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dates = _xlsx_dates(book)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        rows, last = [], 0
        for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            last = int(row.get("r") or last + 1)
            cells: list[Any] = []
            for cell in row.iter(f"{_SHEET}c"):
                at = _column(cell.get("r") or "") or len(cells) + 1
                cells += [None] * (at - 1 - len(cells)) + [_xlsx_value(cell, shared, dates)]
            rows.append((last, cells))
        out.append((sheet.get("name"), rows, last))
    return out


def parse_xlsx(content: bytes) -> Parsed:
    """A block for each sheet, then one for each row with text."""
    sheets, lines, counts = xlsx_sheets(content), [], []
    for name, rows, last in sheets:
        own = [_line(i, t, sheet=name, extra={"values": json.dumps(r, ensure_ascii=False)}) for i, r in rows if (t := row_text(r))]
        lines += own
        counts.append({"sheet_name": name, "row_count": last, "non_empty_row_count": len(own), "column_count": max((len(r) for _, r in rows), default=0)})

    def tables() -> list[Block]:
        out = []
        for c in counts:
            out.append(block("sheet", c["sheet_name"], f"Sheet {c['sheet_name']}", locator(Line("", sheet=c["sheet_name"])), max_row=c["row_count"], max_column=c["column_count"]))
            out += [block("sheet_row", shortened_plain(x.text), x.text, locator(x), extra=x.extra) for x in lines if x.sheet == c["sheet_name"]]
        return numbered(out)

    blocks, mode = _legal_or(lines, tables, "sheet_full")
    stats: dict[str, Any] = {"sheet_count": len(sheets), "sheet_names": json.dumps([n for n, _, _ in sheets], ensure_ascii=False)}
    if mode == "sheet_full":
        stats |= {"row_count": sum(c["row_count"] for c in counts), "non_empty_row_count": sum(c["non_empty_row_count"] for c in counts), "sheet_stats": json.dumps(counts, ensure_ascii=False)}
    return Parsed(blocks, mode, stats=stats)


def parse_xml(content: bytes) -> Parsed:
    """A node for each text and, right after it, each tail."""
    root, lines = ElementTree.fromstring(content), []
    for e in root.iter():
        for text, extra in ((e.text, {"tag": e.tag, "attributes": json.dumps(e.attrib, ensure_ascii=False)}), (e.tail, {"tag": f"{e.tag}:tail"})):
            if own := squeeze_plain(text):
                lines.append(_line(len(lines) + 1, own, extra=extra))
    blocks, mode = _legal_or(lines, lambda: plain_blocks(lines, "xml_node", lambda x: x.extra["tag"]), "xml_tree")
    return Parsed(blocks, mode, root_tag=root.tag, stats={"node_count": len(lines)})


class _Html(HTMLParser):
    """Texts of the title and of h1..h6, p and li elements in order of their starts; a nested one also counts for the outer."""

    TEXTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.nodes: list[tuple[str, list[str]]] = []
        self.stack: list[tuple[str, list[str] | None]] = []
        self.loose: list[str] = []

    def handle_starttag(self, tag: str, attrs: Any) -> None:
        if tag in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"):
            return
        own = None
        if tag in self.TEXTS:
            own = []
            self.nodes.append((tag, own))
        elif tag == "title" and self.title is None:
            own = self.title = []
        self.stack.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        open_tags = [t for t, _ in self.stack]
        if "script" in open_tags or "style" in open_tags or not data.strip():
            return
        for _, own in self.stack:
            if own is not None:
                own.append(data.strip())
        if "title" not in open_tags and "head" not in open_tags:
            self.loose.append(data.strip())


def html_lines(text: str) -> list[Line]:
    """The title, then headings, paragraphs and list items; texts of the body if there are none."""
    page = _Html()
    page.feed(text)
    page.close()
    title = squeeze_plain(" ".join(page.title or []))
    rows = [(title, "title", "h1")] if title else []
    nodes = [(squeeze_plain(" ".join(own)), tag, tag) for tag, own in page.nodes]
    rows += nodes if page.nodes else [(squeeze_plain(x), "text", None) for x in page.loose]
    return [_line(i, t, extra={"tag": tag}, style=style) for i, (t, tag, style) in enumerate([r for r in rows if r[0]], 1)]


def parse_html(content: bytes) -> Parsed:
    lines = html_lines(decoded(content))

    def plain() -> list[Block]:
        out = []
        for x in lines:
            tag = x.extra["tag"]
            if re.fullmatch(r"h\d", tag):
                out.append(block("heading", shortened_plain(x.text, 120), x.text, locator(x), heading_level=int(tag[1]), extra=x.extra))
            else:
                out.append(block("list_item" if tag == "li" else "paragraph", shortened_plain(x.text), x.text, locator(x), extra=x.extra))
        return numbered(out)

    blocks, mode = _legal_or(lines, plain, "structured_html")
    return Parsed(blocks, mode, stats={"has_title": any(x.extra["tag"] == "title" for x in lines)})


def _ofx_field(name: str, text: str) -> str:
    found = re.search(rf"<{name}>([^<\r\n]*)", text, re.IGNORECASE)
    return found[1].strip() if found else ""


def _ofx_date(raw: str) -> str:
    digits = re.match(r"\d{8}(\d{6})?", raw)
    return "" if not digits else datetime.strptime(digits[0].ljust(14, "0"), "%Y%m%d%H%M%S").isoformat(sep=" ")


def parse_ofx(content: bytes) -> Parsed:
    """The first transactions as blocks; their number is that of all."""
    text = decoded(content)
    found = re.findall(r"<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)", text, re.IGNORECASE | re.DOTALL)
    out = []
    for i, own in enumerate(found[:OFX_BLOCKS], 1):
        values = {"date": _ofx_date(_ofx_field("DTPOSTED", own)), "type": _ofx_field("TRNTYPE", own).lower(), "amount": _ofx_field("TRNAMT", own), "memo": _ofx_field("MEMO", own)}
        out.append(block("transaction", None, " | ".join(values.values()), locator(_line(i, "")), extra=values))
    return Parsed(numbered(out), transactions=len(found), stats={"bank_id": _ofx_field("BANKID", text), "account_id": _ofx_field("ACCTID", text)})


def parse_pages(pages: list[str]) -> Parsed:
    """Texts of a PDF's pages, one for each page; a page that failed is empty."""
    if not any(p.strip() for p in pages):
        raise ValueError("no page of the PDF has text")
    blocks, mode = blocks_of_pages(pages)
    return Parsed(blocks, mode, stats={"page_count": len(pages)})


def parse_pdf(content: bytes) -> Parsed:
    """Needs the optional package pypdf; without it, give page texts to parse_pages."""
    from pypdf import PdfReader  # not installed everywhere

    pages, layout, failed = [], 0, []
    for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        text = ""
        try:
            text = page.extract_text() or ""
        except Exception:  # noqa: BLE001  any fault of a page is kept as its number
            try:
                text = page.extract_text(extraction_mode="layout") or ""
                layout += 1
            except Exception:  # noqa: BLE001
                failed.append(i)
        pages.append(text)
    out = parse_pages(pages)
    out.stats |= {"fallback_pages": layout, "failed_pages": json.dumps(failed)}
    return out


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(e: ElementTree.Element) -> str:
    parts = {f"{_WORD}t": lambda x: x.text or "", f"{_WORD}tab": lambda x: "\t", f"{_WORD}br": lambda x: "\n"}
    return "".join(parts[x.tag](x) for x in e.iter() if x.tag in parts)


def docx_items(content: bytes) -> list[tuple[str, Any, str | None]]:
    """("paragraph", text, style) and ("table", rows of cells, None) in the order of the body."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = {}
    if "word/styles.xml" in book.namelist():
        for s in ElementTree.fromstring(book.read("word/styles.xml")).iter(f"{_WORD}style"):
            name = s.find(f"{_WORD}name")
            names[s.get(f"{_WORD}styleId")] = None if name is None else name.get(f"{_WORD}val")
    out: list[tuple[str, Any, str | None]] = []
    for e in ElementTree.fromstring(book.read("word/document.xml")).find(f"{_WORD}body"):
        if e.tag == f"{_WORD}p":
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            own = None if style is None else style.get(f"{_WORD}val")
            name = names.get(own, own) or "Normal"
            out.append(("paragraph", squeeze_plain(_docx_text(e)), re.sub("^heading", "Heading", name)))
        elif e.tag == f"{_WORD}tbl":
            out.append(("table", [[squeeze_plain(" ".join(_docx_text(p) for p in c.iter(f"{_WORD}p"))) for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")], None))
    return out


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs and tables in body order; legal, manual or plain."""
    items = list(enumerate(docx_items(content), 1))
    lines = [_line(i, text, style=style, extra={"style": style}) for i, (kind, text, style) in items if kind == "paragraph" and text]
    tables = [(i, rows) for i, (kind, rows, _) in items if kind == "table"]
    table_blocks = [block("table", f"Tabela {n}", "\n".join(" | ".join(r) for r in rows), locator(_line(i, "")), rows=len(rows)) for n, (i, rows) in enumerate(tables, 1)]
    texts = [x.text for x in lines]
    is_legal, is_manual = looks_legal(texts), looks_manual(texts)
    if is_legal and not (is_manual and prefers_manual(texts, titles_only=True)):
        blocks, mode = legal_blocks(lines), "structured_legal"
    elif is_manual:
        blocks, mode = manual_blocks(lines), "structured_manual"
    else:
        blocks, mode, context = [], "document_blocks", dict.fromkeys(LOCATOR_KEYS)
        for k, x in enumerate(lines):
            found = paragraph(x.text, x.style, lines[k + 1].text if k + 1 < len(lines) else None, context=context)
            enter(context, found)
            blocks.append(block(found.kind, found.title, x.text, locator(x, context=context), heading_level=found.level, label=found.label, extra=x.extra))
    ordered = sorted([*blocks, *table_blocks], key=lambda b: (b["locator"]["line_start"] is None, b["locator"]["line_start"] or 0))
    return Parsed(numbered(ordered), mode, stats={"paragraph_count": len(lines), "table_count": len(tables)})


def parse_ocr_lines(rows: list[dict[str, Any]], provider: str | None = None) -> Parsed:
    """Lines of an OCR result: text, page, line, confidence, box."""
    lines = []
    for i, r in enumerate(rows, 1):
        if text := squeeze_plain(r.get("text")):
            at = int(r.get("line") or i)
            extra = {k: json.dumps(r[k]) for k in ("confidence", "box") if r.get(k) is not None} | ({"ocr_provider": provider} if provider else {})
            lines.append(Line(text, int(r.get("page") or 1), None, at, at, extra=extra))
    blocks, mode = _legal_or(lines, lambda: plain_blocks(lines), "ocr_image")
    return Parsed(blocks, mode, stats={"ocr_line_count": len(lines), "ocr_confident_line_count": sum("confidence" in x.extra for x in lines)})


#: A parser's name and its function of the bytes. Images need an OCR function; see sources.ocr.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {"txt": parse_txt, "csv": parse_csv, "xlsx": parse_xlsx, "xml": parse_xml, "html": parse_html, "ofx": parse_ofx, "pdf": parse_pdf, "docx": parse_docx}


