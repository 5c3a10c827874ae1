"""Writers of tables and reports. Tables go through Spark's writers; reports are made from rows that a search or a document bounds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html import escape
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_label, safe_name, slug
from ..operators.numbering import numbered

#: Artifacts written without indents.
COMPACT = ("chunks", "search_index", "embeddings_index", "content", "index", "master_index")


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object for each row, not ASCII-escaped, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_text(payload: Any, name: str = "") -> str:
    """JSON of a small payload: compact for COMPACT names, else indented."""
    if name in COMPACT:
        return json.dumps(payload, ensure_ascii=False, separators=(",", ":"))
    return json.dumps(payload, ensure_ascii=False, indent=2)


def output_dirs(documents: DataFrame, stem: str = "file_stem", order: str = "seq") -> DataFrame:
    """documents with output_name: the stem's safe form, then _2, _3 ... for those that come again, by order (which tells all
    documents apart). A stem of many documents is numbered by ranges, not in one task."""
    rows = documents.select(order, safe_name(stem).alias("_base"))
    own = numbered(rows, ["_base", order], "_number")
    firsts = own.groupBy("_base").agg((F.min("_number") - 1).alias("_before"))
    n = F.col("_number") - F.col("_before")
    named = own.join(firsts, "_base").select(order, F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), n.cast("string"))).alias("output_name"))
    return documents.join(named, order)


def document_markdown(documents: DataFrame, blocks: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, markdown: title, summary, outline and blocks of each document."""
    from ..operators.catalog import outline

    dump = F.concat(F.lit("### "), F.coalesce("display_title", "title", F.concat(F.lit("Bloco "), F.col("pos").cast("string"))), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    body = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", dump.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    rows = documents.join(body, key, "left").join(outline(entries, key, 200), key, "left")
    parts = [F.concat(F.lit("# "), "file_name"), F.col("summary") if "summary" in documents.columns else F.lit(None), F.concat(F.lit("## Índice\n\n"), F.col("outline")), F.concat(F.lit("## Conteúdo\n\n"), F.col("body"))]
    return rows.select(key, F.concat_ws("\n\n", *parts).alias("markdown"))


def result_lines(results: Sequence[Mapping[str, Any]]) -> str:
    """Ranked results for a console."""
    if not results:
        return "Nenhum resultado."
    out = []
    for i, r in enumerate(results, 1):
        place = r.get("locator_path") or r.get("position_text") or ""
        out.append(f"{i}. {r.get('file_name')} | {r.get('heading_path_text') or r.get('heading') or ''} | score={r.get('score')}" + (f" | {place}" if place else ""))
        out.append(f"   {r.get('snippet') or ''}".rstrip())
    return "\n".join(out)


def answer_lines(answer: Any) -> str:
    """An answer with its sources for a console."""
    sources = [f"[{c['id']}] {c['reference']}" for c in answer.citations]
    return "\n".join([f"status: {answer.status}", *([answer.error] if answer.error else []), answer.text, *(["Fontes:", *sources] if sources else [])]).strip()


def anchors(entries: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Index entries with the anchor of their block, null without one."""
    own = blocks.select(key, "pos", F.format_string("block_%04d", "pos").alias("anchor"))
    return entries.join(own, [key, "pos"], "left")


def deep_link(path: Column) -> Column:
    """Fragment of a structural path."""
    return F.concat(F.lit("#"), slug(path, "-", "trecho"))


def block_cards(blocks: DataFrame) -> DataFrame:
    """pos, kind, label, title, text of the blocks of a report."""
    return blocks.select("pos", "kind", F.coalesce(kind_label("kind"), F.lit("Bloco")).alias("label"), "title", "text")


def report_html(title: str, cards: Sequence[Mapping[str, Any]], stats: Sequence[Mapping[str, Any]], outline: str = "") -> str:
    """A page with kinds, outline and blocks: filtered in the page by text and kind, hits marked, links to each block and
    its structural path, and a block's Markdown to save."""
    options = "".join(f'<option value="{escape(str(s["kind"]))}">{escape(str(s["kind"]))} ({s["count"]})</option>' for s in stats)
    rows = "".join(
        f'<article id="block_{c["pos"]:04d}" data-kind="{escape(str(c["kind"]))}"><h3><a href="#block_{c["pos"]:04d}">{escape(str(c["label"]))}: {escape(str(c["title"] or ""))}</a></h3>'
        + (f'<small>{escape(str(c["reference"]))}</small>' if c.get("reference") else "")
        + f'<p>{escape(str(c["text"] or ""))}</p><button>Markdown</button></article>'
        for c in cards
    )
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><input id="text"><select id="kind"><option value=""></option>{options}</select><pre>{escape(outline)}</pre>{rows}<script>{PAGE_SCRIPT}</script>'


#: Folding keeps, for each folded letter, the place of its letter in the text, so that hits are marked in the text itself.
PAGE_SCRIPT = (
    "const plain=c=>c.toLowerCase().normalize('NFKD').replace(/\\p{M}/gu,'');"
    "const folded=s=>{let f='',at=[];[...s].reduce((i,c)=>{for(const x of plain(c)){f+=x;at.push(i)}return i+c.length},0);at.push(s.length);return{f,at}};"
    "const mark=(p,q)=>{const s=p.textContent,{f,at}=folded(s);p.textContent=s;if(!q)return f;let i=0,from=0;const out=[];"
    "while((i=f.indexOf(q,from))>=0){out.push(s.slice(at[from],at[i]),Object.assign(document.createElement('mark'),{textContent:s.slice(at[i],at[i+q.length])}));from=i+q.length}"
    "if(out.length)p.replaceChildren(...out,s.slice(at[from]));return f};"
    "const show=()=>{const q=folded(text.value).f,k=kind.value;document.querySelectorAll('article').forEach(a=>{const f=mark(a.querySelector('p'),q)+folded(a.querySelector('h3').textContent).f;a.hidden=!!(k&&a.dataset.kind!==k)||!f.includes(q)})};"
    "document.onclick=e=>{if(e.target.tagName!=='BUTTON')return;const a=e.target.closest('article'),l=document.createElement('a');"
    "l.href=URL.createObjectURL(new Blob(['## '+a.querySelector('h3').textContent+'\\n\\n'+a.querySelector('p').textContent]));l.download=a.id+'.md';l.click()};"
    "text.oninput=kind.onchange=show;"
)


def reports(documents: DataFrame, blocks: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, html: the report page of each document, made where its rows are."""
    from ..functions.text import display_title, locator_path, position_text, source_reference
    from ..operators.catalog import outline

    at = F.col("locator")
    shown = display_title("display_title", "title", "text", "pos")
    ref = source_reference(shown, "title", locator_path(at), position_text(at["page"], at["sheet"], at["line_start"], at["line_end"]), F.format_string("block_%04d", "pos"))
    card = F.struct("pos", "kind", F.coalesce(kind_label("kind"), F.lit("Bloco")).alias("label"), "title", "text", ref.alias("reference"))
    cards = blocks.groupBy(key).agg(F.array_sort(F.collect_list(card)).alias("cards"))
    counts = blocks.groupBy(key, "kind").count().groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "kind", "count"))).alias("stats"))
    rows = documents.select(key, "file_name").join(cards, key, "left").join(counts, key, "left").join(outline(entries, key), key, "left")

    @F.pandas_udf("string")
    def page(titles: pd.Series, given: pd.Series, stats: pd.Series, lines: pd.Series) -> pd.Series:
        plain = lambda xs: [] if xs is None else [x if isinstance(x, dict) else x.asDict() for x in xs]
        return pd.Series([report_html(t or "", plain(c), plain(s), o or "") for t, c, s, o in zip(titles, given, stats, lines, strict=True)], dtype=object)

    return rows.select(key, page("file_name", "cards", "stats", "outline").alias("html"))


def answer_markdown(query: str, answer: Any, results: Sequence[Mapping[str, Any]] = ()) -> str:
    """An answer, its sources and the passages it was given, as a document."""
    parts = ["# Resposta", f"**Pergunta:** {query}", f"**Situação:** {answer.status}" + (f" ({answer.error})" if answer.error else ""), answer.markdown()]
    if results:
        parts.append("## Trechos\n\n" + "\n\n".join(f"[{g['id']}] {g['reference']}\n\n{g.get('text') or ''}" for g in results))
    return "\n\n".join(p for p in parts if p)


def collection_markdown(name: str, summary: str, catalog: Sequence[Mapping[str, Any]], tree: str, previews: Sequence[tuple[str, Sequence[Mapping[str, Any]]]]) -> str:
    """A collection's summary, catalog, first index lines and example queries, as a document."""
    table = ["| arquivo | arquétipo | blocos | entradas |", "| --- | --- | --- | --- |", *(f"| {r['file_name']} | {r['archetype']} | {r['block_count']} | {r['index_entry_count']} |" for r in catalog)]
    found = "\n\n".join(f"### {q}\n\n{result_lines(rows)}" for q, rows in previews)
    return "\n\n".join([f"# {name}", summary, "## Catálogo\n\n" + "\n".join(table), "## Índice mestre\n\n" + tree, "## Consultas de exemplo\n\n" + found])


def collection_html(name: str, catalog: Sequence[Mapping[str, Any]], tree: str, previews: Sequence[tuple[str, Sequence[Mapping[str, Any]]]]) -> str:
    """A page with the catalog, the master tree and example queries."""
    table = "".join(f"<tr><td>{escape(str(r['file_name']))}</td><td>{escape(str(r['archetype']))}</td><td>{r['block_count']}</td><td>{r['index_entry_count']}</td></tr>" for r in catalog)
    found = "".join(f"<h3>{escape(q)}</h3><pre>{escape(result_lines(rows))}</pre>" for q, rows in previews)
    return f'<!doctype html><meta charset="utf-8"><title>{escape(name)}</title><h1>{escape(name)}</h1><table>{table}</table><pre>{escape(tree)}</pre>{found}'
