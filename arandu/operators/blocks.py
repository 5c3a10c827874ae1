"""Blocks of a document from its lines: one call for each document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from typing import Any

from ..functions.plain import fold_plain, shortened_plain, squeeze_plain
from ..functions.text import LOCATOR_KEYS
from ..functions.values import HEADING_KINDS, LEGAL_KINDS
from .lines import Kind, Line, amends, article_summary, enter, manual, normative, paragraph

#: A block as a Spark type; pos counts from 1 within its document.
LOCATOR_TYPE = "struct<page: int, sheet: string, line_start: int, line_end: int, " + ", ".join(f"{k}: string" for k in LOCATOR_KEYS) + ">"
BLOCK_TYPE = f"struct<pos: int, kind: string, title: string, text: string, locator: {LOCATOR_TYPE}, heading_level: int, heading_group: string, manual_group: string, label: string, display_title: string, index_title: string, amendment_context: boolean, starts_with_quote: boolean, extra: map<string, string>>"

Block = dict[str, Any]


def bounded_end(start: int | None, end: int | None) -> int | None:
    """A last line is never before the first."""
    return start if start is not None and end is not None and end < start else end


def locator(first: Line, last: Line | None = None, context: dict[str, str | None] | None = None) -> dict[str, Any]:
    """From the first line to the last, but to the end of the first where the last is on another page."""
    last = last or first
    if first.page is not None and last.page is not None and first.page != last.page:
        last = first
    end = last.end if last is first and first.end is not None else (last.end if last.end is not None else last.start)
    return {"page": first.page, "sheet": first.sheet, "line_start": first.start, "line_end": bounded_end(first.start, end)} | {k: (context or {}).get(k) for k in LOCATOR_KEYS}


def block(kind: str, title: str | None, text: str, at: dict[str, Any], **more: Any) -> Block:
    made = {"pos": 0, "kind": kind, "title": title, "text": text, "locator": at}
    names = ("heading_level", "heading_group", "manual_group", "label", "display_title", "index_title", "amendment_context", "starts_with_quote")
    extra = {k: v if isinstance(v, str) else str(v) for k, v in {**more.pop("extra", {}), **{k: more.pop(k) for k in list(more) if k not in names}}.items() if v is not None}
    return made | {k: more.get(k) for k in names} | {"extra": extra}


def numbered(blocks: Sequence[Block]) -> list[Block]:
    return [b | {"pos": i} for i, b in enumerate(blocks, 1)]


def _clean(lines: Sequence[Line]) -> list[Line]:
    out = []
    for x in lines:
        if text := squeeze_plain(x.text):
            out.append(Line(text, x.page, x.sheet, x.start, bounded_end(x.start, x.end), x.style, dict(x.extra)))
    return out


class _LegalReader:
    """Lines up to the next device are one block; a heading takes one line more at most. The context moves on only when a
    block is closed, so that an item after an article's first line still belongs to the article."""

    def __init__(self) -> None:
        self.context: dict[str, str | None] = dict.fromkeys(LOCATOR_KEYS)
        self.open: list[Line] = []
        self.opened_by: Kind | None = None
        self.before: str | None = None
        self.structured = False
        self.blocks: list[Block] = []

    def take(self, line: Line, following: str | None, before: str | None) -> None:
        found = normative(line.text, following, before, self.context)
        full = self.opened_by is not None and self.opened_by.kind in HEADING_KINDS and len(self.open) == 2
        if found or full:
            self.close()
        if not self.open:
            self.opened_by, self.before = found, before
        self.open.append(line)

    def close(self) -> None:
        if not self.open:
            return
        lines, first = self.open, self.open[0]
        text = squeeze_plain(" ".join(x.text for x in lines))
        if self.opened_by is None and not self.structured:
            found = Kind("preamble", "Preâmbulo", "Preâmbulo")
        else:
            found = paragraph(text, first.style, before=self.before, context=self.context)
        self.structured |= found.kind in LEGAL_KINDS[1:]
        enter(self.context, found)
        more: dict[str, Any] = {"label": found.label, "heading_level": found.level, "amendment_context": amends(text) or None, "starts_with_quote": first.text.lstrip()[:1] in ('"', "“", "”") or None}
        if len(lines) > 1:
            more["segment_count"] = len(lines)
        if found.kind == "article" and (summary := article_summary(text)):
            name = f"{found.title} - {summary}"
            more |= {"summary": summary, "display_title": name, "index_title": name}
        self.blocks.append(block(found.kind, found.title, text, locator(first, lines[-1], self.context), extra=first.extra, **more))
        self.open, self.opened_by = [], None


def legal_blocks(lines: Sequence[Line]) -> list[Block]:
    """Blocks of a legal text: preamble, devices and paragraphs, each with its place in the structure."""
    lines, reader = _clean(lines), _LegalReader()
    for i, line in enumerate(lines):
        reader.take(line, lines[i + 1].text if i + 1 < len(lines) else None, lines[i - 1].text if i else None)
    reader.close()
    return numbered(reader.blocks)


def _repeated_titles(kinds: Sequence[Kind]) -> set[int]:
    """Early headings whose title comes again: entries of a table of contents."""
    titles = [fold_plain(k.title) if k.kind == "heading" and k.title else None for k in kinds]
    times, seen, out = Counter(t for t in titles if t is not None), set(), set()
    for i, (k, t) in enumerate(zip(kinds, titles, strict=True)):
        if t is None:
            continue
        if i <= 12 and times[t] >= 2 and t not in seen and k.group in ("numbered_heading", "primary_heading", "marker") and (k.level or 0) <= 3:
            out.add(i)
        seen.add(t)
    return out


def _early_run(kinds: Sequence[Kind]) -> set[int]:
    """A run of three rising numbered headings or more that starts in the first 21 lines, if numbered headings follow it."""
    is_numbered = [k.kind == "heading" and k.group == "numbered_heading" for k in kinds]
    start = next((i for i, x in enumerate(is_numbered[:21]) if x), None)
    if start is None:
        return set()
    run, last = [], ()
    for i in range(start, min(21, len(kinds))):
        if not is_numbered[i]:
            break
        number = tuple(map(int, kinds[i].label.split(".")))
        if run and number <= last:
            break
        run.append(i)
        last = number
    return set(run) if len(run) >= 3 and any(is_numbered[run[-1] + 1 :]) else set()


def manual_blocks(lines: Sequence[Line]) -> list[Block]:
    """Blocks of a manual: headings with levels, actions, list items and interface labels one by one, running text joined."""
    lines, kinds = _clean(lines), []
    last = last_group = None
    for x in lines:
        found = manual(x.text, x.style, last, last_group)
        kinds.append(found)
        if found.kind == "heading":
            last, last_group = found.level, found.group
    overview = _repeated_titles(kinds) | _early_run(kinds)
    out: list[Block] = []
    held: list[Line] = []
    held_group: str | None = None

    def close() -> None:
        nonlocal held, held_group
        if held:
            text = squeeze_plain(" ".join(x.text for x in held))
            more = {"segment_count": len(held)} if len(held) > 1 else {}
            out.append(block("paragraph", shortened_plain(text), text, locator(held[0], held[-1]), manual_group=held_group, extra=held[0].extra, **more))
            held, held_group = [], None

    for i, (x, found) in enumerate(zip(lines, kinds, strict=True)):
        group = "overview" if i in overview else found.group or "body"
        alone = group != "overview" and (found.kind == "heading" or group in ("list_item", "micro_action", "interface_label"))
        if held and (held[0].page != x.page or alone or group != held_group):
            close()
        if not alone:
            held.append(x)
            held_group = group
        elif found.kind == "heading":
            out.append(block("heading", found.title, x.text, locator(x), heading_level=found.level, heading_group=found.group, manual_group=found.group, label=found.label, extra=x.extra))
        else:
            out.append(block("paragraph", shortened_plain(x.text), x.text, locator(x), manual_group=group, extra=x.extra))
    close()
    return numbered(out)


def plain_blocks(lines: Sequence[Line], kind: str | Callable[[Line], str] = "line", title: Callable[[Line], str | None] | None = None) -> list[Block]:
    """One block for each line that has text."""
    out = []
    for x in lines:
        if squeeze_plain(x.text):
            out.append(block(kind if isinstance(kind, str) else kind(x), title(x) if title else shortened_plain(x.text), x.text, locator(x), heading_level=style_level_of(x), extra=x.extra))
    return numbered(out)


def style_level_of(x: Line) -> int | None:
    from .lines import style_level

    return style_level(x.style)
