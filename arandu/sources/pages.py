"""Page texts of PDF documents: cleaning, questions and answers, and the choice of a reader."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions import values as V
from ..functions.plain import fold_plain, shortened_plain, squeeze_plain
from ..operators.blocks import Block, block, legal_blocks, locator, manual_blocks, numbered
from ..operators.lines import Line, looks_legal, looks_manual

_I = re.IGNORECASE
_PHRASES = [re.compile(p, _I) for p in V.PDF_PHRASES]
_SKIPPED = [re.compile(p, _I) for p in (V.PDF_HEADER, V.PDF_PAGE_NUMBER, V.PDF_PAGE_LABEL, V.PDF_SEPARATOR, *V.PDF_LINES)]
_SIGNED, _HOME = re.compile(V.PDF_SIGNATURE_PAGE, _I), re.compile(V.PDF_HOME, _I)
_QUESTION = re.compile(V.QUESTION, _I)
#: The first ? comes early; greedy reading up to it leaves the last article that is not too near.
_ARTICLE_QUESTION = re.compile(rf"(?=[^?]{{0,360}}\?)[^?]*((?=[^?]{{23,259}}\?){V.QUESTION_ARTICLE}[^?]*\?)")
_EDGE = " -–:.;"


def without_phrases(text: str) -> str:
    out = squeeze_plain(text)
    for p in _PHRASES:
        out = p.sub(" ", out)
    return squeeze_plain(out)


def page_lines(text: str) -> list[tuple[int, str]]:
    """(line number, text) of a page's own lines; none for a page of signatures."""
    if _SIGNED.search(text):
        return []
    rows = ((i, without_phrases(x)) for i, x in enumerate(text.splitlines(), 1))
    return [(i, x) for i, x in rows if x and fold_plain(x) not in V.PDF_EXACT_LINES and not any(p.search(x) for p in _SKIPPED)]


def page_text(text: str) -> str:
    """A page's own lines in one; the page without phrases if it has none."""
    lines = page_lines(text)
    joined = " ".join(x for _, x in lines) if lines else without_phrases(text)
    return squeeze_plain(_HOME.sub("", squeeze_plain(joined)))


def question(text: str) -> tuple[int, int, str] | None:
    """(start, end, question) of the first question: by its first word, else from the last article before an early ?
    from which 24 to 260 characters lead up to it."""
    found = _QUESTION.search(text) or _ARTICLE_QUESTION.match(text)
    return (found.start(1), found.end(1), squeeze_plain(found[1])) if found else None


def _whole(pages: Sequence[str]) -> str:
    return squeeze_plain(" ".join(filter(None, map(page_text, pages))))


def looks_faq(pages: Sequence[str]) -> bool:
    """At most four pages that begin with a question."""
    if len(pages) > 4 or not (found := question(_whole(pages))):
        return False
    start, _, asked = found
    return start <= 260 and len(asked) in range(24, 261)


def faq_blocks(pages: Sequence[str]) -> list[Block]:
    """Title, question and answer."""
    text, at, out = _whole(pages), locator(Line("", page=1)), []
    start, end, asked = question(text)
    lead, answer = squeeze_plain(text[:start]).strip(_EDGE), squeeze_plain(text[end:]).strip(_EDGE)
    if lead and len(lead) <= 160:
        out.append(block("heading", shortened_plain(lead, 120), lead, at, heading_level=1, heading_group="document_title", qa_role="title"))
    out.append(block("heading", asked, asked, at, heading_level=2 if out else 1, heading_group="question", qa_role="question"))
    if answer:
        out.append(block("paragraph", shortened_plain(answer), answer, at, manual_group="answer", qa_role="answer"))
    return numbered(out)


def page_blocks(pages: Sequence[str]) -> list[Block]:
    """One block for each page with text; its title is its question or its number."""
    rows = [(i, page_text(p)) for i, p in enumerate(pages, 1)]
    return numbered([block("page_text", (question(x) or (0, 0, f"Page {i}"))[2], x, locator(Line("", page=i))) for i, x in rows if x])


def prefers_manual(lines: Sequence[str], titles_only: bool = False) -> bool:
    """Whether the first ten lines speak for a manual rather than a legal text."""
    early = " ".join(squeeze_plain(x).lower() for x in lines[:10])
    titles, structure, operation = (sum(w in early for w in words) for words in (V.MANUAL_TITLE_WORDS, V.MANUAL_STRUCTURE_WORDS, V.MANUAL_OPERATION_WORDS))
    return titles >= 1 or (not titles_only and (structure >= 2 or (structure >= 1 and operation >= 2)))


def blocks_of_pages(pages: Sequence[str]) -> tuple[list[Block], str]:
    """(blocks, mode) of page texts."""
    lines = [Line(x, page=p, start=i, end=i, extra={"page": str(p)}) for p, text in enumerate(pages, 1) for i, x in page_lines(text)]
    texts = [x.text for x in lines]
    if looks_faq(pages):
        return faq_blocks(pages), "structured_faq"
    is_legal = looks_legal(texts)
    if looks_manual(texts) and (not is_legal or prefers_manual(texts)):
        return manual_blocks(lines), "structured_manual"
    return (legal_blocks(lines), "structured_legal") if is_legal else (page_blocks(pages), "page_text")
