"""Text normalisation, tokens, labels, locators and previews."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str

#: The white space that str.split() knows, but the blank, as a character class.
_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that is not a single blank, so that a squeezed text has no match.
_RUNS = rf"[{_SPACE}][{_SPACE} ]*| [{_SPACE} ]+"


def _marks() -> str:
    """The combining characters, as ranges of a character class."""
    codes = [i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    starts = [i for i in codes if not unicodedata.combining(chr(i - 1))]
    ends = [i for i in codes if not unicodedata.combining(chr(i + 1))]
    ranges = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in zip(starts, ends, strict=True))
    return rf"(?:(?=[\p{{M}}\p{{Cn}}])[{ranges}])+"  # they are marks, or newer than the JVM: much cheaper to ask than the ranges


_MARKS = _marks()

#: The letters of a word for \W, and the limits of previews.
NON_WORD = r"[^\p{L}\p{N}_]+"
TITLE_LIMIT, PREVIEW_LIMIT, DISPLAY_LIMIT, SNIPPET_LIMIT, SNIPPET_LEAD = 90, 220, 96, 220, 60
QUOTES = "\"“”"

#: Locator keys in order of depth.
LOCATOR_KEYS = ["part", "book", "title", "chapter", "section", "subsection", "article", "paragraph", "inciso", "alinea", "item"]


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Text) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(col(c), _RUNS, " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which the value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def fold(c: Text) -> Column:
    """squeeze, lower case, compatibility letters and accents as plain letters (NFKD without combining characters): for
    comparing. Null counts as empty.

    ASCII texts, whose bytes are as many as their letters, are done after lower(); the others are decomposed by the ICU
    library that Spark ships, in the JVM. Spark holds such a call for one that may change its answer, so that it is
    evaluated once in a projection and not moved.
    """
    def decomposed(x: Column) -> Column:
        plain = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), x, F.lit(True))
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(plain, _MARKS, ""))

    return once(F.lower(squeeze(F.coalesce(col(c), F.lit("")))), decomposed)


def tokens(c: Text) -> Column:
    """Words of the folded text that have two letters or more, or are digits."""
    return F.filter(F.split(fold(c), NON_WORD), lambda x: (F.length(x) > 1) | x.rlike(r"^\p{Nd}+$"))


def distinct_tokens(c: Text) -> Column:
    return F.array_distinct(tokens(c))


def label(c: Text) -> Column:
    """squeeze without leading quotes."""
    return F.trim(F.regexp_replace(squeeze(c), f"^[{QUOTES}]+", ""))


def shortened(c: Text, most: int) -> Column:
    """The squeezed text, or its first most - 3 characters and three dots."""
    s = squeeze(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 3)), F.lit("...")))


def filled(c: Text) -> Column:
    """Null for an empty string."""
    return F.nullif(col(c), F.lit(""))


def display_title(own: Text, title: Text, text: Text, position: Text) -> Column:
    """The block's own display title, its title, its text at most 96 characters long, or its number."""
    return F.coalesce(filled(own), filled(title), filled(shortened(text, DISPLAY_LIMIT)), F.concat(F.lit("Bloco "), col(position).cast("string")))


def entry_title(index_title: Text, own: Text, title: Text, text: Text, position: Text) -> Column:
    """Title of a block's index entry; a text is cut at 80 characters."""
    return F.coalesce(filled(index_title), filled(own), filled(title), filled(F.substring(F.trim(F.coalesce(col(text), F.lit(""))), 1, 80)), F.concat(F.lit("Block "), col(position).cast("string")))


def locator_parts(locator: Column) -> Column:
    """The structural parts of a locator that are filled, outermost first."""
    return F.array_compact(F.array(*(filled(locator[k]) for k in LOCATOR_KEYS)))


def locator_path(locator: Column) -> Column:
    return filled(F.array_join(locator_parts(locator), " > "))


def position_text(page: Text, sheet: Text, start: Text, end: Text) -> Column:
    """Page, sheet and lines in words; zero counts as missing, null if nothing is there."""
    p, a, b = (F.nullif(col(x), F.lit(0)) for x in (page, start, end))
    line = F.when(a.isNull(), None).when(b.isNull() | (a == b), F.format_string("Linha %d", a)).otherwise(F.format_string("Linhas %d-%d", a, b))
    page_text = F.when(p.isNotNull(), F.format_string("Página %d", p))
    sheet_text = F.when(filled(sheet).isNotNull(), F.concat(F.lit("Aba "), col(sheet)))
    return filled(F.concat_ws(" | ", page_text, sheet_text, line))


def source_reference(shown: Column, title: Text, path: Column, position: Column, block_id: Text) -> Column:
    """Display title, locator path unless it is the title, position and id."""
    return F.concat_ws(" | ", shown, F.when(~path.eqNullSafe(col(title)), path), position, col(block_id))


def path_text(path: Text, heading: Text, title: Text) -> Column:
    """The path's filled parts joined, else the heading, else the title."""
    parts = F.filter(F.transform(F.coalesce(col(path), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(filled(F.array_join(parts, " > ")), filled(F.trim(col(heading))), filled(F.trim(col(title))), F.lit(""))


def starts_with_quote(c: Text) -> Column:
    return F.coalesce(F.ltrim(col(c)).rlike(f"^[{QUOTES}]"), F.lit(False))


def has_letter_or_digit(c: Text) -> Column:
    return F.coalesce(col(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def heading_level(style: Text) -> Column:
    """Level of a style name: an h1..h6 word, or Heading with a number."""
    word = F.regexp_extract(col(style), r"\b[hH]([1-6])\b", 1)
    named = F.regexp_extract(col(style), r"(?i)Heading\s*(\d{1,9})", 1)
    return F.coalesce(filled(word), filled(named)).cast("int")


def snippet(text: Text, query: str, most: int = SNIPPET_LIMIT) -> Column:
    """A window of the text that starts 60 characters before the first hit of the query, or of its first word that hits."""
    from .plain import fold_plain, tokens_plain

    compact, folded = squeeze(F.coalesce(col(text), F.lit(""))), fold(text)
    whole = fold_plain(query)
    prefix = F.substring(compact, 1, most)
    if not whole:
        return prefix
    at = once(folded, lambda f: F.coalesce(*(F.nullif(F.instr(f, F.lit(w)), F.lit(0)) for w in [whole, *tokens_plain(query)]))) - 1
    start = F.greatest(at - SNIPPET_LEAD, F.lit(0))
    cut = F.trim(F.substring(compact, start + 1, F.lit(most)))
    window = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), cut, F.when(start + most < F.length(compact), F.lit("...")).otherwise(F.lit("")))
    return F.when(at.isNull(), prefix).otherwise(window)


def slug(c: Text, joint: str = "_", default: str = "") -> Column:
    """Folded letters and digits, other runs as the joint."""
    out = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    return F.when(out == "", F.lit(default)).otherwise(out)


def fingerprint(c: Text) -> Column:
    """sha1, in hexadecimal, of the folded text."""
    return F.sha1(fold(c).cast("binary"))


def stable_hash(c: Text, modulo: int) -> Column:
    """The first 8 bytes of the sha1 as an unsigned number, modulo a number under 2**31."""
    hexed = F.sha1(col(c).cast("binary"))
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") % modulo
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long") % modulo
    return ((high * ((1 << 32) % modulo) + low) % modulo).cast("int")


def kind_label(kind: Text) -> Column:
    """A kind in words."""
    from .values import KIND_LABELS

    known = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(kind)), F.initcap(F.replace(col(kind), F.lit("_"), F.lit(" "))))


def file_stem(path: Text) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_name(path: Text) -> Column:
    return F.regexp_extract(col(path), r"[^/\\]*$", 0)


def file_suffix(path: Text) -> Column:
    """Lower-case suffix without the dot; empty for none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]+)$", 1))


def safe_name(c: Text) -> Column:
    """A name for folders: runs of other characters as _, none at the ends."""
    return F.coalesce(filled(F.regexp_replace(F.regexp_replace(F.trim(col(c)), "[^a-zA-Z0-9._-]+", "_"), "^[._]+|[._]+$", "")), F.lit("item"))
