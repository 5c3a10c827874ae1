"""References to articles ("art. 156-A") as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plain import fold_plain
from .text import Text, col, filled
from .values import ARTICLE_MENTION, BARE_MENTION, LEADING_MENTION


def _joined(number: Column, letter: Column) -> Column:
    return F.concat_ws("-", number, filled(F.lower(letter)))


def references(c: Text, bare: bool = True) -> Column:
    """Distinct references in order, as "156" or "156-a": article mentions, then, if bare, plain "156-A"."""
    text = F.coalesce(col(c), F.lit(""))

    def found(pattern: str) -> Column:
        numbers, letters = (F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(numbers, letters, _joined)

    # Every mention has a digit: most texts need no search for mentions.
    own = F.array_distinct(F.concat(found(ARTICLE_MENTION), found(BARE_MENTION)) if bare else found(ARTICLE_MENTION))
    return F.when(text.rlike("[0-9]"), own).otherwise(F.array().cast("array<string>"))


def primary_reference(c: Text) -> Column:
    """The reference that the text begins with, else null."""
    text = F.coalesce(col(c), F.lit(""))
    number = filled(F.regexp_extract(text, "(?i)" + LEADING_MENTION, 1))
    return F.when(number.isNotNull(), _joined(number, F.regexp_extract(text, "(?i)" + LEADING_MENTION, 2)))


def references_plain(value: str, bare: bool = True) -> list[str]:
    """references() of one string."""
    out = []
    for pattern in [ARTICLE_MENTION, BARE_MENTION] if bare else [ARTICLE_MENTION]:
        out += ["-".join(x for x in (m[1], fold_plain(m[2] or "")) if x) for m in re.finditer(pattern, value, re.IGNORECASE)]
    return list(dict.fromkeys(out))


def match_counts(asked: list[str], has: Callable[[str], Column]) -> tuple[Column, Column]:
    """How many of the asked references are there, and of how many only the number without the letter is."""
    exact = partial = F.lit(0)
    for r in asked:
        exact = exact + has(r).cast("int")
        if "-" in r:
            partial = partial + (~has(r) & has(r.split("-")[0])).cast("int")
    return exact, partial
