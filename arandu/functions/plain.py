"""The same normalisation for single Python strings, for queries and for the parsers that run in Python."""

from __future__ import annotations

import re
import unicodedata


def squeeze_plain(value: object) -> str:
    return " ".join(str("" if value is None else value).split())


_OTHER = re.compile(r"[^\x00-\x7f]+")


def _without_marks(found: re.Match[str]) -> str:
    return "".join(c for c in found[0] if not unicodedata.combining(c))


def fold_plain(value: object) -> str:
    lower = squeeze_plain(value).lower()
    return lower if lower.isascii() else _OTHER.sub(_without_marks, unicodedata.normalize("NFKD", lower))


def tokens_plain(value: object) -> list[str]:
    """Distinct tokens in order."""
    found = re.split(r"\W+", fold_plain(value))
    return list(dict.fromkeys(t for t in found if len(t) > 1 or t.isdigit()))


def label_plain(value: object) -> str:
    return squeeze_plain(value).lstrip('"“”').strip()


def shortened_plain(value: object, most: int = 90) -> str:
    text = squeeze_plain(value)
    return text if len(text) <= most else text[: most - 3].rstrip() + "..."
