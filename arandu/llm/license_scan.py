"""License scans by conditional compression.

A text is cut into paragraphs, at lines without a word. The words around words that licences use (hints), of one
paragraph, are a block, however its lines are wrapped and marked as comments. A block is compressed alone, and with each
template as a zstandard raw dictionary; the templates are ranked by the bytes they save. In that order their passages are
confirmed by the exact differences in wording: few words may differ, and none that tells licences apart (names,
versions), no clause may deny the passage ("is not released under ..."), and the dictionary must save bytes on the
passage itself. The first template that is confirmed wins its place; the passage is masked, and the rest is compressed
and ranked again, until no template is confirmed. So a short notice is found too, in which the words around it weigh more
by chance: it is only tried later.

Defined cases: null, empty and wordless texts have no blocks; a block may hold several passages, which have spans of
their own and do not overlap: of two licences at one place the one that saves more bytes on the block wins (ties: the
first by name), of two passages of it the one with more words, then with fewer differences, then the first; of two blocks
that share words the longer passage stays; repeated rows are scanned alike; an empty table gives no
rows; columns named candidates, spans or licenses are replaced, others stay; texts are read whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Words of licence notices: a text or block without any is no candidate.
HINT = r"(?i)licen[sc]|copyright|copyleft|spdx|warrant|rights\W+reserved|public\W+domain|redistribut|permission\W+is\W+hereby|creative\W+commons"
#: Notices and telling paragraphs of public licences in their published wording, by identifier. BSD is
#: the paragraph that all BSD licences begin with; what follows it tells them apart.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under the terms of the MIT License.",
        "Distributed under the MIT License.",
        "License: MIT",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "License: ISC",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "License: Apache-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "License: GPL-3.0",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "License: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "License: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "License: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "License: MPL-2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "License: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "License: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "License: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: Words whose presence tells licences apart; they may not differ.
TELLING = re.compile(r"(?i)^(mit|apache|gnu|gpl\S*|lgpl\S*|agpl\S*|lesser|affero|bsd\S*|mozilla|mpl\S*|cc|cc0|by|by-\S+|attribution\S*|noncommercial|sharealike|noderivatives|not?|v?\d+(\.\d+)*\S*)$")
WORD = re.compile(r"(?!/)[\w./-]*\w", re.UNICODE)
#: What ends the stretch of text that a notice can lie in.
STRETCH_END = re.compile(r"\n(?:[^\w\n]*\n)+")
#: A line's end and the next one's comment marks within a notice.
WRAP = re.compile(r"\s*\n[^\w\n]*")
#: What before or after a passage, in the same clause, denies it.
DENIED_BEFORE = re.compile(r"(?i)\b(?:not|never|no|nor|neither|isn't|cannot|un)(?:\s+\w+)?\s+$")
DENIED_AFTER = re.compile(r"(?i)(?:\s+licen[cs]e)?\s+(?:does|do|did|is|are|was|has|will|can)(?:\s+not|n't|\s+never|\s+no)\b")
#: Characters of the blocks whose answers a worker keeps.
KEPT_CHARS = 20_000_000
#: Stands for the words of a passage that has been found; nothing is aligned across it.
MASK = "\0"
#: The cost of a differing word that tells licences apart.
NEVER = 1_000_000


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    def __init__(self, templates: Mapping[str, list[str]] = TEMPLATES, level: int = 3, share: float = 0.2):
        self.share, self.hint = share, re.compile(HINT)
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.passages = {k: [words_of(t) for t in templates[k]] for k in sorted(templates)}
        self.given = {
            k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" \n".join(templates[k]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            for k in sorted(templates)
        }
        #: No confirmed passage has more words before or after one of its hints.
        self.reach = math.ceil((1 + share) * max((len(p) for own in self.passages.values() for p in own), default=0))
        self.kept: dict[str, list[tuple]] = {}
        self.size = 0

    def saved(self, passage: str, name: str) -> int:
        """Bytes that the template saves on a passage."""
        data = WRAP.sub(" ", passage).encode("utf-8", "replace")
        return len(self.alone.compress(data)) - len(self.given[name].compress(data))

    def aligned(self, block: list[str], passage: list[str]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, differing words) of all places where the passage is confirmed, the nearest alignments.

        A word only in the block or only in the passage differs; what stands before and after the passage is left out.
        """
        here = set(block)
        lacking = [w for w in passage if w not in here]
        most = int(self.share * len(passage))
        if not passage or len(lacking) > most or any(TELLING.match(w) for w in lacking):
            return []
        extra = np.concatenate(([0], np.cumsum([NEVER if w == MASK or TELLING.match(w) else 1 for w in block])))
        at: dict[str, list[int]] = {}
        for j, w in enumerate(block):
            at.setdefault(w, []).append(j)
        rows = [np.zeros(len(block) + 1, np.int64)]
        for w in passage:
            row = rows[-1] + (NEVER if TELLING.match(w) else 1)
            if same := at.get(w):
                j = np.array(same)
                row[j + 1] = np.minimum(row[j + 1], rows[-1][j])
            rows.append(np.minimum.accumulate(row - extra) + extra)
        out = []
        for end in np.flatnonzero(rows[-1] <= most):
            if block[end - 1] not in passage or end == 0:
                continue
            i, j, first = len(passage), int(end), int(end)
            while i:
                if j and block[j - 1] == passage[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    first = j
                elif rows[i][j] == rows[i - 1][j] + (NEVER if TELLING.match(passage[i - 1]) else 1):
                    i -= 1
                else:
                    j -= 1
            if first < end:
                out.append((first, int(end), int(rows[-1][end])))
        return out

    def ranked(self, text: str) -> list[str]:
        """Templates by the bytes that they save on a text, most first; ties by name."""
        data = WRAP.sub(" ", text).encode("utf-8", "replace")
        alone = len(self.alone.compress(data))
        return sorted(self.given, key=lambda name: (len(self.given[name].compress(data)) - alone, name))

    def confirmed(self, name: str, text: str, words: list[str], spans: list[tuple[int, int]]) -> tuple[int, int, int, int, int] | None:
        """(first word, word after the last, bytes saved, differing words, words found) of a template's best passage in a
        block, by exact differences; None if there is none."""
        best = None
        for passage in self.passages[name]:
            for first, end, differing in self.aligned(words, passage):
                lo, hi = spans[first][0], spans[end - 1][1]
                if DENIED_BEFORE.search(text, max(0, lo - 40), lo) or DENIED_AFTER.match(text, hi):
                    continue
                key = (differing - len(passage), differing, first)
                if (best is None or key < best[0]) and (saved := self.saved(text[lo:hi], name)) > 0:
                    best = key, (first, end, saved, differing, len(passage) - differing)
        return best and best[1]

    def block(self, text: str) -> list[tuple[int, int, str, int, int, int]]:
        """(start, end, licence, bytes saved, differing words, words of the template found) of the winners of a block, in
        the order in which they won."""
        if text in self.kept:
            return self.kept[text]
        spans = [m.span() for m in WORD.finditer(text)]
        words, rest, out = [text[lo:hi].lower() for lo, hi in spans], text, []
        while True:
            for name in self.ranked(rest):
                if found := self.confirmed(name, text, words, spans):
                    break
            else:
                break
            first, end, *more = found
            lo, hi = spans[first][0], spans[end - 1][1]
            out.append((lo, hi, name, *more))
            words[first:end] = [MASK] * (end - first)
            rest = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b, *_ in out))
        self.size += len(text)
        if self.size > KEPT_CHARS:
            self.kept.clear()
            self.size = len(text)
        self.kept[text] = out
        return out

    def blocks_of(self, text: str) -> list[tuple[int, str]]:
        """(start, block): the words around hints, up to the ends of their stretch of text; hints that are near each other share one."""
        out, lo = [], 0
        for hi, after in [*(m.span() for m in STRETCH_END.finditer(text)), (len(text), len(text))]:
            hints = [m.start() for m in self.hint.finditer(text, lo, hi)]
            if hints:
                spans = [m.span() for m in WORD.finditer(text, lo, hi)]
                starts = [s for s, _ in spans]
                places = [max(0, bisect.bisect_right(starts, h) - 1) for h in hints]
                i = 0
                while i < len(places):
                    first = last = places[i]
                    while i < len(places) and places[i] <= first + self.reach:
                        last, i = places[i], i + 1
                    begin, end = spans[max(0, first - self.reach)][0], spans[min(len(spans) - 1, last + self.reach)][1]
                    out.append((begin, text[begin:end]))
            lo = after
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, int, int]]]:
        """(candidate blocks, [(start, end, licence, bytes saved, differing words)])."""
        if not text or not self.hint.search(text):
            return 0, []
        blocks = self.blocks_of(text)
        found = {(at + lo, at + hi, *rest) for at, block in blocks for lo, hi, *rest in self.block(block)}
        taken: list[tuple[int, int]] = []  # disjoint, in order
        out = []
        for lo, hi, name, saved, differing, same in sorted(found, key=lambda x: (-x[5], x[4], -x[3], x[2], x[0], x[1])):
            k = bisect.bisect_left(taken, (lo, hi))
            if (k == 0 or taken[k - 1][1] <= lo) and (k == len(taken) or taken[k][0] >= hi):
                taken.insert(k, (lo, hi))
                out.append((lo, hi, name, saved, differing))
        return len(blocks), sorted(out)


SPANS = "array<struct<start: int, end: int, license: string, saved: int, differing: int>>"


def scan_column(text: Column, templates: Mapping[str, list[str]] | None = None) -> Column:
    """struct<candidates int, spans array<struct<start, end, license, saved, differing>>>; null for texts without a licence word."""
    own = templates or TEMPLATES
    holder: list[Scanner] = []

    @F.pandas_udf(f"candidates int, spans {SPANS}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not holder:
            holder.append(Scanner(own))
        found = [holder[0].scan(t) for t in texts]
        names = ("start", "end", "license", "saved", "differing")
        return pd.DataFrame({"candidates": pd.Series([n for n, _ in found], dtype="int32"), "spans": pd.Series([[dict(zip(names, x, strict=True)) for x in s] for _, s in found], dtype=object)})

    return scan(text)


def scanned(docs: DataFrame, text: str = "text", templates: Mapping[str, list[str]] | None = None) -> DataFrame:
    """docs with candidates (blocks), spans and licenses (distinct confirmed ones, sorted); these columns are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("candidates", "spans", "licenses")]
    tmp, marked = free_name(docs, "license_scan"), F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    rows = docs.withColumn(tmp, scan_column(F.when(marked, F.col(text)), templates))
    out = rows.select(*(F.col(f"`{c}`") for c in own), F.col(f"{tmp}.candidates").alias("candidates"), F.col(f"{tmp}.spans").alias("spans"))
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"]))))
