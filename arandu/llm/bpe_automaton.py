"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens that accepts exactly the token
sequences that BPE produces. It starts as one state with a loop for each base symbol. The gadget of merge (a, b) -> ab
copies the state p that a leads to, removes the b arc from the copy, sends all a arcs to the copy, and gives each state
with an a arc an ab arc to where p's b arc leads. All arcs of one token therefore lead to one state, each merge adds one
state, and a state is stored as its parent and the arc it lacks.

A prefix of an accepted sequence is accepted too, and each string has one accepted sequence, so that for each position
of a word exactly one token ends there: the one whose arc exists in the state after the token before it. The transition
table is sparse: all arcs of a token lead to one state, so that a state's row lists only the arcs it lacks, and rows are
compiled as words reach their states. Decoding emits the labels of the arcs.

Defined cases: null text counts as empty and has no ids; special tokens in a text become their ids; texts of any length
are read whole; an empty table gives no rows; further columns, whatever their names, are not read; repeated rows come
back repeated.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held

#: Most words a worker keeps the ids of.
CACHE_WORDS = 250_000
#: Longer words are not kept, so that what a worker keeps is bounded.
LONGEST_KEPT = 100
#: Texts of these characters are split here; others by the tokenizer file's own normaliser and pre-tokenizer.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ]*")


class Automaton:
    """States and arcs; tokens are numbered as in the vocabulary."""

    def __init__(self, base: dict[str, int], vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.parent, self.removed, self.state_born = [0], [-1], [-1]
        self.target, self.left, self.token_born = [0] * size, [-1] * size, [-1] * size
        self.arcs: dict[str, int] = dict(base)
        self.rows: dict[int, dict[int, int]] = {}
        self._tries: dict[str, tuple] = {}
        never: set[str] = set()  # tokens whose parts never stand side by side
        for k, (a, b) in enumerate(merges):
            if a in never or b in never:
                never.add(a + b)
                continue
            if a not in self.arcs or b not in self.arcs or a + b in self.arcs or a + b in never:
                raise ValueError(f"merge {k} ({a!r}, {b!r}) does not join two earlier tokens into a new one")
            left, right, new = self.arcs[a], self.arcs[b], vocab[a + b]
            state = self.target[left]
            if not self.allows(state, right):
                never.add(a + b)
                continue
            self.left[new], self.token_born[new], self.target[new] = left, k, self.target[right]
            self.parent.append(state)
            self.removed.append(right)
            self.state_born.append(k)
            self.target[left] = len(self.parent) - 1
            self.arcs[a + b] = new

    def allows(self, state: int, token: int) -> bool:
        """Whether the state has the token's arc. A token made after the state has one if its left part has."""
        parent, removed, state_born, token_born, left = self.parent, self.removed, self.state_born, self.token_born, self.left
        while state:
            while token_born[token] >= state_born[state]:
                token = left[token]
            if token == removed[state]:
                return False
            state = parent[state]
        return True

    def _compile(self, state: int) -> dict[int, int]:
        """A state's row of the transition table, which is sparse: the arcs that it lacks, with the merge that removed
        each. All other arcs of a token lead to the token's target, whatever the state."""
        row, at = {}, state
        while at:
            row[self.removed[at]] = self.state_born[at]
            at = self.parent[at]
        self.rows[state] = row
        return row

    def has(self, state: int, token: int) -> bool:
        """allows(), from the state's row."""
        if not state:
            return True
        row, later = self.rows.get(state) or self._compile(state), 1 << 60
        while token >= 0:
            if later >= row.get(token, 1 << 61):
                return False
            later, token = self.token_born[token], self.left[token]
        return True

    def _trie(self, end: str, final: bool) -> dict:
        """Arcs by their letters from the last to the first; a node's own token is under the empty string."""
        root: dict = {}
        for token, i in self.arcs.items():
            if end and token.endswith(end) != final:
                continue
            node = root
            for letter in reversed(token[: len(token) - len(end)] if end and final else token):
                node = node.setdefault(letter, {})
            node[""] = i
        return root

    def encode(self, word: str, end: str = "") -> list[int]:
        """Ids of a word of base symbols, the last of them with the suffix `end`. Symbols without an arc are left out."""
        if end not in self._tries:
            self._tries[end] = self._trie(end, False), self._trie(end, True) if end else None
        inner, final = self._tries[end]
        n, has, target = len(word), self.has, self.target
        state, arc, begin = [0] + [-1] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            node, j = final if end and i == n else inner, i
            while j:
                node = node.get(word[j - 1])
                if node is None:
                    break
                j -= 1
                token = node.get("")
                if token is not None and state[j] >= 0 and has(state[j], token):
                    state[i], arc[i], begin[i] = target[token], token, j
                    break
            if state[i] < 0:  # a symbol outside the alphabet splits the word
                return self.encode(word[: i - 1]) + self.encode(word[i:], end)
        out, i = [], n
        while i:
            out.append(arc[i])
            i = begin[i]
        return out[::-1]


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Codec:
    """Whole texts to ids and back for a tokenizer file with byte-level words that end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        made = {a + b for a, b in merges}
        self.automaton = Automaton({t: i for t, i in vocab.items() if t not in made}, vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = dict(enumerate(self.automaton.label)) | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.kind = np.dtype("<u2") if max(self.label) < 1 << 16 else np.dtype("<u4")
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-split word, given in byte letters."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array(self.automaton.encode(piece, self.end), self.kind).tobytes()
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            if len(piece) <= LONGEST_KEPT:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        letters = self.letters
        return b"".join([self._piece(p if p.isascii() and p.isalnum() else "".join([letters[b] for b in p.encode()])) for p in self.pattern.findall(word)])

    def _plain(self, text: str) -> bytes:
        words, out = self.words, []
        for w in text.lower().split():
            ids = words.get(w)
            if ids is None:
                ids = self._word(w)
                if len(words) >= CACHE_WORDS:
                    words.clear()
                if len(w) <= LONGEST_KEPT:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def _any(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return self._plain(text)
        text = self.library.normalizer.normalize_str(text)
        return b"".join([self._piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.split is None or not any(t in text for t in self.special):
            return np.frombuffer(self._any(text), self.kind)
        out = [np.array([self.special[t]], self.kind).tobytes() if t in self.special else self._any(t) for t in self.split.split(text)]
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs, joined by a space: the file names no decoder."""
        label = self.label
        return " ".join([label[i] for i in ids.tolist()])


def codec(path: str) -> Codec:
    """The codec of a file, compiled once in each worker process."""
    return held(("automaton", path), lambda: Codec(path))


def encode_column(text: str | Column, path: str) -> Column:
    """array<int> ids of a text column."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.encode(t).astype(np.int32) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: str | Column, path: str) -> Column:
    """Decoded text of an array<int> column of ids; null for null."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([None if r is None else own.decode(np.asarray(r)) for r in rows], dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and then decoded from the ids alone."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own, rows = codec(path), []
        for t in texts:
            ids = own.encode(t)
            rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    tmp = free_name(docs, "bpe")
    return docs.select(key, digests(F.col(text)).alias(tmp)).select(key, f"{tmp}.*")
