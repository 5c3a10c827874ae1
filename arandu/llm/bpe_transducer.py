"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The ranks are compiled into merges: each token's last merge joins two earlier tokens. A sequence of tokens is what BPE
makes of its bytes if no merge joins two neighbours across the boundary between them at a time when both are still
there, which the merges at the inner edges of the two tell. So a transducer reads bytes, guesses where tokens end, and
drops a guess as soon as no token that it can still end in may follow the one before it.

It is determinised as texts need it: a state is the set of guesses that are still open, each with its node in the trie
of tokens, the token before it, and the tokens that not all guesses share. What all of them share is emitted, at the
latest once no token reaches further back: a bounded lookahead. States and arcs are kept and found by look-ups; beyond
MOST_STATES they are made anew.

Decoding is streaming: a state machine for UTF-8 goes over the bytes of tokens, holds back at most three bytes of an
unfinished character, and writes U+FFFD for each maximal part of an ill-formed one. A token's effect in a state is kept.

Defined cases: null text counts as empty and has no ids; special tokens are ordinary text; texts of any length are read
whole; tokens that no merge makes are used for pieces that equal them, as the rank file's own library does; an empty
table gives no rows; further columns, whatever their names, are not read; repeated rows come back repeated.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held

#: States, remembered pairs of tokens and words that a worker keeps, at most.
MOST_STATES, MOST_PAIRS, MOST_WORDS = 250_000, 400_000, 600_000
#: Bits of a symbol: a byte, or for words with a suffix a byte at the end of a word.
SYMBOL_BITS = 10
#: Tokens beyond a node of the trie that are looked at to drop a guess early.
FEW = 12
#: Longer words are not kept, so that what a worker keeps is bounded.
LONGEST_KEPT = 100
#: Texts of these characters, without two of white space in a row at a space, are looked up by words, each with the space before it.
PLAIN, UNEVEN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ]*"), re.compile(r" [\t\n\r ]|[\t\n\r] ")
#: States and tokens whose effects the decoder keeps.
MOST_EFFECTS = 200_000

Guess = tuple[int, int, tuple[int, ...]]


class Determinised:
    """A table of arcs over symbols for a language of token sequences in which a token may or may not follow another.

    Rows are states, made as inputs reach them; an arc leads to the next state and tells the tokens that are sure now.
    """

    def __init__(self, spelled: Iterable[tuple[int, Iterable[int]]], most_states: int):
        """spelled: (token, its symbols, each under 2**SYMBOL_BITS)."""
        self.most_states = most_states
        self.pairs: dict[int, bool] = {}
        self.hopes: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, symbols in spelled:
            node = 0
            for x in symbols:
                place = node << SYMBOL_BITS | x
                if place not in self.child:
                    self.child[place] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[place]
            self.token_at[node] = token
        #: The tokens beyond a node, None where there are more than FEW.
        self.few: list[tuple[int, ...] | None] = [()] * len(self.token_at)
        for place, to in reversed(self.child.items()):  # children come after their parents
            above, own = self.few[place >> SYMBOL_BITS], self.few[to]
            whole = None if above is None or own is None else above + own + ((self.token_at[to],) if self.token_at[to] >= 0 else ())
            self.few[place >> SYMBOL_BITS] = None if whole is None or len(whole) > FEW else whole
        self._forget()

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a."""
        raise NotImplementedError

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.may_follow(a, b)
        return known

    def _forget(self) -> None:
        self.states: dict[tuple[Guess, ...], int] = {}
        self.guesses: list[tuple[Guess, ...]] = []
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rest: list[tuple[int, ...]] = []
        self._state(((0, -1, ()),))

    def _state(self, guesses: tuple[Guess, ...]) -> int:
        known = self.states.get(guesses)
        if known is None:
            known = self.states[guesses] = len(self.guesses)
            self.guesses.append(guesses)
            self.arcs.append({})
            self.rest.append(next((held for node, _, held in guesses if not node), ()))
        return known

    def _open(self, node: int, before: int) -> bool:
        """Whether a token beyond the node may follow the one before it; else the guess is dropped at once. Where there are
        more than FEW tokens it is kept without a look: it falls away later, with the same ids."""
        known = self.hopes.get(place := before << 20 | node)
        if known is None:
            if len(self.hopes) >= MOST_PAIRS:
                self.hopes.clear()
            few = self.few[node]
            known = few is None or any(before < 0 or self.follows(before, token) for token in few)
            self.hopes[place] = known
        return known

    def _arc(self, state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
        """The arc of a symbol: the state that it leads to (-1: none) and the tokens that it emits."""
        child, token_at, hopes, out, ended = self.child, self.token_at, self.hopes, [], None
        for node, before, held in self.guesses[state]:
            to = child.get(node << SYMBOL_BITS | symbol)
            if to is not None:
                hope = hopes.get(before << 20 | to)
                if hope is None:
                    hope = self._open(to, before)
                if hope:
                    out.append((to, before, held))
                if ended is None and (token := token_at[to]) >= 0 and (before < 0 or self.follows(before, token)):
                    ended = (0, token, (*held, token))
        if ended is not None:
            out.append(ended)
        if not out:
            return -1, ()
        emitted: tuple[int, ...] = ()
        while held := out[0][2]:
            first = held[0]
            if any([not x[2] or x[2][0] != first for x in out]):
                break
            emitted += (first,)
            out = [(node, before, held[1:]) for node, before, held in out]
        guesses = tuple(out)
        if len(self.guesses) >= self.most_states:
            self._forget()
            return self._state(guesses), emitted
        arc = self.arcs[state][symbol] = self._state(guesses), emitted
        return arc

    def tokens(self, symbols: Iterable[int]) -> list[int] | None:
        """The tokens of a sequence of symbols, a look-up each; None if it has a symbol that no token has."""
        out, state = [], 0
        for x in symbols:
            state, emitted = self.arcs[state].get(x) or self._arc(state, x)
            if emitted:
                out += emitted
            if state < 0:
                return None
        out += self.rest[state]
        return out


class Transducer(Determinised):
    """Bytes of one piece to ids, by the ranks of tokens; every byte must have a token."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: Parts of a token's last merge; single bytes have none and are there from the start.
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole_only: dict[bytes, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._compile(token, i)
        super().__init__(((i, token) for token, i in ranks.items() if token not in self.whole_only), most_states)

    def _compile(self, token: bytes, rank: int) -> None:
        """The last merge of a token: its two parts are earlier tokens, and no earlier merge joins them otherwise."""
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if a < rank and b < rank and token[:cut] not in self.whole_only and token[cut:] not in self.whole_only and self._stays(a, b, rank):
                self.parts[rank] = a, b
                return
        self.whole_only[token] = rank

    def _stays(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether no merge (of a rank below `before`) joins a and b across the boundary between them.

        Goes back in time over what stands at the boundary: a piece is there from its own merge until that of the piece
        that holds it. Of equal merges the one further left comes first.
        """
        until_a = until_b = before if before is not None else len(self.ranks) + 1 << 8
        while True:
            merge = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if merge is not None and merge < until_a and merge <= until_b and (before is None or merge < before):
                return False
            born_a, born_b = (a if a in self.parts else -1), (b if b in self.parts else -1)
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                until_a, a = born_a, self.parts[a][1]
            else:
                until_b, b = born_b, self.parts[b][0]

    def may_follow(self, a: int, b: int) -> bool:
        return self._stays(a, b)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece."""
        return [self.whole_only[piece]] if piece in self.whole_only else self.tokens(piece) or []


def expected(lead: int) -> tuple[int, int, int] | None:
    """After the first byte of a character: how many follow, and the lowest and highest that may come next; None for a byte that begins none."""
    if lead < 0x80:
        return 0, 0, 0
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return None


def fed(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """(characters that data completes, bytes of the unfinished character) in the state that pending bytes stand for."""
    if not pending and data.isascii():
        return data.decode("ascii"), b""
    out, held, need, low, high = [], b"", 0, 0, 0
    for byte in pending + data:
        if need and not low <= byte <= high:
            out.append("�")
            held, need = b"", 0
        if need:
            held, need, low, high = held + bytes([byte]), need - 1, 0x80, 0xBF
        elif (rule := expected(byte)) is None:
            out.append("�")
            continue
        else:
            held, (need, low, high) = bytes([byte]), rule
        if not need:
            out.append(held.decode("utf-8"))
            held = b""
    return "".join(out), held


class Decoder:
    """Ids to text, in parts as they come: text() holds back an unfinished character, end() gives U+FFFD for it."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.pending = bytes_of, b""
        self.effects: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        #: The characters of tokens that begin and end with whole ones.
        self.whole = {i: text for i, t in bytes_of.items() for text, rest in [fed(b"", t)] if not rest and "\ufffd" not in text}

    def text(self, ids) -> str:
        if not self.pending:
            try:  # no state to keep between tokens of whole characters
                return "".join([self.whole[i] for i in ids])
            except KeyError:
                pass
        out, pending, effects = [], self.pending, self.effects
        for i in ids:
            effect = effects.get((pending, i))
            if effect is None:
                if len(effects) >= MOST_EFFECTS:
                    effects.clear()
                effect = effects[pending, i] = fed(pending, self.bytes_of[i])
            more, pending = effect
            out.append(more)
        self.pending = pending
        return "".join(out)

    def end(self) -> str:
        rest, self.pending = "�" * bool(self.pending), b""
        return rest


class Codec:
    """Whole texts to ids and back for a rank file and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.machine = Transducer(ranks)
        #: White space as Unicode has it, which the file's own library uses; Python's adds U+001C to U+001F.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.decoder = Decoder(self.machine.bytes_of)
        self.words: dict[str, tuple[int, ...]] = {}
        self.names = {i: str(i) for i in self.machine.bytes_of}

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch of text that pieces do not cross; kept."""
        encode, words = self.machine.encode, self.words
        ids = tuple([i for piece in self.pattern.findall(word) for i in encode(piece.encode())])
        if len(words) >= MOST_WORDS:
            words.clear()
        if len(word) <= LONGEST_KEPT:
            words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Pieces begin at a single space between other characters, so that such texts are stretches that end before one."""
        text, out, words = text or "", [], self.words
        even = PLAIN.fullmatch(text) and not UNEVEN.search(text)
        for w in text.replace(" ", "\0 ").split("\0") if even else self.pattern.findall(text):
            out += words.get(w) or self._word(w)
        return out

    def decode(self, ids) -> str:
        self.decoder.pending = b""
        return self.decoder.text(ids) + self.decoder.end()


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, compiled once in each worker process."""
    return held(("transducer", path, pattern), lambda: Codec(path, pattern))


def encode_column(text: str | Column, path: str, pattern: str) -> Column:
    """array<int> ids of a text column."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([np.array(own.encode(t), np.int32) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: str | Column, path: str, pattern: str) -> Column:
    """Decoded text of an array<int> column of ids; null for null."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([None if r is None else own.decode(np.asarray(r).tolist()) for r in rows], dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and then decoded from the ids alone."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own, rows = codec(path, pattern), []
        for t in texts:
            ids = own.encode(t)
            listed = " ".join([own.names[i] for i in ids])
            rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    tmp = free_name(docs, "bpe")
    return docs.select(key, digests(F.col(text)).alias(tmp)).select(key, f"{tmp}.*")
