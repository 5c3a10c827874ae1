"""Token ids in fixed-width bit-packed shards.

A shard holds the ids of documents in key order, each id in the fewest bits that its vocabulary needs. 64 ids fill
exactly `bits` 64-bit words, so that packing and unpacking are shifts of whole numpy columns; a block is a whole number
of such groups, and block offsets and document starts in the footer give random access.

    shard  := MAGIC | bits u8 | block* | footer | footer offset u64 | MAGIC
    footer := n blocks u64 | n docs u64 | block byte offset u64 * (n blocks + 1) | doc start u64 * (n docs + 1)
              | key i64 * n docs | key is null u8 * n docs

Shards are written under a name of their own and then renamed, so that a task that is run again replaces its shard by
an equal one. Texts are shuffled and then encoded: compressed as a shuffle compresses them they are hardly longer than
ids (1.10 and 1.03 times the input as measured), which would have to be stored before their order is known.

Defined cases: null text counts as empty; null keys come first; equal keys follow a hash of their texts, so that a key
with many rows can fill several shards; an empty table gives no shards and no rows; special tokens in a text become
their ids; further columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held

MAGIC = b"BITSHRD1"
GROUP = 64
BLOCK = GROUP * 1024
CACHE_WORDS = 800_000
#: Longer words are not kept beyond their batch, so that what a worker keeps is bounded.
LONGEST_KEPT = 100
#: Texts of these characters are split at spaces here and their words looked up; others go to the library whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ]*")
UNEVEN = ["  ", *(pair for c in "\n\t\r" for pair in (f" {c}", f"{c} "))]
CHUNKS = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Whole groups of 64 ids; the last is filled with zeros."""
    groups = -(-len(ids) // GROUP)
    x = np.zeros(groups * GROUP, np.uint64)
    x[: len(ids)] = ids
    x = x.reshape(groups, GROUP)
    out = np.zeros((groups, bits), np.uint64)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= x[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """All ids of whole groups, fill included."""
    x = np.frombuffer(data, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(x), GROUP), np.uint64), np.uint64((1 << bits) - 1)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        got = x[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | x[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = got & mask
    return out.reshape(-1).astype(np.uint32)


def write_shard(out: BinaryIO, bits: int, docs: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write documents' ids; returns the numbers of documents and ids. Holds one block and 17 bytes a document."""
    at = len(MAGIC) + 1
    out.write(MAGIC + bytes([bits]))
    offsets, starts, keys, nulls, held, n_held = [at], [0], [], [], [], 0

    def flush(last: bool) -> None:
        nonlocal at, held, n_held
        if n_held >= BLOCK or (last and n_held):
            ids = np.concatenate(held)
            whole = len(ids) if last else len(ids) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                data = pack(ids[lo : min(whole, lo + BLOCK)], bits)
                out.write(data)
                at += len(data)
                offsets.append(at)
            held, n_held = [ids[whole:]], len(ids) - whole

    for key, ids in docs:
        keys.append(key or 0)
        nulls.append(key is None)
        starts.append(starts[-1] + len(ids))
        held.append(np.asarray(ids, np.uint32))
        n_held += len(ids)
        flush(False)
    flush(True)
    out.write(np.array([len(offsets) - 1, len(keys), *offsets, *starts], "<u8").tobytes() + np.array(keys, "<i8").tobytes() + np.array(nulls, "u1").tobytes())
    out.write(np.array([at], "<u8").tobytes() + MAGIC)
    return len(keys), starts[-1]


class Shard:
    """Random access to a shard: reads the footer once, then only the blocks asked for."""

    def __init__(self, file: BinaryIO, size: int):
        self.file = file
        file.seek(size - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a shard, or not whole")
        at = int(np.frombuffer(tail[:8], "<u8")[0])
        file.seek(0)
        self.bits = file.read(len(MAGIC) + 1)[-1]
        file.seek(at)
        data = file.read(size - 8 - len(MAGIC) - at)
        n_blocks, n = (int(x) for x in np.frombuffer(data[:16], "<u8"))
        numbers = np.frombuffer(data[16 : 16 + 8 * (n_blocks + n + 2)], "<u8")
        self.offsets, self.starts = numbers[: n_blocks + 1].astype(np.int64), numbers[n_blocks + 1 :].astype(np.int64)
        rest = data[16 + 8 * (n_blocks + n + 2) :]
        self.keys, self.nulls = np.frombuffer(rest[: 8 * n], "<i8"), np.frombuffer(rest[8 * n :], "u1").astype(bool)

    def block(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        return unpack(self.file.read(int(self.offsets[k + 1] - self.offsets[k])), self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start, ids) in order, one block at a time."""
        held, at, k = np.zeros(0, np.uint32), 0, 0
        for i in range(len(self.keys)):
            start, stop = int(self.starts[i]), int(self.starts[i + 1])
            if at + len(held) < stop:
                parts = [held[start - at :]]
                while k * BLOCK < stop:
                    parts.append(self.block(k))
                    k += 1
                held, at = np.concatenate(parts), start
            yield (None if self.nulls[i] else int(self.keys[i])), start, held[start - at : stop - at]


def filesystem(uri: str):
    """(file system, path) of a URI that pyarrow knows, of Hadoop's names for S3, of a mounted dbfs: or of a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("dbfs:"):
        return fs.LocalFileSystem(), "/dbfs/" + uri[5:].lstrip("/")
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class Encoder:
    """Whole texts to ids with the tokenizers library. Words are encoded once and kept, since no piece of a byte-level
    pre-tokenizer crosses the place before a single space between other characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.vocabulary = max(size, max(self.library.get_vocab(with_added_tokens=True).values()) + 1)
        self.kind = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Ids of words, and of those of the half before: at most CACHE_WORDS in both.
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: Bytes of each token: a byte-level vocabulary has one letter for each.
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks, many in one call: those that begin with one space and have other characters at both ends keep
        their ids in a row, and the tokens' byte lengths tell where each ends."""
        rows = [c for c in chunks if len(c) > 1 and c[0] == " " and c[1] not in " \t\n\r" and c[-1] not in " \t\n\r"]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in some])) + 1
            data, last = ids.astype(self.kind).tobytes(), 0
            for c, end in zip(some, (ends * self.kind.itemsize).tolist(), strict=True):
                self.kept[c] = data[last:end]
                last = end
        others = set(chunks).difference(rows)
        for c, e in zip(others, self.library.encode_batch(list(others), add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, self.kind).tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """Parts of a text that the library splits there too; None: it has to see the whole text."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        if any(pair in text for pair in UNEVEN):
            return CHUNKS.findall(text)
        return text.replace(" ", "\0 ").split("\0")  # each word but the first with its space

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._chunks(t) for t in texts]
        # each chunk is looked up once; places of chunks that are not kept stay None until these are learned
        found = [None if chunks is None else list(map(self.kept.get, chunks)) for chunks in split]
        gaps = [(k, [i for i, ids in enumerate(own) if ids is None]) for k, own in enumerate(found) if own and None in own]
        missing = {split[k][i] for k, places in gaps for i in places}
        old = {}
        if len(self.kept) + len(missing) > CACHE_WORDS // 2:  # the words of late stay in reach, and come back as they are met
            old, self.before, self.kept = self.before, self.kept, {}
        for c in [c for c in missing if c in self.before or c in old]:
            self.kept[c] = self.before[c] if c in self.before else old[c]
            missing.remove(c)
        self._learn(list(missing))
        kept = self.kept
        for k, places in gaps:
            own, chunks = found[k], split[k]
            for i in places:
                own[i] = kept[chunks[i]]
        out = [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind) if own is None else np.frombuffer(b"".join(own), self.kind) for t, own in zip(texts, found, strict=True)]
        for c in missing:
            if len(c) > LONGEST_KEPT:
                kept.pop(c, None)
        return out


def encoder(path: str) -> Encoder:
    return held(("bitpack", path), lambda: Encoder(path))


def grouped(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode texts, append end_id to each, write shards in ascending key order under a folder that executors share.

    Returns a list of {path, docs, ids, start} in order; start is the number of ids in the shards before.
    """
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frames = (f for f in frames if len(f))
        first = next(frames, None)
        if first is None:
            return
        own, (fs, top) = encoder(tokenizer), filesystem(folder)
        end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        name = f"{top}/shard-{part:07d}"
        trial = f"{name}.{uuid.uuid4().hex}.part"

        def docs_of(frame: pd.DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
            keys = zip(frame["given"], frame["key"], strict=True)
            for some in grouped([t or "" for t in frame["text"]]):
                for ids in own.encode(some):
                    given, k = next(keys)
                    yield (int(k) if given else None), np.concatenate((ids, end))

        with fs.open_output_stream(trial) as out:
            n_docs, n_ids = write_shard(out, bits_for(max(own.vocabulary, (end_id or 0) + 1)), _chained(first, frames, docs_of))
        fs.move(trial, name)
        yield pd.DataFrame({"part": [part], "path": [f"{folder}/shard-{part:07d}"], "docs": [n_docs], "ids": [n_ids]})

    number = F.col(key).cast("long")  # null keys are marked beside: pandas would make floats of a column with nulls
    keyed = docs.select(number.isNotNull().alias("given"), F.coalesce(number, F.lit(0)).alias("key"), F.col(text).alias("text"))
    order = ["given", "key", "tie"]
    rows = keyed.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    shards = sorted(rows.mapInPandas(write, "part int, path string, docs long, ids long").collect(), key=lambda r: r["part"])
    out, start = [], 0
    for r in shards:
        out.append({"path": r["path"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    return out


def _chained(first: pd.DataFrame, rest: Iterator[pd.DataFrame], docs_of) -> Iterator[tuple[int | None, np.ndarray]]:
    yield from docs_of(first)
    for frame in rest:
        yield from docs_of(frame)


def read_shards(spark, shards: list[dict], digest: bool = False) -> DataFrame:
    """key, start, n_tokens and ids (or, for digest, the ids' crc32) of each document, read from the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = "ids_crc32" if digest else "ids"
        for frame in frames:
            for path, base in zip(frame["path"], frame["start"], strict=True):
                fs, at = filesystem(path)
                rows, size = [], 0
                with fs.open_input_file(at) as file:
                    for key, start, ids in Shard(file, file.size()).documents():
                        rows.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                        size += 50 if digest else 4 * len(ids)
                        if size > 8_000_000:
                            yield _frame(rows, last)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, last)

    schema = "key long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    if not shards:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return files.repartition(len(shards)).mapInPandas(read, schema)


def _frame(rows: list[tuple], last: str) -> pd.DataFrame:
    key, start, n, x = zip(*rows, strict=True)
    return pd.DataFrame({"key": pd.array(key, dtype="Int64"), "start": start, "n_tokens": n, last: pd.Series(x, dtype="int64" if last == "ids_crc32" else object)})
