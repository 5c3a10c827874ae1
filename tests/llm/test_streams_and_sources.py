import base64
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from arandu.llm import bpe_transducer, crc_resample, divergence
from arandu.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "doc_id long, text string, lang string, source string, part string, rank long, score double, place string, term string"


def odd_rows(texts):
    return [(i if i % 5 else None, t, None if i % 3 == 0 else f"l{i % 2}", None if i % 4 == 0 else f"s{i % 3}", "x", 7, 1.0, "y", "z") for i, t in enumerate(texts)]


ODD_TEXTS = [None, "", " \n", "İç ÇA ça it's 日本", "tie tie tie", "tie tie tie", "a" * 3000, "A b c " * 7000, "\x00\x7f[`{ 0a9 ", "word"]


# Transducer


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged_by_rank(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_transducer_equals_merging_by_rank():
    rng = random.Random(3)
    for _ in range(150):
        ranks = {c.encode(): i for i, c in enumerate("abc")}
        while len(ranks) < 20:  # each new token is two neighbours of what the ranks so far make of a random piece
            made = merged_by_rank("".join(rng.choice("abc") for _ in range(9)).encode(), ranks)
            of = {i: t for t, i in ranks.items()}
            if len(made) > 1:
                i = rng.randrange(len(made) - 1)
                ranks.setdefault(of[made[i]] + of[made[i + 1]], len(ranks))
        machine = bpe_transducer.Transducer(ranks, most_states=rng.choice([2, 10, 10_000]))
        for _ in range(60):
            piece = "".join(rng.choice("aaabc") for _ in range(rng.randint(0, 24))).encode()
            expected = [ranks[piece]] if piece in ranks else merged_by_rank(piece, ranks)
            assert machine.encode(piece) == expected, (ranks, piece)


def test_tokens_that_no_merge_makes_stand_for_whole_pieces_alone():
    machine = bpe_transducer.Transducer({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"cba": 4})
    assert machine.encode(b"cba") == [4] and machine.encode(b"ccba") == [2, 2, 1, 0] and machine.encode(b"abc") == [3, 2]


def test_tokens_come_before_the_end_of_a_long_piece():
    machine = bpe_transducer.codec(RANKS, public_tokenizers.PATTERN).machine
    state, emitted, at = 0, 0, []
    for byte in b"internationalisation" * 40:
        state, out = machine.arcs[state].get(byte) or machine._arc(state, byte)
        emitted += len(out)
        at.append(emitted)
    assert max(len(held) for guesses in machine.guesses for _, _, held in guesses) < 8 and at[-1] > 70
    assert all(at[i + 40] > at[i] for i in range(len(at) - 40))


def test_transducer_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op13_bpe_transducer"](spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())


def test_codec_of_every_character_and_odd_texts(spark, library):
    own, rng = bpe_transducer.codec(RANKS, public_tokenizers.PATTERN), random.Random(4)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000, 7))]
    texts = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + [" x".join(every[i : i + 500]) for i in range(0, 0x3000, 500)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for letters in ("ab", "aeo stnr'd", " \n\tx", "019 .", "=-_*#") for _ in range(300)]
    texts += ["<|endoftext|> a<|endoftext|>", "a\x1cb \x85 c", " " * 2000, "z" * 5000, "ab" * 3000]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids and own.decode(ids) == t, t[:50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *texts[-5:]])], "doc_id long, text string").repartition(3)
    ids = docs.withColumn("ids", bpe_transducer.encode_column("text", RANKS, public_tokenizers.PATTERN)).withColumn("back", bpe_transducer.decode_column("ids", RANKS, public_tokenizers.PATTERN))
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") and r["back"] == (r["text"] or "") for r in ids.collect())


def test_streaming_decoder_holds_back_unfinished_characters():
    data = "aé日𝄞z".encode()
    for cut in range(len(data) + 1):
        text, rest = bpe_transducer.fed(b"", data[:cut])
        more, end = bpe_transducer.fed(rest, data[cut:])
        assert text + more == "aé日𝄞z" and not end and len(rest) < 4
    rng = random.Random(5)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xA0, 0xC2, 0xC0, 0xE0, 0xED, 0xE6, 0xF0, 0xF4, 0xF1, 0x9F, 0x8F, 0x90]) for _ in range(rng.randint(0, 9)))
        decoder = bpe_transducer.Decoder({i: bytes([i]) for i in range(256)})
        assert "".join(decoder.text([b]) for b in data) + decoder.end() == data.decode("utf-8", "replace"), data


def test_transducer_on_odd_tables(spark, library):
    docs = spark.createDataFrame(odd_rows(ODD_TEXTS), ODD)
    rows = bpe_transducer.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(r["n_tokens"] for r in rows) == Counter(len(library.encode_ordinary(t or "")) for t in ODD_TEXTS)
    assert bpe_transducer.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Resampling


def test_ring_of_crc_states_equals_hashing_each_run():
    rng = random.Random(6)
    for n in (1, 2, 3, 5):
        words = [bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 4))) for _ in range(50)]
        runs = [b" ".join(words[i : i + k]) for i in range(50) for k in range(1, n + 1) if i + k <= 50]
        assert Counter(crc_resample.run_hashes(words, n)) == Counter(map(crc32, runs))
    for buckets in (7, 10_000, 70_000):
        hashes = crc_resample.run_hashes(words, 3)
        assert crc_resample.unpacked(crc_resample.packed(hashes, buckets), buckets).tolist() == sorted(h % buckets for h in hashes)
    assert crc_resample.packed([], 9) == b"" and crc_resample.words_of(None) == []
    assert crc_resample.words_of("Aß-9Z\x00İ_`q".encode()) == ["aß".encode(), b"9z", "İ".encode(), b"q"]


def test_resampling_of_odd_tables(spark):
    docs = spark.createDataFrame(odd_rows(ODD_TEXTS) + odd_rows(["b c a " * 30, "b c a " * 30, "x y z " * 9]), ODD).repartition(4)
    target = spark.createDataFrame([("a b c a b c",), (None,), ("",)], "text string")
    rows = crc_resample.resample(docs, target, percent=60, least_words=3).collect()
    assert len(rows) == 13
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    fit = [t for t in [*ODD_TEXTS, "b c a " * 30, "b c a " * 30, "x y z " * 9] if len(crc_resample.words_of((t or "").encode())) >= 3]
    assert [r["rank"] for r in drawn] == list(range(1, 60 * len(fit) // 100 + 1))
    assert all(a["score"] >= b["score"] for a, b in zip(drawn, drawn[1:], strict=False))
    assert all((r["n_features"], r["weight"]) == (0, 0) for r in rows if not r["n_features"])
    assert crc_resample.resample(docs.limit(0), target).count() == 0
    alone = crc_resample.resample(docs, target.limit(0), percent=100, least_words=0)
    assert alone.where("rank is null").count() == 0 and alone.agg(F.max("rank")).first()[0] == 13


def test_resampling_prefers_what_is_like_the_target(spark):
    docs = spark.createDataFrame([(i, f"port ship sea wave {i} " * 12 if i % 10 == 0 else f"tax law form rule {i} " * 12) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("ship sea wave port ship sea " * 20,)], "text string")
    drawn = [r["doc_id"] for r in crc_resample.resample(docs, target, percent=10).where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) > 36


# Divergence


def plain_audit(rows, least, most):
    """lang, source, part, item, value, rank in plain Python, for rows of (text, lang, source)."""
    rows = [tuple((x or "") for x in r) for r in rows]
    docs, n = Counter(), Counter()
    for text, lang, source in rows:
        terms = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode()).decode().split(" ")
        terms = [t for t in terms if t]
        docs.update({(lang, t) for t in terms})
        n.update((lang, source, t) for t in terms)
    out = []
    for lang in {r[1] for r in rows}:
        sources, kept = sorted({r[2] for r in rows if r[1] == lang}), sorted(t for (x, t), d in docs.items() if x == lang and d >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share({t: n[lang, s, t] for t in kept}) for s in sources}
        q = share({t: sum(n[lang, s, t] for s in sources) for t in kept})
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s, t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("width", "block"), [(1024, 256), (3, 2)])
def test_divergence_equals_plain_counts(spark, width, block):
    rng = random.Random(7)
    words = ["Ab", "ab", "é", "z", "日本", "it's", "x1y", "Ünd", "und", "\x7fq"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["a", "b", None, ""]), rng.choice(["s", "S", "t", None, "é", "u"])) for _ in range(150)]
    rows += [(None, "empty", "s"), ("", "empty", "t"), ("rare", "b", "own"), ("ab " * 4000, "a", "s")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, item string, value long").repartition(5)
    found = divergence.audit(docs, least_docs=6, most=3, width=width, block=block).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 6, 3)


def test_divergence_of_odd_tables(spark):
    docs = spark.createDataFrame(odd_rows(ODD_TEXTS), ODD)
    found = sorted(map(tuple, divergence.audit(docs, least_docs=1).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert found == plain_audit([(r[1], r[2], r[3]) for r in odd_rows(ODD_TEXTS)], 1, 50)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_and_shares_stay_exact():
    n = np.array([2**53 + 1, 2**53 + 1, 3], np.int64)
    assert divergence.summed(np.array([1, 1, 0]), n, 2).tolist() == [3, 2 * (2**53 + 1)]
    for count, total in ((0, 7), (10**14, 3 * 10**15 + 1), (8 * 10**15, 9 * 10**15)):
        assert divergence.shares(np.array([count]), total).tolist() == [1 + 10**9 * (count + 5) // total]
