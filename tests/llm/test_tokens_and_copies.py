import io
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arandu.llm import bitpack, components, ipf_mix, oph_dedup, pca_dedup
from arandu.llm.bpe_automaton import Automaton, codec
from arandu.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_bpe(word, merges):
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_automaton_equals_merging():
    rng = random.Random(1)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 14:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        machine = Automaton({c: vocab[c] for c in "abc"}, vocab, merges)
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [machine.label[i] for i in machine.encode(word)] == plain_bpe(word, merges)


def test_codec_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe_automaton"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    own = codec(path)
    for t in [None, "", " ", "Hi<|endoftext|>x", "İ ΣΑΣ", "日本", "don't 3½ ²", "a\x1cb", "z" * 3000]:
        assert own.encode(t).tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for bits in (1, 7, 16, 17, 31):
        x = rng.integers(0, 1 << bits, 5000)
        assert (bitpack.unpack(bitpack.pack(x, bits), bits)[:5000] == x).all()
    docs = [(None, np.arange(3)), (5, np.zeros(0, int)), (9, rng.integers(0, 50_000, 200_000)), (10, np.array([7]))]
    out = io.BytesIO()
    assert bitpack.write_shard(out, 16, iter(docs)) == (4, 200_004)
    shard = bitpack.Shard(out, len(out.getvalue()))
    assert [(k, s, i.tolist()) for k, s, i in shard.documents()] == [(None, 0, [0, 1, 2]), (5, 3, []), (9, 3, docs[2][1].tolist()), (10, 200_003, [7])]
    assert shard.document(3).tolist() == [7] and shard.ids(70_000, 70_005).tolist() == docs[2][1][69_997:70_002].tolist()


def test_token_shards(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got, start = {r["doc_id"]: r for r in QUERIES["op4_token_shards"](spark, SF).collect()}, 0
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)


def test_token_shards_edge_cases(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "a"), (3, None), (1, ""), (2, "b  c\n d <|endoftext|> 日本"), (2, "b")], "doc_id long, text string")
    shards = bitpack.write_shards(docs, f"file://{tmp_path}/s", path, None)
    got = sorted((r["start"], r["key"], r["n_tokens"]) for r in bitpack.read_shards(spark, shards).collect())
    library = Tokenizer.from_file(path)
    sizes = [len(library.encode(t, add_special_tokens=False).ids) for t in ("a", "", "b", "b  c\n d <|endoftext|> 日本", "")]
    assert sum(sizes) == sum(g[2] for g in got) and len(got) == 5
    assert bitpack.write_shards(docs.limit(0), f"file://{tmp_path}/e", path, 2) == [] and bitpack.read_shards(spark, []).count() == 0


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_texts():
    """Chains, exact copies, a large group whose members differ by one to six words, short and empty texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    texts |= {200 + i: " ".join(f"z{j}" for j in range(i, i + 60)) for i in range(0, 12)}
    texts |= {300: None, 301: "", 302: " \t", 303: "A b", 304: "a B", 305: "a b c", 306: "x y z u v", 307: "X Y Z U V"}
    return texts | {400 + i: texts[3] for i in range(20)} | {500: "long " + " ".join(f"q{i % 977}" for i in range(30_000))}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(spark, percent):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_shingles int")
    sets = plain_sets(texts)
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = plain_components(texts, links)
    got = oph_dedup.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert oph_dedup.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in oph_dedup.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, None)]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 32))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(scale=0.05 + 0.25 * (i % 3), size=32) * 0.6
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(200 + i, rows[5][1], 1) for i in range(6)]
    rows += [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] * 32, 1), (303, rows[4][1], None), (304, [], 0), (305, [1.0, 2.0], 0), (306, [None] * 32, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, dims string")
    fine = {i: (np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and cos(fine[a][0], fine[b][0]) >= 0.93]
    label, n = plain_components([r[0] for r in rows], links), Counter(x for pair in links for x in pair)
    assert len(links) > 100
    for r in pca_dedup.near_duplicates(df).collect():
        assert (r["n_links"], r["component_id"]) == (n[r["vec_id"]], label[r["vec_id"]]), r
    assert pca_dedup.near_duplicates(df.limit(0)).count() == 0


def test_residual_bound_loses_nothing():
    rng = np.random.default_rng(8)
    raw = np.concatenate([rng.normal(size=(300, 48)), rng.normal(size=(20, 48)).repeat(6, axis=0) + rng.normal(scale=0.1, size=(120, 48))])
    unit = pca_dedup.unit_rows(raw)
    i, j = pca_dedup.compare(raw, None, pca_dedup.principal_axes(raw), 0.93)
    expected = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and expected


def test_raking_meets_all_marginals(spark):
    rng = np.random.default_rng(4)
    shape = (5, 3, 2)
    tokens = rng.integers(50, 900, shape).astype(float).ravel()
    margins = [g.ravel() for g in np.indices(shape)]
    targets = [rng.dirichlet(np.ones(n) * 5) for n in shape]
    weight = ipf_mix.rake(tokens, margins, targets)
    for at, share in zip(margins, targets, strict=True):
        assert np.allclose(np.bincount(at, tokens * weight) / tokens.sum(), share, atol=1e-6)
    p = ipf_mix.calibrate(tokens, weight, 0.5 * tokens.sum())
    assert p.max() <= 1 and (p * tokens).sum() == pytest.approx(0.5 * tokens.sum())


def test_mixing_by_tables_equals_the_driver(spark):
    cells = spark.createDataFrame([(s, g, t, (i * 37) % 11 * 10 + 10) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    key = lambda df: {(r["source"], r["lang"], r["topic"]): r for r in df.collect()}
    one, two = key(ipf_mix.cell_probabilities(cells, None, 0.5, 0.6)), key(ipf_mix._raked_as_tables(cells, None, 0.5, 0.6))
    assert all(one[k]["probability"] == pytest.approx(two[k]["probability"], abs=1e-6) for k in one)


def test_mixing(spark):
    rows = QUERIES["op2_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    kept = sum(r["n_tokens"] for r in rows if r["selected"])
    assert kept == pytest.approx(0.6 * sum(r["n_tokens"] for r in rows), rel=0.1)
    assert sum(r["probability"] * r["n_tokens"] for r in rows) == pytest.approx(0.6 * sum(r["n_tokens"] for r in rows), rel=1e-3)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None, None, 3, "t"), (2, "a", "en", None, "t"), (2, "a", "en", 5, "t")], "doc_id long, source string, lang string, n int, weight string")
    got = ipf_mix.mix(docs, F.col("n"), F.lit("t")).collect()
    assert len(got) == 3 and all(0 <= r["probability"] <= 1 for r in got)
    assert ipf_mix.mix(docs.limit(0), F.col("n"), F.lit("t")).count() == 0


def test_round_trip_of_odd_tables(spark):
    from arandu.llm.bpe_automaton import round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", 1)], "doc_id long, text string, bpe string, N_TOKENS int")
    got = sorted(tuple(r) for r in round_trip(docs, path).collect())
    assert len(got) == 3 and got[0] == got[1] and got[2][1] == 0
    assert round_trip(docs.limit(0), path).count() == 0


def test_shards_of_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b " + "z" * 5000, "k", 1), (big, "a b " + "z" * 5000, "k", 1), (None, "c", "k", 1), (big + 1, None, "k", 1)], "doc_id long, text string, key string, ids int")
    got = sorted(bitpack.read_shards(spark, bitpack.write_shards(docs, f"{tmp_path}/s", path, 2)).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in got] == [None, big, big, big + 1] and got[1]["ids"] == got[2]["ids"] and got[3]["ids"] == [2]
    assert bitpack.filesystem("dbfs:/a/b")[1] == "/dbfs/a/b" and bitpack.filesystem("file:///a")[1] == "/a"


def test_raking_of_sparse_cells_and_of_unmet_targets(spark, monkeypatch):
    monkeypatch.setattr(ipf_mix, "ROUNDS", 3)  # the same in both ways, however far they have come
    rng = np.random.default_rng(6)
    names = sorted({(f"s{rng.integers(30)}", f"g{rng.integers(12)}", f"t{rng.integers(6)}") for _ in range(150)})
    cells = spark.createDataFrame([(*n, int(rng.integers(1, 5000))) for n in names], "source string, lang string, topic string, tokens long")
    key = lambda df: {(r["source"], r["lang"], r["topic"]): r for r in df.collect()}
    with pytest.warns(UserWarning, match="cannot meet"):
        one, two = (key(ipf_mix.cell_probabilities(cells, None, 0.7, 0.6, driver_cells=n)) for n in (1000, 1))
    assert max(abs(one[k]["probability"] - two[k]["probability"]) for k in one) < 1e-8 and len(one) == len(two) == len(names)
    apart = spark.createDataFrame([("a", "x", "t", 70), ("b", "y", "t", 30)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"t": 1.0}}
    for n in (1000, 1):
        with pytest.warns(UserWarning, match="cannot meet"):
            got = ipf_mix.cell_probabilities(apart, targets, 0.5, 0.6, driver_cells=n).collect()
        assert got[0]["marginal_gap"] > 0.1
    with pytest.raises(ValueError, match="cannot meet"):
        ipf_mix.cell_probabilities(apart, targets, 0.5, 0.6, strict=True)


def test_samples_are_bounded_and_never_vanish(spark):
    from pyspark.sql import functions as F

    from arandu.llm.common import bounded, hash_fraction

    df = spark.range(20_000).select((F.col("id") % 7_000).alias("k"))
    some = bounded(df, 500, F.col("k"))
    assert some.count() == 500 and some.columns == ["k"]
    assert bounded(spark.range(9_000).select(F.lit(1).alias("k")), 500, F.col("k")).count() == 500
    assert 700 < spark.range(100_000).where(hash_fraction(0.01, F.col("id"))).count() < 1300
    text = spark.range(1).select(hash_fraction(1e-9, F.col("id")))._jdf.queryExecution().analyzed().toString()
    assert str(int(1e-9 * (1 << 63))) in text  # not zero


def test_a_shared_folder_is_asked_for(spark):
    from arandu.llm import common

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    assert common.shared_dir(spark).endswith("/tmp/checkpoints")


def test_shard_words_of_late_outlast_a_full_cache(monkeypatch):
    monkeypatch.setattr(bitpack, "CACHE_WORDS", 40)
    own = bitpack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    calls, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: (calls.extend(chunks), learn(chunks)))
    texts = [f"the cat w{k}x{i}  and\tthe dog\n end w{i}" for k in range(4) for i in range(8)] + [f" v{i} u{i}" for i in range(40)] + ["", " ", "a\0b c"]
    for t in texts:
        assert own.encode([t])[0].tolist() == own.library.encode(t, add_special_tokens=False).ids
    assert calls.count(" dog") == calls.count("the") == calls.count("") == 1 and len(own.kept) + len(own.before) <= 40
