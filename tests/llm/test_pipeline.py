import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from arandu.llm import stages

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, sizes = {r["doc_id"]: r.asDict() for r in docs.collect()}, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = [r.asDict() for r in out.collect()]
        sizes.append(len(rows))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and all(whole[r["doc_id"]] == r for r in rows)
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
            docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        ids = library.encode(whole[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_unknown_languages_go_and_short_clean_texts_stay(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(1)

    def made(letters, words):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(words))

    scripts = ["".join(map(chr, range(lo, hi))) for lo, hi in ((0x430, 0x450), (0x3B1, 0x3CA), (0x627, 0x64B))]
    unknown = [made(s, 300) for s in scripts for _ in range(20)] + [made("abcdefghijklmnopqrstuvwxyz", n) for n in (30, 300) for _ in range(30)]
    clean = ["und der", "the thing and of the", "les des", "the", "der und die"]
    rows = [(-1 - i, t) for i, t in enumerate(unknown)] + [(-1001 - i, t) for i, t in enumerate(clean)] + [(-2000, "12 !?"), (-2001, None)]
    docs = known.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in stages.language_id(spark, docs, SF).select("doc_id").collect()}
    assert sum(i >= 0 for i in kept) == known.count()
    assert {i for i in kept if i < -1000} == {-1001 - i for i in range(len(clean))}
    assert sum(-1000 <= i < 0 for i in kept) <= 0.03 * len(unknown)


def test_without_labels_no_document_is_of_low_quality(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in {"empty": labels.limit(0), "others": labels.withColumn("doc_id", -1 - labels["doc_id"])}.items():
        rows.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert stages.quality(spark, docs, f"{tmp_path}/{name}").count() == docs.count()


def plain_language(texts, learned):
    """Languages by sums of trigram vectors, one trigram at a time; None where the stage rejects."""
    from math import sqrt

    import numpy as np

    from arandu.llm import hdc_langid as H

    def vector(code):
        return (np.random.default_rng([H.SEED, code]).integers(0, 2, H.DIM, dtype=np.int8).astype(int) * 2 - 1)

    letters, known = {}, {}

    def trigrams(text):
        own = "".join(c if c.isalpha() else " " for c in text.lower())
        own = f" {' '.join(own.split())} "
        return [own[i : i + 3] for i in range(len(own) - 2)] if own.strip() else []

    def bind(t):
        if t not in known:
            a, b, c = (letters.setdefault(x, vector(0 if x == " " else ord(x) + 1)) for x in t)
            known[t] = np.roll(a, 2) * np.roll(b, 1) * c
        return known[t]

    def bundle(text):
        out = np.zeros(H.DIM)
        for t, n in Counter(trigrams(text)).items():
            out += n * bind(t)
        norm = sqrt(out @ out)
        return out / norm if norm else out

    langs = sorted({lang for _, lang in learned})
    sums = [sum(bundle(t) for t, own in learned if own == lang) for lang in langs]
    noise = H.with_random_letters(H.Prototypes([], np.zeros((0, H.DIM)))).vectors[0]
    protos = np.array([*(v / sqrt(v @ v) for v in sums), noise])
    out = {}
    for key, text in texts.items():
        v = bundle(text or "")
        cosines = protos @ v
        n = len(re.sub(r"[\W\d_]+", " ", text or ""))
        least = min(stages.LEAST_COSINE, sqrt(n * stages.SAME_TRIGRAM / (1 + n * stages.SAME_TRIGRAM)) * stages.LEAST_PART)
        best = int(cosines.argmax())
        out[key] = langs[best] if v.any() and best < len(langs) and cosines[best] >= least else None
    return out


def plain_near(texts, percent=80):
    sets = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in texts}
    ids = [k for k in texts if sets[k]]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k for k in texts if label[k] == k}


def plain_mixing(rows):
    """Ids kept: cells raked round by round with dictionaries, the budget met by bisection."""
    from hashlib import md5

    def cell(r):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        bars, marks = (r["text"] or "").count("|"), (r["text"] or "").count("!")
        topic = "table" if bars * 8 > words else "exclamation" if marks * 8 > words else "note" if words < 100 else "article" if words < 800 else "long"
        return (r["source"] or "(none)", r["lang"] or "(none)", topic), words

    cells, of = Counter(), {}
    for r in rows:
        of[r["doc_id"]], words = cell(r)
        cells[of[r["doc_id"]]] += words
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    targets = []
    for k in range(3):
        own = Counter()
        for c, n in cells.items():
            own[c[k]] += n
        raised = {v: n**stages.ALPHA if n else 0.0 for v, n in own.items()}
        targets.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(60):
        for k in range(3):
            now = Counter()
            for c, n in cells.items():
                now[c[k]] += n * weight[c]
            for c in cells:
                if now[c[k]] > 0:
                    weight[c] *= targets[k][c[k]] * total / now[c[k]]
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * weight[c]) for c, n in cells.items()) < stages.KEEP * total else (low, mid)
    return {i for i, c in of.items() if int(md5(f"17:{i}".encode()).hexdigest()[:8], 16) / 2**32 < min(1.0, high * weight[c])}


def test_run_against_a_plain_version(spark):
    """Language, copies, mixing and ids by plain Python; the quality machine by its own score, one text at a time."""
    from arandu.llm.queries import quality_model

    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r.asDict() for r in table.collect()}
    learned = [(d["text"], d["lang"]) for i, d in docs.items() if crc32(str(i).encode()) % 5 and d["text"] and d["lang"]]
    langs = plain_language({i: d["text"] for i, d in docs.items()}, learned)
    docs = {i: d | {"lang": langs[i]} for i, d in docs.items() if langs[i]}
    model = quality_model(spark, spark.createDataFrame(list(docs.values()), table.schema), SF)
    docs = {i: d for i, d in docs.items() if model.score((d["text"] or "").encode(), [d["n_chars"]]) >= 0.7}
    near = plain_near({i: d["text"] for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if i in near}
    kept = plain_mixing([docs[i] for i in sorted(docs)])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {}
    for i in kept:
        ids = library.encode(docs[i]["text"] or "", add_special_tokens=False).ids
        expected[i] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected and len(got) > 20


def test_the_prediction_is_passed_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = stages.language_id(spark, unlabelled, SF).join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").where("doc_id % 3 = 0").collect()
    assert len(got) > 300 and sum(r["lang"] == r["own"] for r in got) / len(got) > 0.98


def test_stages_of_odd_tables(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None, None, None, None, 1, 2, 3), (None, None, None, None, None, 1, 2, 3), (-5, "", "en", "src1", 0, 1, 2, 3), (-6, "the cat and the dog " * 40, None, None, None, 1, 2, 3), (-6, "the cat and the dog " * 40, None, None, None, 1, 2, 3), (None, "a text of its own that no other one has " * 9, "en", "src1", 5, 1, 2, 3)]
    more = "doc_id long, text string, lang string, source string, n_chars long, Score int, langid int, component_id int"
    rows = table.selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) as n_chars", "1 as Score", "2 as langid", "3 as component_id").unionByName(spark.createDataFrame(odd, more))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, rows, str(tmp_path))
        got = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns and len(got) <= rows.count(), name
        if name == "MinHash near-dedup":
            texts = Counter(r["text"] for r in got)
            assert texts[odd[3][1]] == 1 and texts[odd[5][1]] == 1 and texts[None] >= 2
