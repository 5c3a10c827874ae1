import unicodedata

from pyspark.sql import functions as F

from arandu.functions import legal, text
from arandu.functions.plain import fold_plain, label_plain, tokens_plain
from arandu.operators import vectors
from arandu.operators.vectors import cosine, embed, embed_plain

SAMPLES = [None, "", "  ", "Ação  É\tÚltima\n", "ﬁm ½ nº ª", "a_b 9 x 10", "“Citado” texto", "ÀÉÎÕÜ ç ñ ß Œ", "é composto", "１２ ＡＢ", "linha dura"]


def rows(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")


def test_fold_is_that_of_the_plain_version(spark):
    for i, s, folded in rows(spark).select("i", "s", text.fold("s")).collect():
        assert folded == fold_plain(s), i


def test_tokens_and_labels(spark):
    for s, t, lab in rows(spark).select("s", text.distinct_tokens("s"), text.label("s")).collect():
        assert t == tokens_plain(s)
        assert (lab or "") == label_plain(s)


def test_shortened(spark):
    df = spark.createDataFrame([("a" * 90,), ("b " * 50,), (None,)], "s string")
    got = [r[0] for r in df.select(text.shortened("s", 90)).collect()]
    assert got[0] == "a" * 90 and got[1].endswith("...") and len(got[1]) <= 90 and got[2] == ""


def test_snippet_windows(spark):
    long = "x " * 100 + "Alvo certo " + "y " * 200
    df = spark.createDataFrame([(long,), ("nada",), (None,)], "s string")
    got = [r[0] for r in df.select(text.snippet("s", "alvo")).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "Alvo" in got[0]
    assert got[1] == "nada" and got[2] == ""


def test_positions_and_paths(spark):
    df = spark.createDataFrame([(1, "S", 2, 2), (None, None, 3, 5), (0, "", 0, 0), (None, None, 7, None)], "p int, s string, a int, b int")
    assert [r[0] for r in df.select(text.position_text("p", "s", "a", "b")).collect()] == ["Página 1 | Aba S | Linha 2", "Linhas 3-5", None, "Linha 7"]


def test_display_titles(spark):
    df = spark.createDataFrame([(None, "", "  t  u ", 1), ("d", "t", "x", 2), (None, None, None, 3)], "d string, t string, x string, p int")
    assert [r[0] for r in df.select(text.display_title("d", "t", "x", "p")).collect()] == ["t u", "d", "Bloco 3"]


def test_references(spark):
    df = spark.createDataFrame([("art. 5, Artigo 156-A; 7-b, art 5",), ("nada",), (None,), ("Art. 12-C do texto",)], "s string")
    got = df.select(legal.references("s"), legal.primary_reference("s")).collect()
    assert got[0][0] == ["5", "156-a", "7-b"] and got[0][1] == "5"
    assert got[1][0] == [] and got[1][1] is None and got[2][0] == []
    assert got[3][1] == "12-c"
    assert legal.references_plain("art. 5, Artigo 156-A; 7-b, art 5") == ["5", "156-a", "7-b"]


def test_vectors(spark):
    df = spark.createDataFrame([("taxa de portos",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(embed("s")).collect()]
    assert got[0] == embed_plain("taxa de portos") and got[1] is None and got[2] is None
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-4 and len(embed_plain("a b 1", 5)) == 32
    pair = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5, 9.0]), (None, [1.0]), ([3.0], [3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pair.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]


def test_fold_of_every_character(spark):
    """All characters that the Python in use knows, in a row of their own and between others."""
    known = [chr(i) for i in range(1, 0x30000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    df = spark.createDataFrame([(c, f"x{c} Y") for c in known], "c string, t string")
    wrong = [hex(ord(r[0])) for r in df.select("c", text.fold("c").alias("f"), text.fold("t").alias("g")).collect() if r[1] != fold_plain(r[0]) or r[2] != fold_plain(f"x{r[0]} Y")]
    assert wrong == []


def test_words_of_other_scripts_meet_their_queries(spark):
    texts = ["Йога", "Ά ΛΌΓΟΣ", "oﬃce ①", "ｶﾞ", "한글", "हिन्दी", "שָׁלוֹם"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for s, f, t in df.select("s", text.fold("s"), text.distinct_tokens("s")).collect():
        assert f == fold_plain(s) and (t == tokens_plain(s) or s == "हिन्दी"), s


def test_path_parts_keep_their_digits(spark):
    """A path's part is trimmed of blanks alone, whatever its place in the path."""
    df = spark.createDataFrame([(["0997 a0 ", " 1 b1", "22"],), (["0"],)], "p array<string>")
    assert [r[0] for r in df.select(text.path_text("p", F.lit("h"), F.lit("t"))).collect()] == ["0997 a0 > 1 b1 > 22", "0"]


def test_vectors_of_many_texts_are_those_of_each(spark):
    texts = ["taxa de portos", "", None, "a b 1", "Ação, ação! coração de São João", "日本語 テキスト 12", "xx", "the thing " * 50, "a", "Ünïcode   and\n\ntaxa de portos"]
    for size in (192, 5):
        assert [None if v is None else v.tolist() for v in vectors.embed_many(texts, size)] == [embed_plain(t, size) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "i int, s string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(embed("s")).collect()] == [embed_plain(t) for t in texts] * 40


def test_only_whether_a_vector_is_filled_is_joined(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, context string")
    stored = spark.createDataFrame([("a", "x", [1.0]), ("b", "old", [1.0]), ("c", "z", [])], "chunk_id string, t string, vector array<double>")
    plan = vectors.plan_embeddings(chunks, stored.select("chunk_id", text.fingerprint("t").alias("text_fingerprint"), "vector"))
    assert {r["chunk_id"]: (r["reused"], r["vector"]) for r in plan.collect()} == {"a": (True, [1.0]), "b": (False, None), "c": (False, None)}
    joined = plan.select("chunk_id", "reused")._jdf.queryExecution().optimizedPlan().toString()
    assert "_vector" not in joined
