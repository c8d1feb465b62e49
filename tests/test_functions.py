import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import EngineConfig, bm25_parameters, collection_name, prf_options
from quarry.functions import citations as C
from quarry.functions import text as X
from quarry.functions.stem import stem
from quarry.functions.vectors import HttpEmbedder, VocabularyEmbedder, checked_unit, embedded, embedder, hash_embedding
from quarry.operators.rag import clean_query


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_analysis(spark):
    got = one(spark, "The RETRIEVAL systems don't die. Straße_x 7", X.analyzed)
    assert [(r["position"], r["term"]) for r in got] == [(1, "retrieval"), (2, "systems"), (3, "don't"), (4, "die"), (5, "strasse")]
    assert one(spark, "x 4 y", lambda t: X.terms(t, 1)) == ["x", "4", "y"]


@pytest.mark.parametrize("word,expected", [("retrieval", "retriev"), ("retrieving", "retriev"), ("cosine", "cosin"), ("systems", "system"), ("documents", "document"), ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("rational", "ration"), ("formalize", "formal"), ("adjustable", "adjust"), ("controll", "control"), ("sky", "sky"), ("dying", "die")])
def test_stems(word, expected):
    assert stem(word) == expected


def chunks(spark, text, size, overlap):
    return one(spark, text, lambda t: X.chunks(t, size, overlap))


def test_chunks(spark):
    text = "zero one two three four five\nsix  seven eight nine ten eleven"
    got = chunks(spark, text, 5, 2)
    assert [c["position"] for c in got] == [0, 1, 2, 3]
    assert [c["token_count"] for c in got] == [5, 5, 5, 3]
    assert all(text[c["char_start"] : c["char_end"]] == c["text"] for c in got)
    assert got[1]["text"].split() == ["three", "four", "five", "six", "seven"]
    assert chunks(spark, "", 5, 2) == [] and chunks(spark, None, 5, 2) == [] and len(chunks(spark, "  a b ", 5, 2)) == 1


def test_normalised_and_segments(spark):
    assert one(spark, " a \t b\0\r\n\n\n\n c ", X.normalised) == "a b\n\nc"
    rows = spark.sql("select array(named_struct('text', ' ab ', 'char_start', 0), named_struct('text', ' ', 'char_start', 0), named_struct('text', 'cde', 'char_start', 0)) as s")
    got = rows.select(X.assembled(F.col("s")).alias("s")).withColumn("t", X.assembled_text(F.col("s"))).first()
    assert [(s["text"], s["char_start"]) for s in got["s"]] == [("ab", 0), ("cde", 4)] and got["t"] == "ab\n\ncde"


def test_small_formatters(spark):
    assert one(spark, "<THINK>a\nb</think> hi ", X.without_thinking) == "hi"
    assert one(spark, "a [1] b [n2]", X.without_markers) == "a b"
    assert one(spark, "x [2][n1] [2]", X.cited_numbers) == [2, 1]
    assert one(spark, "\n \n'Query: best  rank'\nmore", X.cleaned_query) == "best  rank"
    assert clean_query("<think>x</think>\n\"Search query: abc\"\nzzz") == "abc"
    assert one(spark, "Ranking the ranks", lambda t: X.highlighted(t, F.array(F.lit("rank")))) == "<mark>Ranking</mark> the <mark>ranks</mark>"
    assert one(spark, "https://u@Ex.Org:80/p", X.host) == "ex.org"


@pytest.mark.parametrize("given_text,expected", [("X. [1]", "X [1]."), ("X [1]", "X [1]."), ("X [1].", "X [1]."), ("A [1]. B [2].", "A [1].\nB [2]."), ("A. [1] B. [2]", "A [1].\nB [2]."), ("A. B [1].", "A. B [1]."), ("A. B [1]. C. D [2].", "A. B [1].\nC. D [2].")])
def test_normalised_prose(given_text, expected):
    assert C.normalise_prose(given_text) == expected
    assert C.is_covered(expected, 2)


@pytest.mark.parametrize("bad", ["No citation.", "A [1]. Trailing.", "[1].", "Mid [1] sentence.", "Out [9].", "A [source].", "# Head [1].", "One. Two. Three [1].", "", "INSUFFICIENT_EVIDENCE", "A.\n\nB [1].", "| a | b [1].\nC [1].", "$$x$$\nB [1].", "- one.\n- two [1]."])
def test_not_covered(bad):
    assert not C.is_covered(C.normalise_prose(bad), 2)


def test_covered_variants():
    assert C.is_covered("A wrapped\nline of prose [1].", 1)
    assert C.is_covered("- One. Two [1].", 1) and not C.is_covered("One. Two [1].", 1, 1) and C.is_covered("One. Two. Three [1].", 1, 3)
    assert C.is_covered("I.R. works [1].", 1, 1) and C.is_covered("It rose 1.5 points [1].", 1, 1)


@pytest.mark.parametrize("given_text,expected", [("Claim [1, 2].", "Claim [1][2]."), ("Claim.[1,2]", "Claim.[1][2]"), ("Claim [1 ,  2]", "Claim [1][2]"), ("Claim [1,].", "Claim [1,]."), ("Claim [,2].", "Claim [,2]."), ("Claim [1,,2].", "Claim [1,,2]."), ("Claim [1, 0].", "Claim [1, 0]."), ("The array [1, 2] was sorted [1].", "The array [1, 2] was sorted [1]."), ("The array [1, 2]\nwas sorted [1].", "The array [1, 2]\nwas sorted [1].")])
def test_lists(given_text, expected):
    assert C.expand_lists(given_text) == expected


def test_validate():
    assert C.validate("A [9]. B [n1] [9].", 2) == ("A . B [1] .", ("[9]",))
    assert C.cited_numbers("x [2] [1] [2] [7]", 3) == [2, 1]
    assert C.link_parts("a [1]b") == [("a ", None), ("[1]", 1), ("b", None)]


@given(st.text(alphabet="ab .?![]123,\n-", max_size=40))
def test_citation_rules_hold_together(text):
    clean, _ = C.validate(text, 2)
    assert all(1 <= n <= 2 for n in C.cited_numbers(clean, 9))
    assert C.normalise_prose(C.normalise_prose(clean)) == C.normalise_prose(clean) or not C.is_covered(C.normalise_prose(clean), 2)


def test_vectors(spark):
    assert one(spark, "", hash_embedding) == [0.0] * 8
    got = one(spark, "ab ab b", hash_embedding)
    assert abs(sum(x * x for x in got) - 1) < 1e-12 and sum(x > 0 for x in got) == 2
    for bad in ([], [1.0, float("nan")], [0.0, 0.0], [True, 1.0], "x"):
        with pytest.raises(ValueError):
            checked_unit(bad)
    with pytest.raises(ValueError):
        checked_unit([1.0], 2)
    service = HttpEmbedder("http://x", "m", dims=2, send=lambda url, body: {"embedding": [3.0, 4.0]})
    assert service.embed_query("q") == [0.6, 0.8]
    with pytest.raises(ValueError):
        service.embed_query(" ")
    with pytest.raises(ValueError):
        embedder("nothing")
    rows = spark.createDataFrame([("neural database",)], "text string")
    assert [round(x, 3) for x in embedded(rows, "text", VocabularyEmbedder).first()["embedding"]] == [0.0, 0.707, 0.707]


def test_settings():
    assert EngineConfig.from_env({"QUARRY_CHUNK_SIZE": "20", "QUARRY_CHUNK_OVERLAP": "5"}).chunk_size == 20
    for bad in ({"chunk_size": 0, "chunk_overlap": 0}, {"chunk_size": 10, "chunk_overlap": 10}, {"bm25_k1": 0.0}, {"bm25_b": 1.1}, {"feedback_docs": 0}, {"prf_beta": -1.0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert bm25_parameters("default", 9, 0.1) == (1.5, 0.75) and bm25_parameters("finetuned", None, None, (2.0, 0.3)) == (2.0, 0.3) and bm25_parameters(None, 1.0, None) == (1.0, 0.75)
    assert prf_options(EngineConfig(), max_expansion_terms=3, expansion_terms=4)["expansion_terms"] == 3
    assert collection_name("local", "org/All-Mini-L6", 384) == "local_all_mini_l6_384"


def test_error_text():
    assert X.error_text({"detail": "no"}) == "no" and X.error_text({"detail": [{"msg": "a"}, {"msg": "b"}]}) == "a; b"
    assert X.error_text({"message": "m"}) == "m" and X.error_text(None) == "The request failed."
