"""Hand-written cases of sentences, chunks, normalizers and scalars."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import english, finnish
from weftline.functions import scalars as S
from weftline.functions.matching import best_match
from weftline.functions.sentences import chunk_text, split_sentences
from weftline.operators import normalize as N
from weftline.operators import text as X
from weftline.sources import books as B

EN = [
    ("Jan 5, 1901", "January fifth nineteen oh one"), ("5 January 1901", "the fifth of January nineteen oh one"), ("1/5/2020", "January fifth twenty twenty"), ("2020-01-05", "January fifth twenty twenty"),
    ("May 1, 1945", "May first nineteen forty-five"), ("3:15", "three fifteen"), ("8:05", "eight oh five"), ("15:00", "fifteen hundred hours"), ("12:00", "twelve o'clock"), ("0:00", "zero hundred hours"),
    ("(555) 123-4567", "five five five, one two three, four five six seven"), ("1-800-555-1234", "one, eight zero zero, five five five, one two three four"),
    ("+44 555 123 4567", "plus four four, five five five, one two three, four five six seven"), ("user@example.com", "user at example dot com"), ("https://example.com/path", "https example dot com slash path"),
    ("www.example.com", "w w w dot example dot com"), ("the FBI investigated", "the F B I investigated"), ("the NASA launch", "the NASA launch"), ("Louis XIV ruled.", "Louis the fourteenth ruled."),
    ("21st 100th", "twenty-first one hundredth"), ("$5.99", "five dollars and ninety-nine cents"), ("£3.50", "three pounds and fifty pence"), ("32 °F", "thirty-two degrees Fahrenheit"), ("-5", "minus five"),
    ("3.14", "three point one four"), ("1/2 3/4 2/3 1/16", "one half three quarters two thirds one sixteenth"), ("1,234", "one thousand, two hundred and thirty-four"), ("", ""),
]
FI = [
    ("42", "neljäkymmentä kaksi"), ("1500", "tuhat viisisataa"), ("sivulta 42", "sivulta neljältäkymmeneltä kahdelta"), ("luvussa 3", "luvussa kolmessa"), ("rivillä 12", "rivillä kahdellatoista"), ("5 kertaa", "viisi kertaa"),
    ("vuodesta 1917 alkaen", "vuodesta tuhat yhdeksänsataa seitsemäntoista alkaen"), ("klo 20:30", "kello kaksikymmentä kolmekymmentä"), ("5 %", "viisi prosenttia"), ("$5", "viisi dollaria"), ("20 °C", "kaksikymmentä celsiusastetta"),
    ("Kustaa II Aadolf oli kuningas", "Kustaa toinen Aadolf oli kuningas"), ("IIII", "I I I I"), ("EU:n", "Euroopan unioni:n"), ("DVD CPU", "D V D C P U"), ("RAJAT", "RAJAT"), ("Leidenissä", "Leidenissä"), ("a   b", "a b"),
]


@pytest.mark.parametrize("text,want", EN)
def test_english(text, want):
    assert english.normalize(text) == want


@pytest.mark.parametrize("text,want", FI)
def test_finnish(text, want):
    assert finnish.normalize(text) == want


def test_finnish_full_years():
    assert finnish.normalize("vuosina 1914-1918", full_years=True).count("tuhantena") == 2


@pytest.mark.parametrize("name,text", [("dates", "Feb 30, 1901"), ("dates", "2020-13-05"), ("time", "25:99"), ("time", "24:00"), ("fractions", "1/0"), ("phones", "123-4567"), ("phones", "15551234567")])
def test_left_alone(name, text):
    assert english.run_pass(name, text) == text


@pytest.mark.parametrize("n", [0, 7, 10, 99, 100, 101, 999, 1000, 1001, 1999, 12345, 10**6, 10**9 + 1])
def test_numbers_are_words(n):
    assert not any(c.isdigit() for c in english.cardinal(n) + english.ordinal(n) + finnish.cardinal(n) + finnish.cardinal(n, "illative"))


def test_unsupported_language():
    with pytest.raises(N.UnsupportedLanguage):
        N.normalizer("de")


def test_null_and_other_languages(spark):
    df = spark.createDataFrame([("en", "5"), ("FI", "5"), ("de", "5"), ("en", None), (None, "5")], "lang string, t string")
    got = [r[0] for r in df.select(N.by_language(F.col("t"), F.col("lang"))).collect()]
    assert got == ["five", "viisi", "5", None, "5"]


@pytest.mark.parametrize("text,n", [("Tämä on esim. lause. Toinen lause.", 2), ("See Dr. Smith. He is a professor.", 2), ("Mitä?! Hän kysyi.", 2), ("They met Dr.", 1), ("Versio 5.2 on ulkona.", 1), ("Odota... Nyt.", 2), ("", 0), ("H. Pihla tuli.", 1)])
def test_sentences(text, n):
    assert len(split_sentences(text)) == n


def test_chunks():
    text = " ".join(f"Sentence number {i} has some words." for i in range(300))
    got = chunk_text(text, 200)
    assert " ".join(got) == text and max(map(len, got)) <= 200
    assert chunk_text("a" * 500, 100) == ["a" * 500]
    assert chunk_text("  ") == [] == chunk_text(None)


def test_fold_equals_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.transform(X.simple_sentences(F.col("text")), lambda x: F.substring(x, 1, 250)).alias("s"))
    from weftline.functions.sentences import _pack

    for r in docs.select("s", X.packed(F.col("s"), 300).alias("p")).limit(50).collect():
        assert _pack(list(r["s"]), 300) == r["p"]


def test_cleaning(spark):
    raw = "Rivi yksi  \nvar- \nhaismoderni\n 12 \n\n\n\nAustro-\nHungarian käsit­\nteli\nSivu 7\nloppu"
    got = spark.createDataFrame([(raw,)], "t string").select(X.clean_text(F.col("t"))).first()[0]
    assert got == "Rivi yksi varhaismoderni\n\nAustro-Hungarian käsitteli\n\nloppu"


def test_chapters(spark):
    lines = ["intro text", "Chapter 1", "first", "THE END", "", "Chapter 2", "second"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "Chapter 1")], "doc_id long, n long, line string")
    got = [(r["doc_id"], r["idx"], r["title"], r["content"]) for r in X.split_chapters(df).orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0, "Alkusanat", "intro text"), (1, 1, "Chapter 1", "first"), (1, 2, "Chapter 2", "second"), (2, 0, "Kirja", "Chapter 1")]


@pytest.mark.parametrize("s,want", [(45.0, "45 s"), (60.0, "1 min 0 s"), (754.0, "12 min 34 s"), (3599.0, "59 min 59 s"), (3600.0, "1 h 0 min"), (4980.0, "1 h 23 min"), (0.0, "0 s"), (None, "?"), (2.5, "2 s"), (119.7, "2 min 0 s")])
def test_duration(spark, s, want):
    assert spark.createDataFrame([(s,)], "s double").select(S.format_duration(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("s,want", [("45s", 45), ("12m30s", 750), ("1h23m", 4980), ("3h", 10800), ("junk", 0)])
def test_hms(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(S.parse_hms(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("n,want", [(0, "A"), (1, "B"), (25, "Z"), (26, "AA"), (27, "AB")])
def test_labels(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(S.char_label(F.col("n"))).first()[0] == want


def test_best_match_compares_few_in_full(monkeypatch):
    import difflib
    import random

    from weftline.functions import matching

    rng, made = random.Random(3), []
    texts = ["".join(rng.choices("etaoin shrdlu", k=rng.choice((1, 9, 40, 199, 230, 600)))) for _ in range(150)] + ["same", "same", "", "  ", "a\U0010ffffb", "x" * 700]
    wanted = [t[::2] for t in texts[:12]] + ["".join(c for c in t if rng.random() < 0.9) for t in texts] + ["\U0010ffff", "qqq", "Same "]
    plain = []
    for w in wanted:
        a, best = w.strip().lower(), (-1, 0.0)
        for i, c in enumerate(texts):
            b = c.strip().lower()
            if a and b and (r := difflib.SequenceMatcher(None, a, b).ratio()) > best[1]:
                best = (i, r)
        plain.append(best)
    monkeypatch.setattr(matching, "SequenceMatcher", lambda *a: made.append(a) or difflib.SequenceMatcher(*a))
    assert [best_match(w, texts) for w in wanted] == plain
    assert len(made) <= 2 * len(wanted)
    monkeypatch.setattr(matching, "GRID", 0)
    assert [best_match(w, texts) for w in wanted] == plain


def test_best_match():
    assert best_match("hello", ["hi", "hello", "bye"]) == (1, 1.0)
    assert best_match("", ["a"]) == best_match("a", []) == (-1, 0.0)


def test_html():
    text, title = B.read_html("<title>t</title><script>var t='</p>';</script><h1>A  <b>b</b></h1><p>x &amp; y</p>")
    assert (text, title) == ("t A b x & y", "A b")


def test_broken_epub(spark):
    df = spark.createDataFrame([("a.epub", bytearray(b"junk"))], "path string, content binary")
    assert "cannot open" in B.epub_chapters(df).first()["error"]
