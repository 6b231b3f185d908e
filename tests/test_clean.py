import pytest
from conftest import rows
from pyspark.sql import functions as F

from litsearch.functions.text import decode_entities, key_hash, strip, tokenize
from litsearch.operators import clean, profile


def test_drop_and_fill(spark):
    df = spark.createDataFrame(
        [(1, None, "u"), (2, "a", None), (3, None, None), (4, "", None), (5, "NA", "")],
        "id int, abstract string, url string",
    )
    kept = clean.drop_missing(df, ["abstract", "url"])
    assert rows(kept, "id") == [(1,), (2,), (4,), (5,)]
    assert rows(clean.fill_missing(kept), "id", "abstract", "url") == [
        (1, "", "u"), (2, "a", ""), (4, "", ""), (5, "NA", ""),
    ]


def test_clean_papers(spark):
    df = spark.createDataFrame(
        [(1, "t", "x", None, "a", "2020"), (2, None, "x", "u", "a", "2020"), (3, "t", None, None, "a", "2020"),
         (4, "t", "x", "u", None, "2020"), (5, "t", "x", "u", "a", None), (6, "t", None, "u", "a", "2020")],
        "id int, title string, abstract string, url string, authors string, publish_time string",
    )
    assert rows(clean.clean_papers(df), "id", "abstract", "url") == [(1, "x", ""), (6, "", "u")]


def test_fill_by_type(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, float("nan"), "s", 7)], "id int, d double, s string, n int"
    )
    assert rows(clean.fill_missing_typed(df), "id", "d", "s", "n") == [(1, -1.0, "", None), (2, -1.0, "s", 7)]
    flags = clean.missing_flags(df, ["d", "s", "n"])
    assert rows(flags, "d_missing", "s_missing", "n_missing") == [(True, False, False), (True, True, True)]
    assert rows(profile.null_report(df), "column", "n_missing") == [("d", 2), ("id", 0), ("n", 1), ("s", 1)]
    assert rows(profile.null_columns(df), "column") == [("d",), ("n",), ("s",)]
    assert rows(profile.null_cells(df, "id"), "id", "column") == [(1, "d"), (1, "n"), (1, "s"), (2, "d")]


@pytest.mark.parametrize("text, keywords, found", [
    ("Drug\n trial", ["drug"], True),
    ("a drugstore", ["drug"], False),
    ("drug", ["drug"], True),
    ("the drug.", ["drug"], False),
    ("the DRUG\t other", ["drug"], False),  # the words are joined by a no-break space
    ("x  DRUG\t y", ["drug"], True),
    ("one trial", ["drug trial"], True),
    ("a drug", ["Drug"], False),
    ("", ["drug"], False),
    ("a  b", [""], True),
    ("a b", [""], False),
    ("a.c x", ["a.c"], True),
    ("abc x", ["a.c"], False),
    ("a\\Eb x", ["a\\eb"], True),
    ("x", [], False),
    ("big drug small trial", ["trial"], True),
])
def test_keyword_match(spark, text, keywords, found):
    words = [w.lower().strip() for w in text.split(" ")]
    assert any(p in words for k in keywords for p in k.split(" ")) == found
    df = spark.createDataFrame([(text,)], "t string")
    assert clean.keyword_filter(df, "t", keywords).count() == int(found)


def test_contains_and_lookup(spark):
    df = spark.createDataFrame([(1, "a drug"), (2, "drags"), (3, None)], "id int, t string")
    assert rows(clean.contains_filter(df, "t", "drug"), "id") == [(1,)]
    assert rows(clean.contains_filter(df, "t", "dr[au]g", regex=True), "id") == [(1,), (2,)]
    assert rows(clean.lookup_equal(df, "id", 2), "t") == [("drags",)]


def test_clean_text(spark):
    df = spark.createDataFrame(
        [(1, "The viruses, and they were infecting cells!"), (2, "the"), (3, None)], "id int, t string"
    )
    lemmas = spark.createDataFrame([("viruses", "Virus"), ("infecting", "infect"), ("cells", "cell")], "form string, lemma string")
    cleaned = clean.clean_text(df, "id", "t", lemmas)
    assert rows(cleaned, "id", "cleaned") == [(1, "virus infect cell"), (2, ""), (3, "")]
    plain = clean.clean_text(df, "id", "t", stopwords=["the"])
    assert rows(plain.filter("id = 1"), "cleaned") == [("viruses and were infecting cells",)]


def test_stopwords(spark):
    df = spark.createDataFrame([("The cat and a dog",)], "t string")
    assert clean.stopword_filter(df, "t").first().tokens == ["cat", "dog"]
    assert clean.stopword_filter(df, "t", words=["cat"]).first().tokens == ["the", "and", "dog"]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Élan_2, x\n",)], "t string")
    row = df.select(
        tokenize(F.col("t")).alias("two"), tokenize(F.col("t"), 1).alias("one"), strip(F.col("t")).alias("s"),
        decode_entities(F.lit("&amp;lt; &lt;b&gt; &#39;")).alias("e"),
        key_hash(F.lit("1"), F.lit("23")).alias("h1"), key_hash(F.lit("12"), F.lit("3")).alias("h2"),
        key_hash(F.lit(None)).alias("none"), key_hash(F.lit("None")).alias("none_text"),
    ).first()
    assert row.two == ["élan_2"] and row.one == ["élan_2", "x"] and row.s == "Élan_2, x"
    assert row.e == "&lt; <b> '"
    assert row.h1 != row.h2 and row.none != row.none_text


def test_reports(spark):
    df = spark.createDataFrame([(1, "aé"), (2, "b"), (3, None)], "id bigint, t string").repartition(2)
    assert rows(profile.shape(df), "n_rows", "n_cols") == [(3, 2)]
    assert rows(profile.size_report(df), "column", "bytes") == [("t", 4)]
    assert rows(profile.schema_report(df), "position", "column", "type") == [(0, "id", "bigint"), (1, "t", "string")]
    parts = profile.partition_report(df).collect()
    assert sum(p.n_rows for p in parts) == 3 and sum(p.bytes for p in parts) == 4
    assert [tuple(r) for r in profile.value_counts(df.union(df.filter("id = 2")), "t").collect()][0] == ("b", 2)
