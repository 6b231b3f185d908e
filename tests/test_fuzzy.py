"""Edit distance against a brute-force Damerau-Levenshtein distance."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litsearch.functions.fuzzy import allowed_edits, fuzzy_match, matches_word, query_words, similar_terms


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (Lowrance and Wagner, 1975)."""
    last_row: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        last_col = 0
        for j in range(1, len(b) + 1):
            k, m = last_row.get(b[j - 1], 0), last_col
            cost = int(a[i - 1] != b[j - 1])
            if not cost:
                last_col = j
            d[i, j] = min(
                d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1,
                d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1),
            )
        last_row[a[i - 1]] = i
    return d[len(a), len(b)]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(3)
    short = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("abc", repeat=n)]
    mid = {"".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(1500)}
    long = {"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(20)}
    edited = set()
    for w in list(long)[:10] + ["erblets", "thtion"]:
        for _ in range(30):
            x = list(w)
            for _ in range(2):
                i, kind = rng.randrange(len(x) - 1), rng.randrange(4)
                if kind == 0:
                    x[i], x[i + 1] = x[i + 1], x[i]
                elif kind == 1:
                    del x[i]
                elif kind == 2:
                    x.insert(i, rng.choice("abcde"))
                else:
                    x[i] = rng.choice("abcde")
            edited.add("".join(x))
    return sorted(set(short) | mid | long | edited | {"reblest", "erblets", "the", "teh"})


WORDS = ["a", "ab", "abc", "teh", "abca", "abcdé", "abcdab", "erblets", "bcadbca", "aabbccd", "thtion"]


@pytest.mark.parametrize("word", WORDS)
def test_literal_word(spark, vocabulary, word):
    k = allowed_edits(word)
    df = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    got = {r.term for r in df.filter(matches_word(F.col("term"), word, k)).collect()}
    assert got == {t for t in vocabulary if distance(t, word) <= k}


def test_similar_terms_finds_all_pairs(spark, vocabulary):
    words = sorted(set(vocabulary[::60]) | set(WORDS))
    pairs = similar_terms(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(t,) for t in vocabulary], "term string"),
    )
    expected = [(w, t) for w in words for t in vocabulary if distance(t, w) <= allowed_edits(w)]
    assert rows(pairs, "word", "term") == sorted(expected, key=repr)


def test_fuzzy_match_columns(spark):
    df = spark.createDataFrame(
        [("teh", "the", 1), ("abc", "ca", 2), ("ca", "abc", 2), ("ca", "abc", 1), ("same", "same", 0),
         ("eta", "ate", 2), ("erblets", "reblest", 2), ("over", "under", 2)],
        "a string, b string, k int",
    )
    got = [r.m for r in df.select(fuzzy_match(F.col("a"), F.col("b"), F.col("k")).alias("m")).collect()]
    assert got == [distance(r.a, r.b) <= r.k for r in df.collect()]


def test_fixed_fuzziness(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("ac",)], "term string")
    pairs = similar_terms(spark.createDataFrame([("ab",)], "word string"), df, fuzziness=1)
    assert rows(pairs, "term") == [("ab",), ("abc",), ("ac",)]
    assert rows(similar_terms(spark.createDataFrame([("ab",)], "word string"), df, fuzziness=0), "term") == [("ab",)]


def test_rejects_three_edits():
    with pytest.raises(ValueError):
        matches_word(F.lit("x"), "word", 3)


def test_query_words():
    assert query_words("The  THING-to_do, Élan 2") == ["the", "thing", "to_do", "élan", "2"]
