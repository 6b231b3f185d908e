"""Row filters, missing values and text cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from litsearch.functions.text import WHITESPACE, missing, remove_stopwords, strip, tokenize
from litsearch.session import by_key

# A paper is kept when it has a title, an abstract or a url, an author and a date.
REQUIRED_COLUMNS = [["title"], ["abstract", "url"], ["authors"], ["publish_time"]]

# English pronouns, which cleaning removes.
PRONOUNS = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself we us our ours ourselves they them their theirs themselves"
).split()


def default_stopwords() -> list[str]:
    """Spark's English stop-word list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the rows in which every one of ``cols`` is missing."""
    return df.na.drop(how="all", subset=list(cols))


def fill_missing(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def fill_missing_typed(df: DataFrame) -> DataFrame:
    """Missing cells become -1 in float columns and '' in string columns."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    # na.fill also replaces NaN in float columns
    if floats:
        df = df.na.fill(-1.0, floats)
    return df.na.fill("", [c for c, t in df.dtypes if t == "string"])


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One boolean per column telling whether the cell is missing (null or NaN)."""
    types = dict(df.dtypes)
    return df.select("*", *[missing(F.col(c), types[c]).alias(f"{c}_missing") for c in cols])


def clean_papers(df: DataFrame, required: Sequence[Sequence[str]] = REQUIRED_COLUMNS) -> DataFrame:
    for cols in required:
        df = drop_missing(df, cols)
    return fill_missing(df)


def has_text(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def keyword_match(col: Column, keywords: Sequence[str]) -> Column:
    """True if any part of any keyword is a word of the text.

    Words are what single spaces separate, lower-cased and stripped; keywords are taken as they
    are, so one with a capital letter matches nothing. Told by one regular expression: a part
    between spaces or text ends, with only other white space around it.
    """
    parts = sorted({part for keyword in keywords for part in keyword.split(" ")})
    if not parts:
        return F.lit(False)
    quoted = "|".join("\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" for part in parts)
    blank = "[" + WHITESPACE.replace(" ", "") + "]*"
    return F.lower(col).rlike(f"(?:\\A| ){blank}(?:{quoted}){blank}(?: |\\z)")


def keyword_filter(df: DataFrame, col: str, keywords: Sequence[str]) -> DataFrame:
    return df.filter(keyword_match(F.col(col), keywords))


def contains_filter(df: DataFrame, col: str, needle: str, regex: bool = False) -> DataFrame:
    c = F.col(col)
    return df.filter(c.rlike(needle) if regex else c.contains(needle))


def lookup_equal(df: DataFrame, col: str, value: object) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def stopword_filter(
    df: DataFrame, col: str, out: str = "tokens", words: Sequence[str] | None = None
) -> DataFrame:
    words = default_stopwords() if words is None else words
    return df.withColumn(out, remove_stopwords(tokenize(F.col(col)), words))


def clean_text(
    df: DataFrame, key: str, col: str, lemmas: DataFrame | None = None,
    out: str = "cleaned", stopwords: Sequence[str] | None = None,
) -> DataFrame:
    """Words of ``col`` without stop words, punctuation and pronouns, as dictionary forms.

    ``lemmas`` holds (form, lemma) rows, one per form; a word it lacks stays as it is. Without
    lemmas the whole step is a projection. With them the words are looked up by a left join
    (broadcast when the dictionary's measured size is below Spark's limit, otherwise a shuffle
    that adaptive execution splits on heavy words) and put back together per ``key``.
    """
    words = default_stopwords() if stopwords is None else list(stopwords)
    dropped = sorted(set(words) | set(PRONOUNS))
    if lemmas is None:
        return df.withColumn(
            out, F.array_join(remove_stopwords(tokenize(F.col(col), 1), dropped), " ")
        )
    text = by_key(df.select(key, col), key)
    tokens = (
        text.select(key, F.posexplode(tokenize(F.col(col), 1)).alias("_pos", "_word"))
        .filter(~F.col("_word").isin(dropped))
    )
    # a form listed twice takes the alphabetically first of its lemmas
    forms = lemmas.groupBy(F.col("form").alias("_word")).agg(F.min(F.lower("lemma")).alias("_lemma"))
    word = strip(F.coalesce("_lemma", "_word"))
    texts = (
        tokens.join(forms, "_word", "left")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", word.alias("w")))).alias("_words"))
        .select(key, F.array_join(F.col("_words.w"), " ").alias(out))
    )
    return df.join(texts, key, "left").na.fill("", [out])
