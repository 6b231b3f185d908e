"""Text column expressions. Everything here is a Catalyst expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WORD_CHARS = r"[\p{L}\p{N}_]"

# What Python's str.strip() removes; Spark's trim() removes the space only.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def tokenize(col: Column, min_len: int = 2) -> Column:
    """Lower-cased words of at least ``min_len`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"{WORD_CHARS}{{{min_len},}}"), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def remove_stopwords(tokens: Column, words: Sequence[str]) -> Column:
    """Drop tokens that are in ``words``; order and repeats are kept."""
    # isin() over literals becomes a hash-set lookup (InSet), array_contains a linear one
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def truncate_words(col: Column, n: int) -> Column:
    """First ``n`` word tokens of a text (the model-input limit of the summariser)."""
    return F.slice(tokenize(col, 1), 1, n)


def key_hash(*cols: Column) -> Column:
    """Hex MD5 of the key columns, each written as its length, a colon and its text.

    So no two different keys read the same; a missing value is a hyphen, which no text can be.
    """
    cells = [c.cast("string") for c in cols]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in cells]))


# The HTML character references decoded in article text. '&amp;' has to come
# last, so that '&amp;lt;' becomes '&lt;' and not '<'.
HTML_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]


def decode_entities(col: Column) -> Column:
    for entity, char in HTML_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def missing(col: Column, dtype: str) -> Column:
    """A cell that a data-frame user would call missing: null, or NaN in a float column."""
    if dtype in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()
