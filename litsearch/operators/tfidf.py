"""TF-IDF as tables: a model of (term, df, idf, n_docs) and weights of (key, term, weight).

Smoothed idf ``ln((1 + n) / (1 + df)) + 1``, raw term counts, rows scaled to length 1. One
model is fitted over the whole table, so that all vectors share one vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from litsearch.functions.fuzzy import query_words
from litsearch.functions.text import remove_stopwords, tokenize
from litsearch.operators.joins import split_join, spread_join
from litsearch.operators.layout import materialize
from litsearch.session import by_key

# Terms of a stored model that are broadcast where words meet it.
FREQUENT_TERMS = 100_000


def _words(col: str, stopwords: Sequence[str] | None) -> Column:
    words = tokenize(F.coalesce(F.col(col), F.lit("")))
    return remove_stopwords(words, stopwords) if stopwords else words


def token_counts(df: DataFrame, col: str) -> DataFrame:
    """(term, n): how often each word is used in the whole table."""
    return (
        df.select(F.explode(tokenize(F.col(col))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n"))
    )


def term_counts(df: DataFrame, key: str, col: str, stopwords: Sequence[str] | None = None) -> DataFrame:
    """(key, term, tf). The text is shuffled once by key; the counting then stays in place."""
    return (
        by_key(df.select(key, col), key)
        .select(key, F.explode(_words(col, stopwords)).alias("term"))
        .groupBy(key, "term").agg(F.count("*").alias("tf"))
    )


def fit_tfidf(df: DataFrame, col: str, stopwords: Sequence[str] | None = None) -> DataFrame:
    """The model. Each document contributes its distinct words, so that the document frequency
    is one aggregation with partial sums; the text itself is not shuffled."""
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.select(F.explode(F.array_distinct(_words(col, stopwords))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df"))
        .withColumn("n_docs", n_docs)
        .withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
        .select("term", "df", "idf", "n_docs")
    )


def frequent_terms(model: DataFrame, most: int = FREQUENT_TERMS) -> Column:
    """A condition that at most ``most`` terms of a stored model meet, the most frequent ones.

    One row per different frequency is brought together; equal frequencies are in or out together.
    """
    by_df = model.groupBy("df").agg(F.count("*").alias("n"))
    terms = F.sum("n").over(Window.orderBy(F.desc("df")))
    least = by_df.select("df", terms.alias("terms")).filter(F.col("terms") <= most).agg(F.min("df")).first()[0]
    return F.lit(False) if least is None else F.col("df") >= least


def transform_tfidf(
    df: DataFrame, key: str, col: str, model: DataFrame, stopwords: Sequence[str] | None = None,
    frequent: Column | None = None,
) -> DataFrame:
    """(key, term, weight) with weights of length 1 per document; unknown words drop out.

    With ``frequent``, see :func:`frequent_terms`, only the counts of other terms are shuffled by term.
    """
    counts, model = term_counts(df, key, col, stopwords), model.select("term", "df", "idf")
    found = (spread_join(counts, model, ["term"], "df", key) if frequent is None
             else split_join(counts, model, ["term"], frequent))
    raw = found.select(key, "term", (F.col("tf") * F.col("idf")).alias("_x"))
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_x") / length).alias("weight"))


def tfidf_query_vector(model: DataFrame, text: str) -> DataFrame:
    """(term, weight) of a query text; at most one row per distinct word of the text."""
    counts = Counter(w for w in query_words(text) if len(w) >= 2)
    if not counts:
        return model.limit(0).select("term", F.col("idf").alias("weight"))
    known = model.filter(F.col("term").isin(list(counts)))
    tf = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("term")]
    raw = known.select("term", (tf * F.col("idf")).alias("_x"))
    length = raw.agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("l")).scalar()
    return raw.select("term", (F.col("_x") / length).alias("weight"))


def tfidf_stats(weights: DataFrame, key: str) -> DataFrame:
    """Vocabulary size, stored cells and their bytes (one double each)."""
    per_term = weights.groupBy("term").agg(F.count("*").alias("_n"))
    return per_term.agg(
        F.count("*").alias("n_terms"), F.sum("_n").alias("n_values"),
        (F.sum("_n") * 8).alias("value_bytes"),
    )


def tfidf_search(weights: DataFrame, query_vector: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` documents closest to the query by cosine; those sharing no word score 0.

    Only the weights of the query's terms are added up. Documents without any of them are looked
    for, lowest keys first, only where fewer than ``k`` have one. ``query_vector`` is joined by
    Spark's own choice of method, whatever its size.
    """
    q = query_vector.select("term", F.col("weight").alias("_q"))
    # rounded, so that equal documents tie however their parts were added up
    score = F.round(F.sum(F.col("weight") * F.col("_q")), 9).alias("score")
    best = [F.desc("score"), key]
    hits = materialize(weights.join(q, "term").groupBy(key).agg(score).orderBy(*best).limit(k))
    if hits.count() == k:
        return hits.orderBy(*best)
    others = weights.select(key).join(hits, key, "left_anti").distinct().orderBy(key).limit(k)
    return hits.unionByName(others.withColumn("score", F.lit(0.0))).orderBy(*best).limit(k)


def save_tfidf(model: DataFrame, path: str) -> None:
    model.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load_tfidf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
