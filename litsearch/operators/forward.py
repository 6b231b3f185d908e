"""A forward index: per document and field one row of term numbers and counts, and a term dictionary.

Texts are split once, when the index is written, and are never shuffled; only their words are.
TF-IDF models, weights, statistics and rankings are then read from the rows. An entry carries its
term and the term's document frequency, so weights and counts need no lookup and no shuffle. Terms
are numbered by falling frequency within their field, so frequent terms have small numbers.

Definitions are those of ``operators/tfidf.py``. The key must be unique. A document without words
(or with a missing text) is a row without entries: it counts in ``n_docs`` and has no weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from litsearch.functions.fuzzy import query_words
from litsearch.functions.text import remove_stopwords, tokenize
from litsearch.operators.joins import split_join
from litsearch.operators.layout import materialize, with_row_number

# Terms of all fields together that are broadcast when entries get their numbers.
FREQUENT_TERMS = 100_000


@dataclass(frozen=True)
class ForwardIndex:
    """``documents`` (key, field, terms: array of term_id, tf, df, term), ``dictionary`` (field, term,
    term_id, df) and ``counts`` (field, n_docs), one row per field."""

    key: str
    documents: DataFrame
    dictionary: DataFrame
    counts: DataFrame


def write_forward(
    df: DataFrame, key: str, cols: Sequence[str], path: str, stopwords: Sequence[str] | None = None
) -> ForwardIndex:
    """Index the texts of ``cols``, each as a field, in one pass over the table."""

    def words(col: str) -> Column:
        split = tokenize(F.coalesce(F.col(col), F.lit("")))
        return remove_stopwords(split, stopwords) if stopwords else split

    fields = F.array(*[F.struct(F.lit(c).alias("field"), words(c).alias("words")) for c in cols])
    counted = materialize(
        df.select(key, F.explode(fields).alias("_f"))
        .select(key, "_f.field", F.explode_outer("_f.words").alias("term"))
        .groupBy(key, "field", "term").agg(F.count("*").cast("int").alias("tf"))
    )
    frequency = (
        counted.filter("term IS NOT NULL").groupBy("field", "term").agg(F.count("*").alias("df"))
        .withColumn("_rare", -F.col("df"))
    )
    numbered = with_row_number(frequency, ["field", "_rare", "term"], "term_id")
    numbered.select("field", "term", "term_id", "df").write.mode("overwrite").parquet(f"{path}/dictionary")
    spark = df.sparkSession
    dictionary = spark.read.parquet(f"{path}/dictionary")
    # one row per field: numbers are dense, and the first ones of a field are its most frequent terms
    first = dictionary.groupBy("field").agg(F.min("term_id").alias("first")).collect()
    few = [(F.col("field") == r["field"]) & (F.col("term_id") < r["first"] + FREQUENT_TERMS // len(cols)) for r in first]
    entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", "tf", "df", "term"))
    (
        split_join(counted, dictionary, ["field", "term"], reduce(or_, few, F.lit(False)), "left")
        .groupBy(key, "field").agg(F.array_sort(F.collect_list(entry)).alias("terms"))
        .write.mode("overwrite").parquet(f"{path}/documents")
    )
    spark.read.parquet(f"{path}/documents").groupBy("field").agg(F.count("*").alias("n_docs")).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/counts")
    return open_forward(spark, path, key)


def open_forward(spark: SparkSession, path: str, key: str) -> ForwardIndex:
    return ForwardIndex(key, *[spark.read.parquet(f"{path}/{part}") for part in ("documents", "dictionary", "counts")])


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def forward_term_counts(index: ForwardIndex) -> DataFrame:
    """(key, field, term, tf), row by row."""
    return index.documents.select(index.key, "field", F.inline("terms")).select(index.key, "field", "term", "tf")


def forward_model(index: ForwardIndex) -> DataFrame:
    """(field, term, df, idf, n_docs), from the dictionary alone."""
    model = index.dictionary.join(F.broadcast(index.counts), "field")
    return model.select("field", "term", "df", _idf(F.col("n_docs"), F.col("df")).alias("idf"), "n_docs")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an expression named by a column would be put
    in wherever the column is used, here once for every entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _raw_vector(*kept: str) -> Column:
    return F.transform("terms", lambda e: F.struct(
        *[e[c].alias(c) for c in kept], (e["tf"] * _idf(F.col("n_docs"), e["df"])).alias("x")))


def _length(raw: Column) -> Column:
    return F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))


def forward_vectors(index: ForwardIndex) -> DataFrame:
    """(key, field, vector: array of term_id, df, term, weight): each row by itself, without a shuffle."""
    docs = index.documents.join(F.broadcast(index.counts), "field")
    kept = ("term_id", "df", "term")
    vector = _let(_raw_vector(*kept), lambda raw: _let(_length(raw), lambda length: F.transform(raw, lambda e: F.struct(
        *[e[c].alias(c) for c in kept], (e["x"] / length).alias("weight")))))
    return docs.select(index.key, "field", vector.alias("vector"))


def forward_weights(index: ForwardIndex) -> DataFrame:
    """(key, field, term, weight), row by row."""
    return forward_vectors(index).select(index.key, "field", F.inline("vector")).select(index.key, "field", "term", "weight")


def forward_stats(index: ForwardIndex) -> DataFrame:
    """Vocabulary size, stored cells and their bytes (one double each) per field."""
    cells = index.documents.groupBy("field").agg(F.sum(F.size("terms")).cast("bigint").alias("n_values"))
    terms = index.dictionary.groupBy("field").agg(F.count("*").alias("n_terms"))
    found = index.counts.select("field").join(cells, "field").join(terms, "field", "left")
    return found.select("field", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "n_values",
                        (F.col("n_values") * 8).alias("value_bytes"))


def forward_search(index: ForwardIndex, text: str, field: str, k: int = 10) -> DataFrame:
    """(key, score): the ``k`` documents closest to the query by cosine, lowest keys first among equals.

    Only the query's terms are looked up on the driver, at most one row per distinct word. Each
    document is scored from its own row; a task hands on its best ``k``.
    """
    asked = Counter(w for w in query_words(text) if len(w) >= 2)
    model = forward_model(index).filter((F.col("field") == field) & F.col("term").isin(list(asked)))
    known = model.join(index.dictionary.select("field", "term", "term_id"), ["field", "term"]).collect()
    raw = {r["term_id"]: asked[r["term"]] * r["idf"] for r in known}
    length = math.sqrt(math.fsum(x * x for x in raw.values())) or 1.0
    score = F.lit(0.0)
    if raw:
        weight = F.create_map(*[F.lit(v) for i, x in sorted(raw.items()) for v in (i, x / length)])

        def cosine(vector: Column) -> Column:
            hits = F.filter(vector, lambda e: e["term_id"].isin(sorted(raw)))
            return F.aggregate(hits, F.lit(0.0), lambda s, e: s + e["x"] * weight[e["term_id"]]) / _length(vector)

        # most documents have none of the terms, so their vectors are not made
        score = F.when(F.exists("terms", lambda e: e["term_id"].isin(sorted(raw))), F.round(_let(_raw_vector("term_id"), cosine), 9))
        score = F.coalesce(score, F.lit(0.0))
    docs = index.documents.filter((F.col("field") == field) & (F.size("terms") > 0)).join(F.broadcast(index.counts), "field")
    return docs.select(index.key, score.alias("score")).orderBy(F.desc("score"), index.key).limit(k)
