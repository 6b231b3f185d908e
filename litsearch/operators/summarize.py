"""Sentence mining, extractive summaries and scoring with a model of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from litsearch.functions.text import strip, tokenize, truncate_words
from litsearch.operators.joins import split_join
from litsearch.operators.layout import materialize
from litsearch.operators.tfidf import fit_tfidf, frequent_terms
from litsearch.session import by_key


def sentences(col: Column) -> Column:
    return F.split(col, r"\.")


def sentences_matching(
    df: DataFrame, key: str, col: str, needle: str, limit_docs: int | None = None
) -> DataFrame:
    """(key, sentence_no, sentence) of the sentences that contain ``needle``.

    ``limit_docs`` looks at that many documents only, lowest key first.
    """
    if limit_docs is not None:
        df = df.select(key, col).orderBy(key).limit(limit_docs)
    return (
        df.filter(F.col(col).contains(needle))
        .select(key, F.posexplode(sentences(F.col(col))).alias("sentence_no", "sentence"))
        .filter(F.col("sentence").contains(needle))
    )


def truncate_tokens(df: DataFrame, col: str, n: int = 512, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, truncate_words(F.col(col), n))


def summarize_extractive(
    df: DataFrame, key: str, col: str, k: int = 3, model: DataFrame | None = None, out: str = "summary"
) -> DataFrame:
    """(key, summary): the ``k`` best sentences of each document, in text order.

    A sentence scores the mean TF-IDF weight (tf in the document × idf) of its words; ties go to
    the earlier sentence. Without a fitted ``model`` one is fitted on the texts themselves and written out.
    """
    model = materialize(fit_tfidf(df, col)) if model is None else model
    text = by_key(df.select(key, col), key)
    numbered = text.select(key, F.posexplode(sentences(F.col(col))).alias("_no", "_sentence"))
    per_sentence = (
        numbered.select(key, "_no", F.explode(tokenize(F.col("_sentence"))).alias("term"))
        .groupBy(key, "_no", "term").agg(F.count("*").alias("_c"))
        .withColumn("_tf", F.sum("_c").over(Window.partitionBy(key, "term")))
    )
    weighed = split_join(per_sentence, model.select("term", "df", "idf"), ["term"], frequent_terms(model))
    mean = F.sum(F.col("_c") * F.col("_tf") * F.col("idf")) / F.sum("_c")
    best_first = Window.partitionBy(key).orderBy(F.desc("_score"), "_no")
    picks = (
        weighed.repartition(key).groupBy(key, "_no").agg(F.round(mean, 9).alias("_score"))
        .withColumn("_rank", F.row_number().over(best_first)).filter(F.col("_rank") <= k)
        .groupBy(key).agg(F.array_sort(F.collect_list("_no")).alias("_picks"))
    )
    chosen = F.transform("_picks", lambda i: strip(F.get(sentences(F.col(col)), i)))
    summary = F.concat(F.array_join(chosen, ". "), F.lit("."))
    return text.join(picks, key, "left").select(key, F.coalesce(summary, F.lit("")).alias(out))


def infer_batches(
    df: DataFrame, cols: Sequence[str], init: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], pd.Series], out: str = "prediction", out_type: str = "string",
) -> DataFrame:
    """Add a model's output to each row.

    ``init`` makes the model, once per task and on the executor; ``predict`` gets it with Arrow
    batches of ``cols`` and returns one value per row.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DataType.fromDDL(out_type))])
    inputs = list(cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = init() if model is None else model
            yield batch.assign(**{out: predict(model, batch[inputs])})

    return df.mapInPandas(run, schema)
