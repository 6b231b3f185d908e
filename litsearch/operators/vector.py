"""Exact cosine ranking over dense vectors: one narrow scan and a top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from litsearch.functions.vectors import cosine, vector_literal


def vector_scores(emb: DataFrame, query: Sequence[float], key: str, vector: str = "embedding") -> DataFrame:
    """(key, score) with score = cosine + 1, for every vector; one of another length is an error."""
    score = cosine(F.col(vector), vector_literal(query)) + 1.0
    fits = F.col(vector).isNull() | (F.size(vector) == len(query))
    return emb.select(key, F.when(fits, score).otherwise(F.raise_error(F.concat(
        F.lit(f"expected vectors of length {len(query)}, got "), F.size(vector).cast("string")))).alias("score"))


def vector_search(
    emb: DataFrame, query: Sequence[float], key: str, vector: str = "embedding", k: int = 20
) -> DataFrame:
    return vector_scores(emb, query, key, vector).orderBy(F.desc("score"), key).limit(k)


def rerank(
    hits: DataFrame, emb: DataFrame, query: Sequence[float], key: str, vector: str = "embedding"
) -> DataFrame:
    """A page of keyword hits, ordered anew by vector score; those without a vector come last, in
    the order they had (by their own score, if they carry one), with a null score.

    Spark knows the size of a limited page and broadcasts it by itself, so that the vectors are
    filtered in place.
    """
    found = emb.join(hits.select(key), key, "left_semi")
    order = F.col("score").desc() if "score" in hits.columns else F.col(key).asc()
    scored = vector_scores(found, query, key, vector).withColumnRenamed("score", "_vector_score")
    return (
        hits.join(scored, key, "left").orderBy(F.desc_nulls_last("_vector_score"), order, key)
        .select(key, F.col("_vector_score").alias("score"))
    )


def dimension_report(emb: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, n): how many vectors there are of each length."""
    return emb.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
