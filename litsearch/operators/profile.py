"""Counts, types, missing cells and sizes of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from litsearch.functions.text import missing


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def _missing_counts(df: DataFrame) -> DataFrame:
    """One (column, n_missing) row per column, from a single pass over the table."""
    counts = df.agg(*[F.count_if(missing(F.col(c), t)).alias(c) for c, t in df.dtypes])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])
    return counts.select(F.inline(pairs))


def null_columns(df: DataFrame) -> DataFrame:
    return _missing_counts(df).filter("n_missing > 0").select("column")


def null_report(df: DataFrame) -> DataFrame:
    return _missing_counts(df)


def null_cells(df: DataFrame, key: str) -> DataFrame:
    """The position (key, column) of every missing cell."""
    names = F.array(*[
        F.when(missing(F.col(c), t), F.lit(c)) for c, t in df.dtypes if c != key
    ])
    return df.select(key, F.explode(F.array_compact(names)).alias("column"))


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column, type) of each column; metadata only, no data is read."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def row_bytes(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Bytes of text in a row's string columns."""
    cols = [c for c, t in df.dtypes if t == "string"] if cols is None else cols
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in cols]
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("bigint"))


def size_report(df: DataFrame) -> DataFrame:
    cols = [c for c, t in df.dtypes if t == "string"]
    sizes = df.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bytes")) for c in cols])
    return sizes.select(F.inline(pairs))


def partition_report(df: DataFrame) -> DataFrame:
    """Rows and text bytes of each partition."""
    return (
        df.select(F.spark_partition_id().alias("partition"), row_bytes(df).alias("_bytes"))
        .groupBy("partition").agg(F.count("*").alias("n_rows"), F.sum("_bytes").alias("bytes"))
    )
