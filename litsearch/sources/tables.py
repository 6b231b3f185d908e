"""CSV and Parquet tables, datasets in the catalog and stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

METADATA_COLUMNS = [
    "cord_uid", "title", "authors", "abstract", "publish_time", "url", "journal", "pdf_json_files",
]

# The cell texts a data-frame CSV reader takes for missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

# Vector length of each kind of stored embedding.
EMBEDDING_DIMS = {"cord19": 768, "distilbert": 256, "bert": 768, "bert-large": 1024}


def _csv(spark: SparkSession, multi_line: bool):
    # Quoted cells may hold line breaks, and such a file cannot be split: convert large CSV
    # files to Parquet once, or pass multi_line=False if no cell has a line break.
    return (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"')
    )


def na_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    def cell(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.when(c.isin(list(tokens)), None).otherwise(c).alias(name)) if dtype == "string" else c

    return df.select(*[cell(name, dtype) for name, dtype in df.dtypes])


def read_csv_as_strings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every column as a string; missing-value texts become null."""
    return na_to_null(_csv(spark, multi_line).csv(path))


def read_metadata_csv(
    spark: SparkSession, path: str, cols: Sequence[str] = METADATA_COLUMNS, multi_line: bool = True
) -> DataFrame:
    """The chosen columns as strings."""
    return na_to_null(_csv(spark, multi_line).csv(path).select(*cols))


def read_csv_inferred(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return na_to_null(_csv(spark, multi_line).option("inferSchema", True).option("nanValue", "NaN").csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or glob."""
    return spark.read.parquet(path)


def write_papers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def create_dataset(spark: SparkSession, name: str, schema: T.StructType | str, path: str | None = None) -> None:
    """Make an empty Parquet table unless there is one of that name."""
    if spark.catalog.tableExists(name):
        return
    schema = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {} if path is None else {"path": path}
    spark.catalog.createTable(name, source="parquet", schema=schema, **options)


def drop_dataset(spark: SparkSession, name: str) -> None:
    """Remove a table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def scan_all(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_embeddings(
    spark: SparkSession, kind: str, path: str, key: str = "cord_uid", fmt: str = "csv", dim: int | None = None
) -> DataFrame:
    """(key, embedding array<float>) of one kind of stored vectors.

    CSV files have no header: the key, then one number per dimension. Parquet files have the
    two columns already. A vector of another length than the kind's fails the query.
    """
    if kind not in EMBEDDING_DIMS:
        raise ValueError(f"unknown embedding kind {kind!r}; known: {sorted(EMBEDDING_DIMS)}")
    dim = EMBEDDING_DIMS[kind] if dim is None else dim
    if fmt == "parquet":
        emb = spark.read.parquet(path).select(key, "embedding")
    elif fmt == "csv":
        lines = spark.read.text(path).select(F.split("value", ",").alias("v"))
        values = F.slice("v", 2, F.size("v")).cast("array<float>")
        emb = lines.select(F.col("v")[0].alias(key), values.alias("embedding"))
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', got {fmt!r}")
    found = F.size("embedding")
    complaint = F.concat(F.lit(f"expected {dim} dimensions, found "), found.cast("string"))
    return emb.withColumn(
        "embedding", F.when(found == dim, F.col("embedding")).otherwise(F.raise_error(complaint))
    )
