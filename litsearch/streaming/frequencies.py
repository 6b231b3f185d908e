"""Document frequencies that follow a stream of new and changed documents.

A batch writes two folders of its own number: the words of its documents (key, terms), and the signed change
of every document frequency (term, d; the row without a term carries the change of the number of documents).
A document that came before takes its old words back. Nothing older is rewritten, only the words of the
batch's own keys are met again, and a batch that is run again after a failure replaces itself, because it looks
at earlier batches only. The model is the sum of the changes; ``compact_frequencies`` folds them into one.

A null text has no words and counts as a document; rows without a key are left out. Of a key that is repeated in
a batch, the row highest in ``order_by`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from litsearch.functions.text import remove_stopwords, tokenize
from litsearch.operators.store import latest_per_key
from litsearch.streaming.ingest import BATCH


def _earlier(spark: SparkSession, folder: str, schema: str, batch_id: int) -> DataFrame:
    """What batches before ``batch_id`` wrote; their folders alone are opened."""
    try:
        stored = spark.read.schema(f"{schema}, {BATCH} long").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {BATCH} long")
    return stored.where(F.col(BATCH) < batch_id)


def update_frequencies(
    batch: DataFrame, batch_id: int, path: str, key: str, col: str, order_by: Sequence[str],
    stopwords: Sequence[str] | None = None,
) -> None:
    """Take the documents of a batch into the model at ``path``; batches come in the order of their numbers."""
    spark, kind = batch.sparkSession, batch.schema[key].dataType.simpleString()
    words = tokenize(F.coalesce(F.col(col), F.lit("")))
    terms = F.array_distinct(remove_stopwords(words, stopwords) if stopwords else words)
    rows = batch.where(F.col(key).isNotNull())
    rows = latest_per_key(rows, [key], order_by) if order_by else rows.dropDuplicates([key])
    documents = f"{path}/documents"
    rows.select(key, terms.alias("terms")).write.mode("overwrite").parquet(f"{documents}/{BATCH}={batch_id}")
    new = spark.read.schema(f"{key} {kind}, terms array<string>").parquet(f"{documents}/{BATCH}={batch_id}")
    earlier = _earlier(spark, documents, f"{key} {kind}, terms array<string>", batch_id)
    old = latest_per_key(earlier.join(new.select(key), key, "left_semi"), [key], [BATCH]).select(key, "terms")
    signed = new.withColumn("d", F.lit(1)).unionAll(old.withColumn("d", F.lit(-1)))
    # every document also counts once under no term
    changes = (
        signed.select(F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"), "d")
        .groupBy("term").agg(F.sum("d").cast("long").alias("d")).where("d <> 0")
    )
    changes.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch_id}")


def frequency_stream(
    stream: DataFrame, path: str, checkpoint: str, key: str, col: str, order_by: Sequence[str],
    stopwords: Sequence[str] | None = None,
) -> StreamingQuery:
    """Start taking in what the stream has; the query ends when all of it is counted."""
    def write(batch: DataFrame, batch_id: int) -> None:
        update_frequencies(batch, batch_id, path, key, col, order_by, stopwords)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, idf, n_docs) as a fit over the current documents gives it."""
    sums = spark.read.schema("term string, d long").parquet(f"{path}/changes").groupBy("term").agg(F.sum("d").alias("df"))
    n_docs = sums.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar()
    return (
        sums.where("term is not null and df > 0").withColumn("n_docs", n_docs)
        .withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
        .select("term", "df", "idf", "n_docs")
    )


def compact_frequencies(spark: SparkSession, path: str, target: str, key: str) -> None:
    """The same model as the first batch of a new folder: the latest words of every document, and one change a term."""
    documents = spark.read.option("basePath", f"{path}/documents").parquet(f"{path}/documents")
    (latest_per_key(documents, [key], [BATCH]).select(key, "terms")
     .write.mode("overwrite").parquet(f"{target}/documents/{BATCH}=-1"))
    (spark.read.schema("term string, d long").parquet(f"{path}/changes").groupBy("term").agg(F.sum("d").alias("d"))
     .where("d <> 0").write.mode("overwrite").parquet(f"{target}/changes/{BATCH}=-1"))
