"""Incremental ingest: new files are appended as batches, reads see the latest row per key.

A batch is written to a folder of its own number, so a batch that is run again after a failure
replaces itself. Nothing already stored is rewritten until :func:`compact`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from litsearch.operators.store import latest_per_key

BATCH = "batch_id"


def ingest_stream(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str]
) -> StreamingQuery:
    """Start taking in what the stream has; the query ends when all of it is stored.

    Within a batch the row highest in ``order_by`` is kept for each key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order_by).write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_current(spark: SparkSession, sink: str, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The stored rows as after upserting batch by batch: a later batch wins over an earlier."""
    stored = spark.read.option("basePath", sink).parquet(sink)
    return latest_per_key(stored, keys, [BATCH, *order_by]).drop(BATCH)


def compact(spark: SparkSession, sink: str, target: str, keys: Sequence[str], order_by: Sequence[str]) -> None:
    """Write the current rows as the first batch of a new sink folder."""
    current = read_current(spark, sink, keys, order_by)
    current.write.mode("overwrite").parquet(f"{target}/{BATCH}=-1")
