"""Partition sizes, row numbers, chunks and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from litsearch.operators.profile import row_bytes
from litsearch.session import remove_path, scratch_path, shuffles_removed

# monotonically_increasing_id() is the partition number above the row number in the partition
_ROW_BITS = 33
# limits' worth of rows in a block of byte batches
BLOCK_BATCHES = 16


def repartition_by_size(df: DataFrame, mb: int = 100, total_bytes: int | None = None) -> DataFrame:
    """Evenly filled partitions of about ``mb`` megabytes of text.

    Without ``total_bytes`` the table is measured first, which is one aggregation over it.
    """
    if total_bytes is None:
        total_bytes = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return df.repartition(max(1, math.ceil(total_bytes / (mb * 1024 * 1024))))


def rebalance(df: DataFrame, *by: str) -> DataFrame:
    """Let adaptive execution even out the partitions to the session's advisory size, keeping rows
    that are equal in ``by`` together as far as that size allows."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def repartition_fixed(df: DataFrame, n: int = 30) -> DataFrame:
    return df.repartition(n)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to Parquet and go on from the files, which survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, "materialized") if path is None else path
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_materialized(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` has written and nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove_path(df.sparkSession, unquote(files[0].rsplit("/", 1)[0]))


def with_row_number(
    df: DataFrame, order_by: Sequence[str], out: str = "row_no",
    running: Column | None = None, running_out: str = "running",
) -> DataFrame:
    """Add the global, zero-based row number in the order of ``order_by``, which must be unique.

    No row passes through a single task: rows are range-partitioned and numbered within their
    partition, the result is written out, and the row counts of the partitions before are added.
    The table is written first because range borders are sampled and would differ between two
    runs of the same plan. With ``running`` the running sum of that expression is added as well.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    extra = [] if running is None else [running.cast("bigint").alias("_weight")]
    stored = materialize(ranged.select("*", *extra, F.monotonically_increasing_id().alias("_id")))
    stored = (
        stored.withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_at", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1))
    )
    sums = [F.count("*").alias("_rows")]
    if running is not None:
        sums.append(F.sum("_weight").alias("_sum"))
    # one row per partition, so this window is no larger than the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = stored.groupBy("_part").agg(*sums).select(
        "_part", F.coalesce(F.sum("_rows").over(before), zero).alias("_start"),
        *([F.coalesce(F.sum("_sum").over(before), zero).alias("_offset")] if running is not None else []),
    )
    placed = stored.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at"))
    if running is not None:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn(running_out, F.col("_offset") + F.sum("_weight").over(within))
    return placed.select(*df.columns, out, *([running_out] if running is not None else []))


def _numbered_keys(df: DataFrame, order_by: Sequence[str], size: Column | None = None) -> DataFrame:
    """(order_by, _size, _row_no, _end): the keys alone, in order; ``_end`` sums up size + 1.

    Only keys and sizes are sorted and written. A key that comes twice raises an error, since
    the table is met by key afterwards.
    """
    size = F.lit(0) if size is None else F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
    once = df.select(*order_by, size.cast("bigint").alias("_size")).groupBy(*order_by).agg(
        F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    repeated = F.raise_error(F.lit(f"{', '.join(order_by)} must be unique")).cast("bigint")
    keys = once.select(*order_by, F.when(F.col("_n") > 1, repeated).otherwise(F.col("_size")).alias("_size"))
    return with_row_number(keys, order_by, "_row_no", F.col("_size") + 1, "_end")


def _met_by_key(df: DataFrame, keys: DataFrame, order_by: Sequence[str], *out: Column) -> DataFrame:
    """``df`` with columns of ``keys``; a missing key meets a missing key."""
    own = keys.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(order_by)], *out)
    same = reduce(and_, [df[c].eqNullSafe(own[f"_key{i}"]) for i, c in enumerate(order_by)])
    return df.join(own, same).drop(*[f"_key{i}" for i in range(len(order_by))])


def with_chunk_id(df: DataFrame, order_by: Sequence[str], rows: int = 1000, out: str = "chunk_id") -> DataFrame:
    """Number consecutive chunks of ``rows`` rows in the order of ``order_by``, which must be unique;
    the last one may be shorter. Only the keys are sorted and written."""
    return _met_by_key(df, _numbered_keys(df, order_by), order_by, F.floor(F.col("_row_no") / rows).alias(out))


def with_byte_batches(
    df: DataFrame, order_by: Sequence[str], max_bytes: int,
    size: Column | None = None, out: str = "batch_id", oversize: str = "oversize",
) -> DataFrame:
    """Number consecutive batches of at most ``max_bytes`` bytes of text by their first row's number.

    A batch takes rows as long as they fit. A row above the limit is a batch by itself and marked
    in ``oversize``; a missing size is 0. So that batches can be found in parallel, they also end
    with blocks of about ``BLOCK_BATCHES`` limits, which depend on the data alone; a row counts as
    one byte more than its size for these. ``order_by`` must be unique. Only keys and sizes are
    sorted and written; a task reads its blocks in order and holds the unfinished batch alone,
    however many rows a block has.
    """
    keys = _numbered_keys(df, order_by, row_bytes(df) if size is None else size)
    block = F.floor((F.col("_end") - F.col("_size") - 1) / F.lit(BLOCK_BATCHES * max_bytes)).alias("_block")
    in_order = keys.select(*order_by, "_row_no", "_size", block).repartition("_block").sortWithinPartitions("_block", "_row_no")
    schema = T.StructType([*in_order.schema.fields, T.StructField("_batch", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, (0, 0)
        for batch in batches:
            blocks, number, sizes = (batch.column(c).to_numpy() for c in ("_block", "_row_no", "_size"))
            first, at = np.empty(len(sizes), np.int64), 0
            while at < len(sizes):
                end = int(np.searchsorted(blocks, blocks[at], "right"))
                state = fill_batches(number[at:end], sizes[at:end], max_bytes, state if blocks[at] == last else None, first[at:end])
                last, at = blocks[at], end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "_batch"])

    found = in_order.mapInArrow(run, schema)
    return _met_by_key(df, found, order_by, F.col("_batch").alias(out), (F.col("_size") > max_bytes).alias(oversize))


def fill_batches(
    number: np.ndarray, sizes: np.ndarray, limit: int, state: tuple[int, int] | None, first: np.ndarray
) -> tuple[int, int]:
    """Write each row's batch into ``first``, going on from ``state``: the first row's number and the
    bytes of the unfinished batch, none at the start of a block. Returns the state after the last row."""
    upto, at = np.cumsum(sizes), 0
    start, filled = state or (int(number[0]), 0)
    if state is None:
        first[0], filled, at = start, int(sizes[0]), 1
    while at < len(sizes):
        before = int(upto[at - 1]) if at else 0
        fit = max(at, int(np.searchsorted(upto, limit - filled + before, "right")))
        first[at:fit] = start
        if fit == len(sizes):
            return start, filled + int(upto[-1]) - before
        start, filled = int(number[fit]), int(sizes[fit])
        first[fit], at = start, fit + 1
    return start, filled


def row_slice(df: DataFrame, order_by: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows number ``first`` to ``last`` (zero-based, both included) in the order of ``order_by``, which
    must be unique. The keys are numbered, and the table is then read between the two border keys."""
    at = F.struct(*order_by)
    borders = _numbered_keys(df, order_by).filter(F.col("_row_no").between(first, last)).agg(
        F.min_by(at, "_row_no").alias("low"), F.max_by(at, "_row_no").alias("high")).first()
    if borders["low"] is None:
        return df.limit(0)
    types = dict(df.dtypes)
    low, high = (F.struct(*[F.lit(b[c]).cast(types[c]).alias(c) for c in order_by]) for b in (borders["low"], borders["high"]))
    lead = order_by[0]
    # the first column's bounds reach the scan; missing keys come first
    above = F.lit(True) if borders["low"][lead] is None else F.col(lead) >= low[lead]
    below = F.col(lead).isNull() if borders["high"][lead] is None else F.col(lead) <= high[lead]
    below = below | F.col(lead).isNull() if borders["low"][lead] is None else below
    return df.filter(above & below) if len(order_by) == 1 else df.filter(above & below & (at >= low) & (at <= high))


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable sample by key hash: the same rows whatever the partitioning or order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.filter(point < int(fraction * 2**32))


def sample_partition(df: DataFrame, partition: int) -> DataFrame:
    """The rows of one partition of the table's current layout."""
    return df.filter(F.spark_partition_id() == partition)
