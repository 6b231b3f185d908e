"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.session import scratch_path

#: Rows that a Python worker turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: lineage is cut, and later
    steps survive the loss of any executor. ``files``: at most so many are written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def files_like(scan: DataFrame) -> int:
    """How many files suit a table of about the size of a plain scan: one per split, enough for all cores.
    Where empty shuffle partitions are not merged, each would be a file, and Hadoop starts a process for each file
    on a local disk, which for a moment counts the executor's memory twice."""
    return max(2 * scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions())


def crc_class(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; rows without an id get 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Map-only Arrow step: ``fn`` gets columns as lists, ``SLICE`` rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = fn(batch.slice(at, SLICE).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scramble of 64-bit numbers (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' component under the edges (a[i], b[i])."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """(node, root): smallest node reachable from every node that has an edge.

    ``edges`` holds a, b (long). Large-star and small-star steps alternate until the set of edges
    no longer changes; it is then one star per component. Each round is aggregation with partial
    minima and an equality join, and is written out, so lineage stays short. No component is
    ever gathered in one place. ``files``: at most so many are written in a round.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, files)
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        now = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(small_low.select("a", F.col("m").alias("b"))).distinct(), name, files)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == mark:
            break
        mark = seen
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
