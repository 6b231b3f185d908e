"""Session helpers: local sessions for tests, the shared scratch folder, input parallelism."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one spark-submit makes."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``.

    Written tables must outlive a lost executor, so a machine-local folder is used only in
    local mode, where driver and executors are one process. It is remembered per application,
    because Spark refuses to change ``spark.checkpoint.dir`` of a running session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _LOCAL_ROOTS.setdefault(
            spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="litsearch-")
        _LOCAL_ROOTS[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/litsearch/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`scratch_path` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write are deleted as soon as it has ended.

    By itself Spark keeps them until the driver happens to collect its garbage, so that the shuffles of
    all steps of a job lie on disk together. Nothing reads the shuffle of a write after it.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a plain scan that has fewer splits than the cluster has cores.

    A large table has many more splits than cores and passes through unchanged; a small file
    with one row group would otherwise keep one core busy and the others idle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() <= cores else scan


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# Adaptive execution merges small partitions by their bytes, except where their number was asked
# for. The two helpers ask for it where few bytes turn into much work.

def fan_out(df: DataFrame) -> DataFrame:
    """Deal out the rows to all shuffle partitions."""
    return df.repartition(_shuffle_partitions(df))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle texts by key, ahead of splitting them into words that are grouped by that key."""
    return df.repartition(_shuffle_partitions(df), *keys)
