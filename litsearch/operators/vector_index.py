"""Dense vectors in folders around centroids, for exact or bounded cosine search.

Every vector, scaled to length one, goes to the folder of its nearest centroid; a folder knows how far its
farthest vector is from the centroid. By the triangle inequality no vector of a folder is nearer to the
query than the query's distance to the centroid less that radius, which bounds its cosine. A search
reads the most promising folders first and then only those whose bound reaches the last hit found.

Vectors without a direction are in two folders of their own: null and zero ones, which score at most 1, and
those that are not finite, which a scan ranks first and which are therefore always read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from litsearch.operators.vector import vector_scores
from litsearch.sources.versions import read_version, write_version

# Vectors that the centroids are found on, and rounds of doing so.
SAMPLE, ROUNDS = 20_000, 8
NO_DIRECTION, NOT_FINITE = -1, -2
# Distances are rounded; a bound this much below the last hit may still hold one.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession = field(repr=False)
    path: str
    key: str
    vector: str
    schema: str = field(repr=False)
    centers: np.ndarray = field(repr=False)
    # per folder its radius and number of vectors
    radius: np.ndarray = field(repr=False)
    n: np.ndarray = field(repr=False)

    def rows(self, folders: Sequence[int] | None = None) -> DataFrame:
        """Stored vectors, of the given folders only: others are not opened."""
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return stored if folders is None else stored.filter(F.col("folder").isin([int(f) for f in folders]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    at = square.argmin(1)
    return at, np.linalg.norm(x - centers[at], axis=1)


def find_centers(sample: np.ndarray, folders: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``folders`` centroids of unit vectors: the farthest-first points, then rounds of means."""
    centers = [sample[0]]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(centers) < folders and far.max() > 0:
        centers.append(sample[far.argmax()])
        far = np.minimum(far, np.linalg.norm(sample - centers[-1], axis=1))
    out = np.array(centers)
    for _ in range(rounds):
        at, _ = _nearest(sample, out)
        count = np.bincount(at, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, at, sample)
        out = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], out)
    return out


def _kind(vector: str) -> Column:
    """0 for a vector with a direction, else the folder for its kind."""
    square = F.aggregate(F.transform(vector, lambda c: c.cast("double") * c), F.lit(0.0), lambda a, b: a + b)
    return F.when(square.isNull() | (square == 0), NO_DIRECTION).when(F.isnan(square) | (square == float("inf")), NOT_FINITE).otherwise(0)


def write_vectors(emb: DataFrame, key: str, path: str, vector: str = "embedding", folders: int = 64, sample: int = SAMPLE) -> VectorIndex:
    """Store (key, vector) rows by nearest centroid. Centroids come from at most ``sample`` vectors, chosen by hash
    of the key; all vectors must have one length."""
    spark = emb.sparkSession
    rows = emb.select(F.col(key), F.col(vector)).withColumn("_kind", _kind(vector))
    some = rows.filter("_kind = 0").select(F.transform(vector, lambda c: c.cast("double")).alias("v")).orderBy(F.xxhash64(key), "v").limit(sample).collect()
    if len({len(r.v) for r in some}) > 1:
        raise ValueError("vectors have different lengths")
    centers = find_centers(_unit(np.array([r.v for r in some])), folders) if some else np.zeros((0, 1))
    dim = centers.shape[1]
    schema = f"`{key}` {emb.schema[key].dataType.simpleString()}, `{vector}` {emb.schema[vector].dataType.simpleString()}, distance double, folder int"
    out = StructType.fromDDL(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folder = batch.column(2).to_numpy().astype(np.int32)
            directed, distance = folder == 0, np.zeros(len(folder))
            if directed.any():
                x = batch.column(1).filter(pa.array(directed))
                if set(x.value_lengths().to_pylist()) != {dim}:
                    raise ValueError(f"expected vectors of length {dim}")
                folder[directed], distance[directed] = _nearest(_unit(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)), centers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance), pa.array(folder)], names=out.names)

    # a folder may hold most of the vectors: the key is part of the range split
    (rows.mapInArrow(place, out).repartitionByRange("folder", key).sortWithinPartitions("folder", key)
     .write.partitionBy("folder").parquet(f"{path}/vectors"))
    about = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("folder").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    shape = [(i, c.tolist()) for i, c in enumerate(centers)] + [(NO_DIRECTION, []), (NOT_FINITE, [])]
    (spark.createDataFrame(shape, "folder int, center array<double>").join(about, "folder", "left").na.fill(0.0, ["radius"]).na.fill(0, ["n"])
     .coalesce(1).write.parquet(f"{path}/folders"))
    write_version(spark, f"{path}/about", 1, {"key": key, "vector": vector, "schema": schema})
    return open_vectors(spark, path)


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """The folder table has one row per centroid, and so fits the driver."""
    about = read_version(spark, f"{path}/about", 1)
    found = sorted(spark.read.parquet(f"{path}/folders").filter("folder >= 0").collect(), key=lambda r: r.folder)
    return VectorIndex(spark, path, about["key"], about["vector"], about["schema"], np.array([r.center for r in found]), np.array([r.radius for r in found]),
                       np.array([r.n for r in found], dtype=int))


def folder_bounds(index: VectorIndex, query: Sequence[float]) -> np.ndarray:
    """Per folder a score (cosine + 1) that none of its vectors exceeds."""
    q = np.array(query, float)
    nearest = np.maximum(0, np.linalg.norm(index.centers - q / np.linalg.norm(q), axis=1) - index.radius)
    return np.where(index.n > 0, 2 - nearest**2 / 2, -1.0)


def search_vectors(index: VectorIndex, query: Sequence[float], k: int = 20, probes: int | None = None) -> DataFrame:
    """The ``k`` best (key, score), as a scan over all vectors gives them.

    ``probes`` reads that many folders at most, best bounds first, and may miss hits.
    """
    def best(folders: Sequence[int]) -> DataFrame:
        scores = vector_scores(index.rows(folders), query, index.key, index.vector)
        return scores.orderBy(F.desc("score"), index.key).limit(k)

    if not len(index.n) or not np.any(np.array(query, float)):
        return best([*range(len(index.n)), NO_DIRECTION, NOT_FINITE])
    bounds = folder_bounds(index, query)
    order = [int(f) for f in np.lexsort((np.arange(len(bounds)), -bounds)) if index.n[f]]
    if probes is not None:
        return best([*order[:probes], NOT_FINITE])
    first = 1 + int(np.searchsorted(np.cumsum(index.n[order]), k))
    page = best([*order[:first], NOT_FINITE]).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    if page.n < k:
        return best([*order, NO_DIRECTION, NOT_FINITE])
    rest = [f for at, f in enumerate(order) if at < first or bounds[f] + SLACK >= page.least]
    # a zero vector scores 1
    return best([*rest, NOT_FINITE, *([NO_DIRECTION] if page.least <= 1 + SLACK else [])])
