"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight random dimensions, once per table, and decoded to the nearest
point of the E8 lattice. A vector owns its cell in every table and probes the neighbouring cells nearest
to it, so that a pair meets if either vector's cell or probe is the other's cell. Within a cell, cosines are
checked in double precision; only edges of a spanning forest leave it. The components of these
edges are the components of the links found; within each component all cosines are checked again,
in tiles, to count every vector's links, which also finds links that no cell has shown.

Equal vectors of one label are worked on once and counted as often as they occur. Cells and
components with many members are cut into tiles of ``TILE`` vectors; every pair of tiles is a task of its own.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows
without label, link with nothing: no links, their own component. Vectors of different lengths never
link. Rows of one vec_id with different vectors count as different vectors of that number;
a row without vec_id is returned without links. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import components, forest, mix, stored, tasks

THRESHOLD = 0.93
TABLES = 16
PROBES = 8
SCALE = 1.0
SEED = 11
TILE = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, made from its definition."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    halves = [np.array([0.5 - (m >> k & 1) for k in range(8)]) for m in range(256) if m.bit_count() % 2 == 0]
    return np.array(whole + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
    d = y[odd] - f[odd]
    k = np.abs(d).argmax(1)
    f[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points: whole or half coordinates of even sum."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _key(table: int, points: np.ndarray) -> np.ndarray:
    """One number per cell: table and doubled coordinates, scrambled."""
    h = np.full(len(points), table + 1, np.uint64)
    for column in (2 * points).astype(np.int64).T:
        h = mix(h ^ column.astype(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Keys [n, tables] of own cells and [n, tables, probes] of probed ones, for unit vectors."""
    rng = np.random.default_rng(SEED)
    roots = _roots()
    own = np.empty((len(x), tables), np.int64)
    near = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        y = x @ rng.normal(size=(x.shape[1], 8)) * scale
        point = decode(y)
        own[:, t] = _key(t, point)
        order = np.argpartition(-(y - point) @ roots.T, probes, axis=1)[:, :probes]
        for p in range(probes):
            near[:, t, p] = _key(t, point + roots[order[:, p]])
    return own, near


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """The id column, n_links, component_id, kept; one row per input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # 0.0 and -0.0 are one value
    good = rows.where(fine).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    sets = stored(good.withColumn("same", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256))
                  .groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v")), "vector-sets")
    numbered = stored(sets.select(F.xxhash64("same").alias("node"), "same", "rep", "n", F.col("label").cast("string").alias("label"), F.size("v").alias("width"), "v"), "vectors")

    def unit(batch: pd.DataFrame) -> np.ndarray:
        x = np.array(batch["v"].tolist(), np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def cell_rows(batches):
        for batch in batches:
            for _, some in batch.groupby("width"):
                for at in range(0, len(some), 2000):
                    part = some.iloc[at : at + 2000]
                    own, near = cells(unit(part))
                    keys = np.c_[own, near.reshape(len(part), -1)]
                    yield pd.DataFrame({
                        "label": np.repeat(part["label"].to_numpy(), keys.shape[1]), "width": np.repeat(part["width"].to_numpy(), keys.shape[1]),
                        "node": np.repeat(part["node"].to_numpy(), keys.shape[1]), "key": keys.reshape(-1),
                        "own": np.tile(np.arange(keys.shape[1]) < own.shape[1], len(part))})

    def unit_rows(batches):
        for batch in batches:
            for _, some in batch.groupby("width"):
                yield pd.DataFrame({"node": some["node"], "unit": [r.tobytes() for r in unit(some)]})

    members = stored(numbered.select("label", "width", "node", "v").mapInPandas(
        cell_rows, "label string, width int, node bigint, key bigint, own boolean"), "cells")
    units = stored(numbered.select("width", "node", "v").mapInPandas(unit_rows, "node bigint, unit binary"), "units")
    group = ["label", "width", "key"]
    busy = members.groupBy(*group).agg(F.count("*").alias("m"), F.max("own").alias("owned")).where("m > 1 and owned")
    # cells are mostly small: a share of a partition's cells goes to Python at a time
    dealt = _dealt(members.join(busy, group), units)
    share = F.pmod(F.xxhash64(*group, "low", "high"), F.lit(32 * tasks(vectors))).alias("share")
    edges = dealt.select(share, *group, "node", "own", "tile", "low", "high", "unit").groupBy("share").applyInPandas(
        _cell_edges(threshold, group), "a bigint, b bigint")
    # nodes are hashes: components are named by their smallest node here, by the smallest id below
    found = components(stored(edges, "cell-edges"), "vector-components")
    inside = found.join(numbered.select("node", "rep", "n"), "node")
    total = inside.groupBy("root").agg(F.count("*").alias("m"), F.min("rep").alias("component_id"))
    linked = _tiled(inside.join(total, "root").withColumn("own", F.lit(True)), units, ["root"], _count_links(threshold),
                    "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    by_set = (numbered.select("node", "same", "rep", "n").join(found.join(total, "root").select("node", "component_id"), "node", "left")
              .join(linked, "node", "left")
              .select("same", F.coalesce("component_id", "rep").alias("component_id"),
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    keyed = good.select("id", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256).alias("same"))
    done = (keyed.join(by_set, "same").select("id", "n_links", "component_id")
            .unionAll(rows.where(~fine).select("id", F.lit(0).cast("long"), F.col("id"))))
    return done.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _dealt(members: DataFrame, units: DataFrame) -> DataFrame:
    """``members`` (with m, the size of their group) once per pair of tiles, with their vectors."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    tile = F.pmod(F.xxhash64(F.lit(7), "node"), F.greatest(F.lit(1), tiles)).cast("int")
    return (members.withColumn("tile", tile).withColumn("tiles", tiles)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
            .join(units, "node"))


def _tiled(members: DataFrame, units: DataFrame, group: list[str], fn, schema: str) -> DataFrame:
    """``fn`` on every pair of tiles of every group of ``members`` (with m, the group's size)."""
    dealt = _dealt(members, units)
    columns = [c for c in ("node", "n", "own", "tile", "low", "high", "unit") if c in dealt.columns]
    return dealt.select(*group, *columns).groupBy(*group, "low", "high").applyInPandas(fn, schema)


def _sides(batch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    low, high = batch["low"].iloc[0], batch["high"].iloc[0]
    if low == high:
        return batch, batch, True
    return batch[batch["tile"] == low], batch[batch["tile"] == high], False


def _cell_edges(threshold: float, group: list[str]):
    """Spanning edges of the links found in each pair of tiles of each cell."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        # a vector that owns and probes a cell counts as owner
        batch = batch.sort_values("own", ascending=False).drop_duplicates([*group, "low", "high", "node"])
        cell = batch.groupby([*group, "low", "high"], sort=False).ngroup().to_numpy()
        order = np.argsort(cell, kind="stable")
        node, own, tile = (batch[c].to_numpy()[order] for c in ("node", "own", "tile"))
        low, high, unit = (batch[c].to_numpy()[order] for c in ("low", "high", "unit"))
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            if end - begin < 2:
                continue
            x = _matrix(unit[begin:end])
            hit = np.triu(x @ x.T >= threshold, 1)
            mine = own[begin:end].astype(bool)
            hit &= mine[:, None] | mine[None, :]
            if low[begin] != high[begin]:  # pairs within one tile belong to that tile's own task
                hit &= tile[begin:end, None] != tile[None, begin:end]
            a, b = np.nonzero(hit)
            i.append(node[begin + a])
            j.append(node[begin + b])
        i, j = np.concatenate(i), np.concatenate(j)
        nodes = np.unique(np.r_[i, j])
        root = forest(len(nodes), np.searchsorted(nodes, i), np.searchsorted(nodes, j))
        far = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[far], "b": nodes[root[far]]})

    return run


def _count_links(threshold: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(batch)
        if not len(a) or not len(b):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        hit = _matrix(a["unit"]) @ _matrix(b["unit"]).T >= threshold
        if same:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"node": a["node"], "links": hit @ b["n"].to_numpy()})
        return pd.DataFrame({"node": np.r_[a["node"].to_numpy(), b["node"].to_numpy()],
                             "links": np.r_[hit @ b["n"].to_numpy(), hit.T @ a["n"].to_numpy()]})

    return run
