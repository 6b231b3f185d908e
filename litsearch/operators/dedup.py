"""Duplicates by key hash.

A group of copies can be as large as the table, so no step here gathers a group: groups are
counted with partial aggregation before the shuffle, and members are told apart by their own id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from litsearch.functions.text import key_hash


def _groups(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return (
        df.select(key_hash(*[F.col(k) for k in keys]).alias("key_hash"), id_col)
        .groupBy("key_hash")
        .agg(F.count("*").alias("n_docs"), F.min(id_col).alias("first_id"))
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Key hashes held by more than one row, with their number of rows and lowest id."""
    return _groups(df, keys, id_col).filter("n_docs > 1")


def duplicate_members(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(key_hash, id) of every row whose key hash is held by more than one row.

    The map from hash to ids, one row per id. ``id_col`` must be unique: rows alone in their
    group are removed by id, a key without heavy values, rather than kept by hash.
    """
    alone = _groups(df, keys, id_col).filter("n_docs = 1").select(F.col("first_id").alias(id_col))
    hashed = df.select(key_hash(*[F.col(k) for k in keys]).alias("key_hash"), id_col)
    return hashed.join(alone, id_col, "left_anti").select("key_hash", id_col)


def drop_duplicates(df: DataFrame, keys: Sequence[str], id_col: str, keep: str = "first") -> DataFrame:
    """Remove duplicates; ``id_col`` must be unique.

    ``keep="first"`` leaves the row with the lowest id of each group, ``keep="none"`` removes
    every row that has a copy.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be 'first' or 'none', got {keep!r}")
    groups = _groups(df, keys, id_col)
    if keep == "none":
        groups = groups.filter("n_docs = 1")
    kept = groups.select(F.col("first_id").alias(id_col))
    return df.join(kept, id_col, "left_semi")


def drop_repeated_ids(df: DataFrame, id_col: str, order_by: str) -> DataFrame:
    """Keep one row per id, the one lowest in ``order_by`` (an id indexed more than once)."""
    row = F.min_by(F.struct(*df.columns), F.col(order_by)).alias("_row")
    return df.groupBy(id_col).agg(row).select("_row.*")


def dedup_report(df: DataFrame, keys: Sequence[str], keep: str = "first") -> DataFrame:
    """Row counts before and after removing duplicates, from one aggregation."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be 'first' or 'none', got {keep!r}")
    groups = (
        df.groupBy(key_hash(*[F.col(k) for k in keys]).alias("key_hash"))
        .agg(F.count("*").alias("n_docs"))
    )
    kept = F.count("*") if keep == "first" else F.count_if(F.col("n_docs") == 1)
    return groups.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_before"), kept.alias("n_after"))
