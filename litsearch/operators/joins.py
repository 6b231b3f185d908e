"""Joins for lookups by a key that may be very unevenly spread over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SLICE_ROWS = 1_000_000
HOT_KEYS = 10_000
PLACES = 1 << 19


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, spread_by: str,
    how: str = "inner", slice_rows: int = SLICE_ROWS, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """``rows`` joined to ``lookup`` with frequent keys cut into slices.

    ``weight`` is the lookup column that tells how many of ``rows`` carry the key. A key heavier
    than ``slice_rows`` is split into ``weight / slice_rows`` slices: its rows are dealt out by
    the hash of ``spread_by`` and its lookup row is repeated once per slice. Only the
    ``hot_keys`` heaviest keys are sliced, which bounds what is broadcast; a key beyond them
    holds less than one row in ``hot_keys``. The result is the same as that of a plain join.
    """
    keys = list(keys)
    # stated once for both uses of the lookup, so that they share one shuffle of it
    for k in keys:
        lookup = lookup.filter(F.col(k).isNotNull())
    hot = (
        lookup.filter(F.col(weight) > slice_rows)
        .groupBy(*keys).agg(F.max(F.ceil(F.col(weight) / slice_rows)).cast("int").alias("_slices"))
        .orderBy(F.desc("_slices"), *keys).limit(hot_keys)
    )
    deal = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_slices")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", deal).drop("_slices")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    repeated = (
        lookup.join(F.broadcast(hot), keys, "left").withColumn("_slice", copies).drop("_slices")
    )
    return dealt.join(repeated, [*keys, "_slice"], how).drop("_slice")


def split_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], frequent: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup``, whose ``frequent`` entries are broadcast: only rows that meet none of
    them are shuffled. The result is that of a plain join; ``frequent`` must name a bounded number of entries.
    """
    keys = list(keys)
    met = rows.join(F.broadcast(lookup.filter(frequent).withColumn("_frequent", F.lit(True))), keys, "left")
    rest = met.filter("_frequent IS NULL").select(*rows.columns).join(lookup.filter(~frequent), keys, how)
    return met.filter("_frequent").drop("_frequent").unionByName(rest)


def sift(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], places: int = PLACES) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``, ahead of a join that shuffles them.

    Keys are hashed to ``places``, which bounds what is broadcast however long ``wanted`` is. No row that is
    wanted is lost; others that fall on a wanted place stay, so the join itself is still needed.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(places)).alias("_place")
    return rows.select("*", place).join(F.broadcast(wanted.select(place).distinct()), "_place", "left_semi").drop("_place")
