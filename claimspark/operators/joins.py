"""Equi-joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8
SLICE_ROWS = 20_000
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that. This is an action."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "inner"
) -> DataFrame:
    """Join with a usually short, narrow ``right``: broadcast after a count, salted if it is long.

    For tables whose size Spark cannot estimate, such as ones made from driver data.
    """
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, spread, how)


def salted_join(
    left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join where a key of ``left`` may be hot and ``right`` holds few rows per key.

    Each left row goes to one of ``salts`` slices of its key, chosen by ``spread``, and each
    right row to all of them, so a hot key is worked on by ``salts`` tasks. No size is assumed
    and no broadcast forced: adaptive execution broadcasts ``right`` if it turns out small and
    splits what is still skewed.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    slices = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_right = right.withColumn("_salt", slices)
    return salted_left.join(salted_right, [on, "_salt"], how).drop("_salt")


def counted_join(
    left: DataFrame, right: DataFrame, on: str, spread: str, count: str, how: str = "inner", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Join with a ``right`` of one row per key that tells in ``count`` how many rows of ``left`` have the key.

    Only keys of more than ``slice_rows`` rows are cut, each into as many slices as its count needs,
    so ``right`` has hardly more rows than it had, and no task gets a hot key whole. Of hot keys there
    are at most the rows of ``left`` by ``slice_rows``; they are broadcast after a row count, and where they are too many
    for that every key is salted. ``right`` is read twice: hand in a written table.
    """
    slices = F.ceil(F.col(count) / slice_rows).cast("int")
    hot = right.where(F.col(count) > slice_rows).select(on, slices.alias("_slices"))
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if not found:
        return left.join(right, on, how)
    if found > BROADCAST_ROWS:
        return salted_join(left, right, on, spread, how)
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_slices", F.lit(1))).cast("int")
    cut_left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_slices")
    cut_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1)))
    return cut_left.join(cut_right, [on, "_salt"], how).drop("_salt")


def hot_cold_lookup(
    left: DataFrame, lookup: DataFrame, on: str, spread: str, value: str, hot: DataFrame
) -> DataFrame:
    """Left join of one ``value`` per key where the hot keys are known and provably few.

    ``hot`` is the part of ``lookup`` that holds the hot keys; the caller guarantees its bound.
    It is broadcast. Rows it serves are spread over the shuffle of the rest by ``spread`` under a
    key that matches nothing, so no task gets a hot key.
    """
    hot_side = hot.select(F.col(on), F.col(value).alias("_hot"))
    served = left.join(F.broadcast(hot_side), on, "left")
    shuffle_key = F.when(F.col("_hot").isNull(), F.col(on)).otherwise(
        F.concat(F.lit("\x00"), F.col(spread).cast("string"))
    )
    cold_side = lookup.select(F.col(on).alias("_key"), F.col(value).alias("_cold"))
    return (
        served.withColumn("_key", shuffle_key)
        .join(cold_side, "_key", "left")
        .withColumn(value, F.coalesce("_hot", "_cold"))
        .drop("_key", "_hot", "_cold")
    )
