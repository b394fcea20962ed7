"""Order keys and the joins every operator shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def display_key(prefix: str = "") -> Column:
    """Order of trades and activity on screen."""
    return F.struct(*(F.col(prefix + c) for c in ("event_time", "slot", "insert_seq")))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in order.

    A rank filter, so every map task keeps one row per key before the shuffle and a key
    with very many copies costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key with their ``rank``; cut map-side like ``first_per_key``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit)


def shuffled(per_key: DataFrame) -> DataFrame:
    """The side of a join that has a row per key, kept out of the driver.

    Spark judges a side by its file size, which knows neither how far rows were packed nor that ``explode`` repeats them,
    and would send millions of keys through the driver as a broadcast.
    """
    return per_key.hint("merge")


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = ("insert_seq",),
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows per key with a side that has at most one row per key.

    A single asset may own a third of all rows, so its rows are spread over ``salts``
    tasks by a hash of ``spread`` and the one-row side is repeated that often. The repeated
    side is shuffled, see ``shuffled``.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def requested(df: DataFrame, assets: DataFrame | Sequence[str] | None) -> DataFrame:
    """Keep the rows of the asked assets (a short Python list, or a DataFrame of any size)."""
    if assets is None:
        return df
    if isinstance(assets, DataFrame):
        return df.join(shuffled(assets.select("asset_id").distinct()), "asset_id", "left_semi")
    return df.where(F.col("asset_id").isin(list(assets)))


def requested_left(assets: DataFrame, df: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """Every asked asset once, with nulls (or zeros) where ``df`` has no row for it."""
    out = assets.select("asset_id").distinct().join(shuffled(df), "asset_id", "left")
    return out.fillna(0, subset=list(zero)) if zero else out
