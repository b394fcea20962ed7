"""Scans over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import empty_to_null, strict_other_side
from .common import spread_join


def events_by_ref(log: DataFrame, ref: str, value: str, limit: int = 100) -> DataFrame:
    """Newest events that refer to an asset ('mint') or a pool ('pool')."""
    return log.where(F.col(f"refs.{ref}") == value).orderBy(F.desc("log_id")).limit(limit)


def events_after(log: DataFrame, after: int, limit: int, asset: str | None = None) -> DataFrame:
    """The next page of the log, oldest first."""
    page = log.where(F.col("log_id") > after)
    if asset is not None:
        page = page.where(F.col("refs.mint") == asset)
    return page.orderBy("log_id").limit(limit)


def latest_event(log: DataFrame, event_type: str, protocol: str | None = None) -> DataFrame:
    """Per asset the newest event of a type in chain order."""
    chosen = log.where((F.col("event_type") == event_type) & F.col("refs.mint").isNotNull())
    if protocol is not None:
        chosen = chosen.where(F.col("protocol") == protocol)
    at = F.struct("slot", "tx_index", "instruction_path.outer_index", "instruction_path.inner_index")
    newest = chosen.groupBy(F.col("refs.mint").alias("asset_id")).agg(F.max_by(F.struct(*log.columns), at).alias("e"))
    return newest.select("asset_id", "e.*")


def tracked_only(log: DataFrame, known: DataFrame | None = None, create_type: str = "create") -> DataFrame:
    """Events of assets whose create event came before (or is the event itself), or that were known at start."""
    asset = F.coalesce("refs.mint", strict_other_side(F.col("refs.base_mint"), F.col("refs.quote_mint")))
    events = log.withColumn("asset_id", asset)
    created = events.where(F.col("event_type") == create_type).select("asset_id", F.col("log_id").alias("_from"))
    if known is not None:
        created = created.unionByName(known.select("asset_id", F.lit(-1).cast("bigint").alias("_from")))
    since = created.where(empty_to_null(F.col("asset_id")).isNotNull()).groupBy("asset_id").agg(F.min("_from").alias("_from"))
    joined = spread_join(events, since, ["asset_id"], spread=("log_id",))
    return joined.where(F.col("log_id") >= F.col("_from")).drop("_from")
