"""Candles: rollups at six sizes, paging, refresh and the live-chart forms.

Buckets are unix seconds (BIGINT). Open and close follow insert order inside the finest
bucket and bucket order above it; all aggregates combine map-side, so an asset with very
many trades is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CURVE, DEFAULT_TOKEN_DECIMALS, NATIVE_DECIMALS, RESOLUTIONS, ROLLUP_FROM
from ..functions.display import bucket_start
from ..functions.scalars import normalize_price, quote_decimals_of, raw_price, scale_amount
from .common import first_per_key, shuffled

YEAR = 365 * 86400
CANDLE = ["open_raw_price", "high_raw_price", "low_raw_price", "close_raw_price"]


def candles(trades: DataFrame, size: int = 60, by_quote: bool = False) -> DataFrame:
    """Open, high, low, close and quote volume per asset and bucket, from trades.

    ``by_quote`` adds the quote currency to the key; otherwise volumes of different
    currencies are summed and the least name is kept as a sample.
    """
    priced = trades.where("token_amount_raw <> 0").select(
        "asset_id",
        "quote_mint",
        "insert_seq",
        "quote_amount_raw",
        bucket_start(F.col("event_unix_ts"), size).alias("bucket"),
        raw_price(F.col("quote_amount_raw"), F.col("token_amount_raw")).alias("price"),
    )
    sample = F.min("quote_mint").alias("quote_mint_sample")
    return priced.groupBy("asset_id", "bucket", *(["quote_mint"] if by_quote else [])).agg(
        F.min_by("price", "insert_seq").alias("open_raw_price"),
        F.max("price").alias("high_raw_price"),
        F.min("price").alias("low_raw_price"),
        F.max_by("price", "insert_seq").alias("close_raw_price"),
        sample,
        F.sum("quote_amount_raw").alias("volume_quote_raw"),
    )


def candles_1m(trades: DataFrame) -> DataFrame:
    return candles(trades, 60)


def rollup_candles(finer: DataFrame, size: int) -> DataFrame:
    """Coarser candles from finer ones."""
    return (
        finer.withColumn("_to", bucket_start(F.col("bucket"), size))
        .groupBy("asset_id", "_to")
        .agg(
            F.min_by("open_raw_price", "bucket").alias("open_raw_price"),
            F.max("high_raw_price").alias("high_raw_price"),
            F.min("low_raw_price").alias("low_raw_price"),
            F.max_by("close_raw_price", "bucket").alias("close_raw_price"),
            F.min("quote_mint_sample").alias("quote_mint_sample"),
            F.sum("volume_quote_raw").alias("volume_quote_raw"),
        )
        .withColumnRenamed("_to", "bucket")
    )


def candle_hierarchy(trades: DataFrame) -> dict[str, DataFrame]:
    """All six sizes, each from the next finer one."""
    out = {"1m": candles_1m(trades)}
    for name, finer in ROLLUP_FROM.items():
        out[name] = rollup_candles(out[finer], RESOLUTIONS[name])
    return out


def display_candles(bars: DataFrame, meta: DataFrame) -> DataFrame:
    """Prices and volume scaled by the asset's decimals; every bar is a traded one."""
    m = meta.select(
        "asset_id", "decimals", F.col("quote_mint").alias("_mq"), F.col("quote_decimals").alias("_md")
    )
    quote_dec = quote_decimals_of(F.col("quote_mint_sample"), F.col("_mq"), F.col("_md"))

    def price(name: str) -> Column:
        return normalize_price(F.col(f"{name}_raw_price"), F.col("decimals"), quote_dec).alias(name)

    return bars.join(shuffled(m), "asset_id", "left").select(
        "asset_id",
        F.col("bucket").alias("time"),
        *(price(n) for n in ("open", "high", "low", "close")),
        scale_amount(F.col("volume_quote_raw"), quote_dec).alias("volume"),
        F.lit(False).alias("is_gapfill"),
    )


def list_candles(
    bars: DataFrame, meta: DataFrame, asset: str, before: int | None = None, limit: int = 300
) -> DataFrame:
    """The newest ``limit`` bars of one asset before a time, oldest first."""
    mine = bars.where(F.col("asset_id") == asset)
    if before is not None:
        mine = mine.where(F.col("bucket") < before)
    newest = mine.orderBy(F.desc("bucket")).limit(limit)
    return display_candles(newest, meta).orderBy("time")


def candles_any(ticks: DataFrame, seconds: int) -> DataFrame:
    """Any bucket size; open and close are decided by (time, id)."""
    at = F.struct("event_time", "event_id")
    return (
        ticks.withColumn("bucket", bucket_start(F.col("event_unix_ts"), seconds))
        .groupBy("asset_id", "bucket")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.coalesce(F.sum("quote_amount"), F.lit(0.0)).alias("volume"),
        )
    )


def realtime_union(stored: DataFrame, trades: DataFrame, cut: int, size: int = 60) -> DataFrame:
    """Stored bars before the refresh edge, and bars computed now from the trades after it."""
    edge = cut - cut % size
    tail = candles(trades.where(F.col("event_unix_ts") >= edge), size)
    return stored.where(F.col("bucket") < edge).unionByName(tail)


def dirty_buckets(changed: DataFrame, size: int, now: int, lookback: int = YEAR) -> DataFrame:
    """Closed buckets inside the refresh span that the changed trades fall in."""
    bucket = bucket_start(F.col("event_unix_ts"), size)
    return (
        changed.select("asset_id", bucket.alias("bucket"))
        .where((F.col("bucket") >= now - lookback) & (F.col("bucket") + size <= now - size))
        .distinct()
    )


def refresh_candles(
    stored: DataFrame, trades: DataFrame, changed: DataFrame, now: int, size: int = 60, lookback: int = YEAR
) -> DataFrame:
    """Stored bars with only the touched buckets computed again from the trades.

    Keys are (asset, bucket), so even one asset's history spreads over time. A job that
    keeps bars by date writes the result with dynamic partition overwrite.
    """
    dirty = dirty_buckets(changed, size, now, lookback)
    touched = trades.withColumn("bucket", bucket_start(F.col("event_unix_ts"), size)).join(
        dirty, ["asset_id", "bucket"], "left_semi"
    )
    kept = stored.join(dirty, ["asset_id", "bucket"], "left_anti")
    return kept.unionByName(candles(touched.drop("bucket"), size))


def continuous_candles(bars: DataFrame) -> DataFrame:
    """Live-chart bars: each opens at the close before it, and high and low include that open.

    The window runs over bars, whose number per asset is bounded by time, not by trades.
    """
    before = F.lag("close").over(Window.partitionBy("asset_id").orderBy("time"))
    start = F.coalesce(before, F.col("open"))
    return bars.select(
        "asset_id",
        "time",
        start.alias("open"),
        F.when(before.isNull(), F.col("high")).otherwise(F.greatest(start, "high")).alias("high"),
        F.when(before.isNull(), F.col("low")).otherwise(F.least(start, "low")).alias("low"),
        "close",
        "volume",
    )


def merge_pages(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Both pages by time; where both have a bar the newer page's stays."""
    both = older.withColumn("_page", F.lit(0)).unionByName(newer.withColumn("_page", F.lit(1)))
    return first_per_key(both, ["asset_id", "time"], F.desc("_page")).drop("_page").orderBy("asset_id", "time")


def stage_markers(log: DataFrame, size: int, meta: DataFrame | None = None) -> DataFrame:
    """Migrations per bucket with the price they imply; one marker per event id."""
    moves = log.where((F.col("protocol") == CURVE) & (F.col("event_type") == "migrate"))
    moves = first_per_key(moves, ["event_id"], F.col("log_id")).select(
        "event_id",
        F.col("refs.mint").alias("asset_id"),
        bucket_start(F.col("event_unix_ts"), size).alias("time"),
        F.get_json_object("payload", "$.sol_amount").try_cast("double").alias("_quote"),
        F.get_json_object("payload", "$.mint_amount").try_cast("double").alias("_token"),
    )
    decimals: Column = F.lit(DEFAULT_TOKEN_DECIMALS)
    if meta is not None:
        moves = moves.join(shuffled(meta.select("asset_id", "decimals")), "asset_id", "left")
        decimals = F.coalesce(F.col("decimals"), decimals)
    price = F.try_divide(
        scale_amount(F.col("_quote"), F.lit(NATIVE_DECIMALS)), scale_amount(F.col("_token"), decimals)
    )
    return moves.select(
        "event_id", "asset_id", "time", F.when(F.col("_token") > 0, price).alias("price")
    ).orderBy("time")


def candle_change(bars: DataFrame) -> DataFrame:
    percent = F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100, F.lit(0.0))
    return bars.select(
        "asset_id",
        "time",
        (F.col("close") - F.col("open")).alias("change"),
        percent.alias("percent"),
        (F.col("close") >= F.col("open")).alias("is_up"),
    )
