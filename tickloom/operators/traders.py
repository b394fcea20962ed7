"""Exact distinct traders from bitmaps that merge.

Traders of an asset get dense codes, so a set of them is a bitmap. Bitmaps are kept per (asset, minute) and
are or-ed together for any longer span and across any cut of the input; nothing is counted twice. A bitmap is kept in
words of 63 codes, and only words with a trader are rows, so minutes take no more room than their trades. Codes are
handed out per (asset, salt) and then moved behind each other, so no task sees all traders of a hot asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import bucket_start
from .common import SALTS, shuffled, spread_join

KINDS = ("makers", "buyers", "sellers")
DAY = 86400
BITS = 63  # codes in a word: a number that is never negative


def trader_codes(trades: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """asset_id, user_address, code: dense from 0 per asset; codes once given in ``known`` stay."""
    key = ["asset_id", "user_address"]
    new = trades.select(*key).where("user_address IS NOT NULL").distinct()
    first = F.lit(0)
    if known is not None:
        new = new.join(shuffled(known.select(*key)), key, "left_anti")
    new = new.withColumn("_salt", F.pmod(F.xxhash64("user_address"), F.lit(SALTS)).cast("int"))
    sizes = new.groupBy("asset_id", "_salt").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("asset_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("asset_id", "_salt", F.coalesce(ahead, F.lit(0)).alias("_start"))
    if known is not None:
        held = known.groupBy("asset_id").agg((F.max("code") + 1).alias("_held"))
        starts = starts.join(shuffled(held), "asset_id", "left")
        first = F.coalesce("_held", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("asset_id", "_salt").orderBy("user_address")) - 1
    coded = new.withColumn("_rank", rank).join(shuffled(starts), ["asset_id", "_salt"])
    coded = coded.select(*key, (F.col("_rank") + F.col("_start") + first).cast("bigint").alias("code"))
    return coded if known is None else known.select(*key, "code").unionByName(coded)


def _stored(word: Column) -> Column:
    """A word as eight bytes."""
    return F.unhex(F.lpad(F.hex(F.coalesce(word, F.lit(0))), 16, "0"))


def _word(stored: Column) -> Column:
    return F.conv(F.hex(stored), 16, 10).cast("bigint")


def _sets(coded: DataFrame, *keys: str) -> DataFrame:
    """One word per key, part of the code space and kind of trader."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("code") % BITS).cast("int"))
    return coded.groupBy(*keys, F.floor(F.col("code") / BITS).alias("part")).agg(
        _stored(F.bit_or(bit)).alias("makers"),
        _stored(F.bit_or(F.when(F.col("side") == "buy", bit))).alias("buyers"),
        _stored(F.bit_or(F.when(F.col("side") == "sell", bit))).alias("sellers"),
    )


def _united(words: DataFrame, *keys: str) -> DataFrame:
    """Words of the same keys or-ed together."""
    return words.groupBy(*keys).agg(*(_stored(F.bit_or(_word(F.col(c)))).alias(c) for c in KINDS))


def trader_minutes(trades: DataFrame, codes: DataFrame) -> DataFrame:
    """asset_id, bucket, part and a word for each kind of trader."""
    coded = spread_join(trades, codes, ["asset_id", "user_address"])
    return _sets(coded.withColumn("bucket", bucket_start(F.col("event_unix_ts"), 60)), "asset_id", "bucket")


def merge_minutes(minutes: DataFrame, *others: DataFrame) -> DataFrame:
    """Minutes of several parts of the input as one; any cut, overlap or repetition gives the same."""
    for other in others:
        minutes = minutes.unionByName(other)
    return _united(minutes, "asset_id", "bucket", "part")


def distinct_traders(minutes: DataFrame, trades: DataFrame, codes: DataFrame, span: int = DAY) -> DataFrame:
    """Distinct makers, buyers and sellers in the span before each asset's last trade.

    Whole minutes come from the bitmaps; of ``trades`` only the one minute is read in which the span begins.
    """
    last = trades.groupBy("asset_id").agg(F.max("event_time").alias("_last"))
    start = F.col("_last") - F.make_dt_interval(secs=F.lit(span))
    begin = last.select("asset_id", start.alias("_start"), bucket_start(F.unix_seconds(start), 60).alias("_edge"))
    # a minute that starts after the span does is whole
    inside = minutes.join(shuffled(begin), "asset_id").where(F.timestamp_seconds("bucket") > F.col("_start")).select("asset_id", "part", *KINDS)
    edge = spread_join(trades, begin, ["asset_id"]).where(
        (bucket_start(F.col("event_unix_ts"), 60) == F.col("_edge")) & (F.col("event_time") > F.col("_start"))
    ).where(F.timestamp_seconds("_edge") <= F.col("_start"))
    rest = _sets(spread_join(edge, codes, ["asset_id", "user_address"]), "asset_id")
    whole = _united(inside.unionByName(rest), "asset_id", "part")
    return whole.groupBy("asset_id").agg(*(F.sum(F.bit_count(_word(F.col(c))).cast("bigint")).alias(c) for c in KINDS))
