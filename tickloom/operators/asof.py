"""Last trade at or before a moment, for many moments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import bucket_start
from ..session import scratch

CROWD = 1 << 20  # rows of one asset and bucket that a task takes
LINE = ("_at", "_probe", "slot", "insert_seq")


def _running(rows: DataFrame, *keys: str) -> DataFrame:
    """Probes with ``_in``, the last trade before them under the same keys."""
    inside = Window.partitionBy(*keys).orderBy(*LINE).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.last("_price", True).over(inside)).where("_probe = 1")


def split_crowded(rows: DataFrame) -> DataFrame:
    """Rows of crowded cells with ``_part``: ranges of the line of each cell, cut at sampled places.

    They are written, since a range is drawn anew each time it is computed. Probes of one moment may fall into
    several parts: all see the same trades before them.
    """
    path = scratch(rows.sparkSession, "crowded")
    rows.repartitionByRange("asset_id", "_bucket", *LINE, F.xxhash64("_kept")).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _running_by_parts(rows: DataFrame) -> DataFrame:
    """The same for crowded cells: a running last inside each part, and the last trade of each part carried on."""
    parts = split_crowded(rows)
    cell = ["asset_id", "_bucket"]
    ends = parts.groupBy(*cell, "_part").agg(F.max_by("_price", F.when(F.col("_probe") == 0, F.struct("_at", "slot", "insert_seq"))).alias("_end"))
    before = Window.partitionBy(*cell).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_so_far", F.last("_end", True).over(before)).drop("_end")
    found = _running(parts, *cell, "_part").join(carried, [*cell, "_part"])
    return found.withColumn("_in", F.coalesce("_in", "_so_far")).drop("_part", "_so_far")


def asof_price(trades: DataFrame, probes: DataFrame, bucket_seconds: int = 3600, crowd: int = CROWD) -> DataFrame:
    """Add ``price``: the last trade at or before ``probe_time``, else the asset's first one after.

    ``trades`` has asset_id, event_time, event_unix_ts, slot, insert_seq, price; ``probes``
    has asset_id, probe_time and whatever else should be kept.

    Work is cut by (asset, time bucket) cells: inside a cell a running last value; across
    cells only the last trade of each is carried on. A cell of more than ``crowd`` rows is cut again, at
    sampled places of its line, and the last trade of each part is carried on inside the cell. So no task
    holds more than about ``crowd`` rows, and what is carried is bounded by time and by parts, not by trades.
    """
    t = trades.where("price IS NOT NULL").select(
        "asset_id",
        bucket_start(F.col("event_unix_ts"), bucket_seconds).alias("_bucket"),
        F.col("event_time").alias("_at"),
        F.lit(0).alias("_probe"),
        "slot",
        "insert_seq",
        F.col("price").alias("_price"),
    )
    kept = [c for c in probes.columns if c != "asset_id"]
    p = probes.select(
        "asset_id",
        bucket_start(F.unix_seconds("probe_time"), bucket_seconds).alias("_bucket"),
        F.col("probe_time").alias("_at"),
        F.lit(1).alias("_probe"),
        F.struct(*kept).alias("_kept"),
    )
    both = t.unionByName(p, allowMissingColumns=True)
    # one row per cell, stored: it tells crowded cells and what is carried
    order = F.when(F.col("_probe") == 0, F.struct("_at", "slot", "insert_seq"))
    path = scratch(trades.sparkSession, "cells")
    cells = both.groupBy("asset_id", "_bucket").agg(F.max_by("_price", order).alias("_last"), F.min_by("_price", order).alias("_first"), F.count("*").alias("_rows"))
    cells.write.parquet(path)
    cells = trades.sparkSession.read.parquet(path)
    line = Window.partitionBy("asset_id").orderBy("_bucket")
    carried = cells.select(
        "asset_id",
        "_bucket",
        F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(line.rowsBetween(0, Window.unboundedFollowing)).alias("_after"),
    )
    crowded = cells.where(F.col("_rows") > crowd).select("asset_id", "_bucket")
    if crowded.isEmpty():
        found = _running(both, "asset_id", "_bucket")
    else:
        cell = ["asset_id", "_bucket"]
        found = _running(both.join(crowded, cell, "left_anti"), *cell).unionByName(_running_by_parts(both.join(crowded, cell, "left_semi")))
    return found.select("asset_id", "_bucket", "_kept", "_in").join(carried, ["asset_id", "_bucket"], "left").select(
        "asset_id", "_kept.*", F.coalesce("_in", "_before", "_after").alias("price")
    )
