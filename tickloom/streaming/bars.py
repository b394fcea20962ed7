"""A stored table of bars, partitioned by day, of which only touched days are written again.

A refresh takes dirty (asset, bucket) keys, computes those bars from the trades of the same days, and
keeps the other bars of these days. The new days are staged first and marked; then they replace
the old ones by dynamic partition overwrite, and a second mark closes the version. A version that is closed is
never applied again; one that broke off while days were being replaced is replayed from what was staged, so
a lost day comes back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import bucket_start
from ..operators.candles import YEAR, candles, dirty_buckets
from .tables import VersionedTable

DAY = 86400
COLUMNS = ["asset_id", "bucket", "open_raw_price", "high_raw_price", "low_raw_price", "close_raw_price", "quote_mint_sample", "volume_quote_raw"]


def _by_day(bars: DataFrame) -> DataFrame:
    # a day's bars go to as few files as the runtime finds fit; a large day is split
    return bars.withColumn("day", F.floor(F.col("bucket") / DAY).cast("int")).select(*COLUMNS, "day")


class BarTable:
    def __init__(self, path: str, size: int = 60):
        self.path, self.size = path.rstrip("/"), size
        self.staged = VersionedTable(f"{self.path}-staged")
        self.ready = VersionedTable(f"{self.path}-ready")
        self.closed = VersionedTable(f"{self.path}-closed")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def create(self, bars: DataFrame) -> None:
        """The first content of the table."""
        self._replace(_by_day(bars))

    def _replace(self, rows: DataFrame) -> None:
        days = rows.repartition("day", F.pmod(F.xxhash64("asset_id"), F.lit(8)))
        writer = days.sortWithinPartitions("day", "asset_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day").parquet(self.path)

    def _old(self, spark: SparkSession, days: list[int]) -> DataFrame | None:
        try:
            return self.read(spark).where(F.col("day").isin(days))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def reload(self, trades: DataFrame, dirty: DataFrame, version: int) -> list[int]:
        """Compute the dirty buckets again under a version; the days that were written.

        ``trades`` holds all trades; only the days of dirty buckets are read of it. The list of days is
        bounded by the refresh span, a day per entry.
        """
        spark = trades.sparkSession
        if self.closed.newest(spark) >= version:
            return []
        if self.ready.newest(spark) < version:
            keys = dirty.select("asset_id", "bucket").distinct()
            days = sorted(r[0] for r in keys.select(F.floor(F.col("bucket") / DAY).cast("int")).distinct().collect())
            self.staged.write(self._content(trades, keys, days), version)
            self.ready.write(spark.createDataFrame([(d,) for d in days], "day int"), version)
        days = [r[0] for r in self.ready.read(spark, version).collect()]
        if days:
            self._replace(self.staged.read(spark, version))
        self.closed.write(spark.createDataFrame([(version,)], "version bigint"), version)
        return days

    def _content(self, trades: DataFrame, keys: DataFrame, days: list[int]) -> DataFrame:
        """All bars of some days, the dirty ones from the trades."""
        low, high = (min(days) * DAY, (max(days) + 1) * DAY) if days else (0, 0)
        at = F.col("event_unix_ts")
        near = trades.where((at >= low) & (at < high) & F.floor(at / DAY).cast("int").isin(days))
        near = near.withColumn("bucket", bucket_start(at, self.size)).join(keys, ["asset_id", "bucket"], "left_semi")
        fresh = _by_day(candles(near.drop("bucket"), self.size))
        old = self._old(trades.sparkSession, days)
        return fresh if old is None else old.join(keys, ["asset_id", "bucket"], "left_anti").select(*fresh.columns).unionByName(fresh)

    def refresh(self, trades: DataFrame, changed: DataFrame, now: int, version: int, lookback: int = YEAR) -> list[int]:
        """Reload the closed buckets inside the refresh span that the changed trades fall in."""
        return self.reload(trades, dirty_buckets(changed, self.size, now, lookback), version)


def reload_late(spark: SparkSession, bars: BarTable, trades: DataFrame, late_path: str) -> list[int]:
    """Reload the buckets that ``late_trades`` has marked since the last reload, each version once."""
    dirty = VersionedTable(f"{late_path.rstrip('/')}/dirty")
    newest = dirty.newest(spark)
    # a version that was staged but not closed comes first: its buckets are fixed
    done, ready = bars.closed.newest(spark), bars.ready.newest(spark)
    days = []
    for version in sorted({v for v in (ready, newest) if v > done}):
        marked = dirty.all(spark).where((F.col("v") > done) & (F.col("v") <= version))
        days += bars.reload(trades, marked, version)
        done = version
    return days
