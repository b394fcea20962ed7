"""A stored log clustered for paging: a page reads the few files that hold it.

Files are sorted by a key and the log position, or by the position alone. Beside them lies a list of what
each file holds: per key the number of rows and the least and greatest position. Files that lie wholly behind the cursor tell
how far a page can reach; only files that begin before that are opened. Appends are clustered on their own and listed,
so files may overlap. What goes to the driver is at most one entry per row of the page, and the files chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.tables import VersionedTable


class PagedLog:
    def __init__(self, path: str, key: str | None = "asset_id"):
        self.path, self.key = path.rstrip("/"), key
        self.rows, self.files = VersionedTable(f"{self.path}/rows"), VersionedTable(f"{self.path}/files")

    def append(self, log: DataFrame, version: int, files: int | None = None) -> None:
        """Write a part of the log under a version; a version written again replaces itself."""
        order = [*([self.key] if self.key else []), "log_id"]
        ranged = log.repartitionByRange(files, *order) if files else log.repartitionByRange(*order)
        self.rows.write(ranged.sortWithinPartitions(*order), version)
        stored = self.rows.read(log.sparkSession, version)
        group = [F.col(self.key) if self.key else F.lit(None).cast("string")]
        held = stored.groupBy(F.col("_metadata.file_path").alias("file"), group[0].alias("key")).agg(
            F.min("log_id").alias("low"), F.max("log_id").alias("high"), F.count("*").alias("n")
        )
        self.files.write(held.repartitionByRange("key").sortWithinPartitions("key"), version)

    def _held(self, spark: SparkSession, key: str | None) -> DataFrame:
        held = self.files.all(spark)
        return held if key is None else held.where(F.col("key") == key)

    def _read(self, spark: SparkSession, files: DataFrame) -> DataFrame:
        paths = [r[0] for r in files.select("file").distinct().collect()]
        return spark.read.parquet(*paths) if paths else self.rows.all(spark).drop("v").limit(0)

    def _reach(self, sure: DataFrame, bound: str, order: Column, limit: int) -> int | None:
        """The position up to which files that count in full have ``limit`` rows; each has one at least."""
        count = 0
        for row in sure.orderBy(order).select(bound, "n").limit(limit).collect():
            count += row.n
            if count >= limit:
                return row[bound]
        return None

    def newest(self, spark: SparkSession, key: str, limit: int = 100, before: int | None = None) -> DataFrame:
        """The newest rows of a key below a position, newest first."""
        held, mine = self._held(spark, key), F.col(self.key) == key
        if before is not None:
            held, mine = held.where(F.col("low") < before), mine & (F.col("log_id") < before)
        sure = held if before is None else held.where(F.col("high") < before)
        reach = self._reach(sure, "low", F.desc("low"), limit)
        chosen = held if reach is None else held.where(F.col("high") >= reach)
        return self._read(spark, chosen).where(mine).orderBy(F.desc("log_id")).limit(limit)

    def after(self, spark: SparkSession, position: int, limit: int, key: str | None = None) -> DataFrame:
        """The next rows above a position, oldest first."""
        held, mine = self._held(spark, key).where(F.col("high") > position), F.col("log_id") > position
        if key is not None:
            mine = mine & (F.col(self.key) == key)
        reach = self._reach(held.where(F.col("low") > position), "high", F.asc("high"), limit)
        chosen = held if reach is None else held.where(F.col("low") <= reach)
        return self._read(spark, chosen).where(mine).orderBy("log_id").limit(limit)
