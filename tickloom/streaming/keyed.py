"""A table kept in hash buckets, of which a batch reads and writes only those its keys fall in.

A bucket is the low bits of a hash of the key: ``depth`` bits with the value ``prefix``. When a bucket would
hold more than ``limit`` rows it is split as it is written, deeper by as many bits as it takes, so
what a batch touches follows its keys and not the size of the table. A version writes the touched buckets below
its own folder and then a manifest that says for every bucket in which version and folder its rows lie. The manifest is
written last: a reader of a version never sees half of it, and a retried batch starts from the
manifest before it and overwrites what it wrote. Small buckets with the same low bits share a folder of about ``PACK``
rows, so that the number of files follows the bytes and not the buckets; each row says which bucket and version it is of, and
a reader keeps those of the buckets it asked for. Nothing is collected but the touched buckets, at most one per key of the batch;
a whole read lists the buckets of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import VersionedTable

LIMIT = 1 << 17
MOST = 48  # bits; more than any table needs
PACK = 1 << 13  # rows of small buckets that share a folder
OWN = ["_depth", "_prefix", "_version"]  # the bucket and version of a stored row
MANIFEST = "depth int, prefix bigint, version bigint, n bigint, folder int"


def _low_bits(depth: Column) -> Column:
    return F.col("_hash").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), depth) - 1)


class KeyedTable:
    def __init__(self, path: str, keys: Sequence[str], limit: int = LIMIT):
        self.path, self.keys, self.limit = path.rstrip("/"), list(keys), limit
        # bits of a bucket that do not tell its folder
        self.shared = max(0, int(math.log2(PACK / limit)))
        self.data = VersionedTable(f"{self.path}/data")
        self.manifest = VersionedTable(f"{self.path}/manifest")

    def _hashed(self, df: DataFrame) -> DataFrame:
        # 42 bits of depth come from the hash, whatever the partitioning of the input
        return df.withColumn("_hash", F.xxhash64(F.lit("bucket"), *self.keys))

    def _placed(self, df: DataFrame, depths: list[int], buckets: DataFrame) -> DataFrame:
        """Rows with the bucket they fall in; each depth in use gives one candidate."""
        kinds = F.explode(F.array(*(F.lit(d) for d in depths)))
        return self._hashed(df).withColumn("depth", kinds).withColumn("prefix", _low_bits(F.col("depth"))).join(buckets, ["depth", "prefix"])

    def _paths(self, buckets: list) -> list[str]:
        folders = {(b.version, b.folder, b.prefix) for b in buckets if b.n}
        return sorted({f"{self.data.at(v)}/depth={d}/prefix={prefix & ((1 << d) - 1)}" for v, d, prefix in folders})

    def _rows(self, spark: SparkSession, buckets: list, schema: T.StructType) -> DataFrame:
        paths = self._paths(buckets)
        if not paths:
            return spark.createDataFrame([], schema)
        own = T.StructType().add("_depth", T.IntegerType()).add("_prefix", T.LongType()).add("_version", T.LongType())
        stored = spark.read.schema(T.StructType([*schema.fields, *own.fields])).parquet(*paths)
        asked = spark.createDataFrame([(b.depth, b.prefix, b.version) for b in buckets if b.n], own)
        return stored.join(F.broadcast(asked), OWN, "left_semi").select(*schema.names)

    def read(self, spark: SparkSession, version: int, schema: T.StructType | None = None) -> DataFrame:
        """All rows as of a version."""
        buckets = self.manifest.read(spark, version).collect()
        if schema is None:
            newest = max((b for b in buckets if b.n), key=lambda b: b.version)
            schema = spark.read.parquet(*self._paths([newest])).drop(*OWN).schema
        return self._rows(spark, buckets, schema)

    def touched(self, delta: DataFrame, version: int) -> tuple[DataFrame, list, DataFrame]:
        """The manifest before a version, the buckets that the keys of ``delta`` fall in, and these buckets' rows."""
        spark = delta.sparkSession
        if version > 0:
            before = self.manifest.read(spark, version - 1)
        else:
            before = spark.createDataFrame([(0, 0, -1, 0, 0)], MANIFEST)
        depths = [r[0] for r in before.select("depth").distinct().collect()]
        found = self._placed(delta.select(*self.keys), depths, before).groupBy("depth", "prefix", "version", "n", "folder").agg(F.count("*").alias("new"))
        buckets = found.collect()
        return before, buckets, self._rows(spark, buckets, delta.schema)

    def upsert(self, delta: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Version ``version``: ``merge(rows of the touched buckets, delta)`` in their place.

        ``merge`` gives one row per key of both sides, with the columns of ``delta``.
        """
        spark = delta.sparkSession
        before, buckets, old = self.touched(delta, version)
        if buckets:
            deeper = [(b.depth, b.prefix, min(MOST, b.depth + max(0, math.ceil(math.log2((b.n + b.new) / self.limit))))) for b in buckets]
            into = spark.createDataFrame(deeper, "depth int, prefix bigint, deep int")
            rows = self._placed(merge(old, delta), sorted({b.depth for b in buckets}), into)
            own = {"_depth": F.col("deep"), "_prefix": _low_bits(F.col("deep")), "_version": F.lit(version).cast("bigint")}
            rows = rows.withColumns(own).withColumn("depth", F.greatest(F.col("deep") - self.shared, F.lit(0)))
            rows = rows.withColumn("prefix", _low_bits(F.col("depth"))).drop("deep", "_hash")
            rows.repartition("depth", "prefix").write.mode("overwrite").partitionBy("depth", "prefix").parquet(self.data.at(version))
            written = self.data.read(spark, version).groupBy(F.col("_depth").alias("depth"), F.col("_prefix").alias("prefix")).agg(F.count("*").alias("n"))
            gone = spark.createDataFrame([(b.depth, b.prefix) for b in buckets], "depth int, prefix bigint")
            # a split leaves out the halves that no key falls in; they are buckets, too
            halves = spark.createDataFrame([(deep, prefix | k << depth) for depth, prefix, deep in deeper for k in range(1 << (deep - depth))], "depth int, prefix bigint")
            now = halves.join(written, ["depth", "prefix"], "left").select("depth", "prefix", F.lit(version).cast("bigint").alias("version"), F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("depth") - self.shared, F.lit(0)).alias("folder"))
            before = before.join(gone, ["depth", "prefix"], "left_anti").select(now.columns).unionByName(now)
        self.manifest.write(before.coalesce(8), version)
