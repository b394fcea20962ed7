"""Tables written one version per micro-batch.

A batch reads version ``batch_id - 1`` and writes ``batch_id``, so a retried batch
overwrites its own version and nothing is applied twice. What a batch reads was written to
the shared folder, so it survives the loss of any executor and carries no lineage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import first_per_key


class VersionedTable:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def at(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(self.at(version))

    def before(self, spark: SparkSession, batch_id: int, empty: DataFrame) -> DataFrame:
        """The version a batch starts from; ``empty`` gives the columns before the first one."""
        return empty.limit(0) if batch_id == 0 else self.read(spark, batch_id - 1)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self.at(version))

    def newest(self, spark: SparkSession) -> int:
        """The newest version written, -1 where there is none."""
        try:
            return self.all(spark).agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0]
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return -1
            raise

    def all(self, spark: SparkSession) -> DataFrame:
        """Every version's rows, with the version as column ``v``."""
        return spark.read.parquet(self.path)


def drain(writer, checkpoint: str, seconds: int | None = None) -> int:
    """Run a stream over what is there now; the last batch id, -1 where there was nothing.

    It runs as long as it takes; ``seconds`` sets a limit where one is wanted.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream still running after {seconds} s")
    if query.exception() is not None:
        raise query.exception()
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0), default=-1)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each batch's changed rows (update mode) as a version of a table."""
    table = VersionedTable(path)
    drain(stream.writeStream.outputMode("update").foreachBatch(lambda df, i: table.write(df, i)), checkpoint)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key of an upserted table."""
    return first_per_key(VersionedTable(path).all(spark), keys, F.desc("v")).drop("v")
