"""Shards that all have the mixture of the whole, by proportional interleaving of the sources.

Rows are ranked in a seeded random order within their source; the rank over the source's size
places a row on a line from 0 to 1, and the line is cut into shards of equal row counts. Ranks
are computed in buckets of the random order, with the counts of earlier buckets added, so
neither a source nor a shard is ever sorted in one task. The text itself is not shuffled.

Defined results: a null source is a source of its own; a null text has no bytes; repeated rows
are rows like others and take slots of their own; with fewer rows than shards some are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

SHARDS = 40
SEED = 17
CELLS = 4096  # buckets of a source's random order, and of the line

ORDER = ["h", "doc_id", "text_crc32", "size"]


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the order needs of every row: ids, sizes, and the seeded hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.when(F.col("source").isNull(), "none").otherwise(F.concat(F.lit("="), "source")).alias("stratum"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, stratum, size, text_crc32, shard and slot (from 0, without gaps)."""
    path = scratch(docs.sparkSession, "sized")
    sized(docs, seed).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path).withColumn("cell", F.substring("h", 1, 3))
    order = Window.partitionBy("stratum").orderBy("cell")
    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n")).select(
        "stratum", "cell",
        (F.sum("n").over(order) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy("stratum", "cell").orderBy(*ORDER))
    ranked = rows.join(cells, ["stratum", "cell"]).withColumn("rank", F.col("before") + inside - 1)
    placed = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("total")).cast("double"))
    placed = placed.withColumn("part", F.floor(F.col("fraction") * CELLS)).drop("before", "total", "rank")
    # at most CELLS rows
    parts = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    # very many sources may give one fraction: its rows are ranked in cells of the random order, as a source's are
    cells = placed.groupBy("part", "fraction", "cell").agg(F.count("*").alias("n"))
    line = Window.partitionBy("part").orderBy("fraction")
    fractions = cells.groupBy("part", "fraction").agg(F.sum("n").alias("n")).select("part", "fraction", (F.sum("n").over(line) - F.col("n")).alias("lower"))
    order = Window.partitionBy("part", "fraction").orderBy("cell")
    cells = cells.select("part", "fraction", "cell", (F.sum("n").over(order) - F.col("n")).alias("ahead")).join(fractions, ["part", "fraction"])
    inside = F.row_number().over(Window.partitionBy("part", "fraction", "cell").orderBy("h", "stratum", *ORDER[1:]))
    whole = placed.withColumn("inside", inside).join(cells, ["part", "fraction", "cell"]).join(parts, "part")
    whole = whole.withColumn("at", F.col("before") + F.col("lower") + F.col("ahead") + F.col("inside") - 1)
    whole = whole.withColumn("shard", F.expr(f"CAST((at * {shards}) DIV total AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * total + {shards - 1}) DIV {shards}")
    return whole.select("doc_id", "stratum", "size", "text_crc32", "shard", (F.col("at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the documents as one folder per shard, in slot order within a file.

    A doc_id names one document here; repeated ids are written once per row.
    """
    placed = interleave(docs, shards, seed).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"text_crc32": F.crc32(text)})
    joined = keyed.join(placed, [keyed.doc_id.eqNullSafe(placed.doc_id), keyed.text_crc32 == placed.text_crc32]).drop(placed.doc_id, placed.text_crc32, keyed.text_crc32)
    joined.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
