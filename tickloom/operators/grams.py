"""Substring search by an index of three-character grams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .board import search

SIZE = 3


def gram_index(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """gram, asset_id: every gram of the lower-cased id, name and symbol, once per asset.

    Stored sorted by gram (``write_index``) a lookup reads the row groups of its grams only.
    """
    named = tokens.select("asset_id").join(meta.select("asset_id", "name", "symbol"), "asset_id", "left")
    text = named.select("asset_id", F.explode(F.array("asset_id", "name", "symbol")).alias("text")).where("text IS NOT NULL")
    low = text.withColumn("text", F.lower("text")).where(F.length("text") >= SIZE)
    starts = F.sequence(F.lit(1), F.length("text") - (SIZE - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(SIZE))))
    return low.select("asset_id", F.explode(grams).alias("gram")).distinct().select("gram", "asset_id")


def write_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("gram", "asset_id").sortWithinPartitions("gram", "asset_id").write.mode("overwrite").parquet(path)


def grams_of(text: str) -> list[str]:
    """Grams that a match must hold: those of the stretches between wildcards."""
    if "\\" in text:  # an escape changes what the next character means
        return []
    return sorted({part[i : i + SIZE] for part in re.split("[%_]", text.strip().lower()) for i in range(len(part) - SIZE + 1)})


def candidates(index: DataFrame, text: str) -> DataFrame:
    """Assets that hold all grams of a text, in whichever fields."""
    grams = grams_of(text)
    held = index.where(F.col("gram").isin(grams)).groupBy("asset_id").agg(F.count("*").alias("_n"))
    return held.where(F.col("_n") == len(grams)).select("asset_id")


def search_indexed(index: DataFrame, tokens: DataFrame, meta: DataFrame, metrics: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The rows of ``search``; with three characters or more only candidates are matched and ranked."""
    if not grams_of(text):
        return search(tokens, meta, metrics, text, limit)
    few = candidates(index, text)
    return search(tokens.join(few, "asset_id", "left_semi"), meta, metrics, text, limit)
