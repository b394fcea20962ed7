"""Operational metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LATENCY_BOUNDS


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


def latency_bucket(c: Column) -> Column:
    """Index of the first bound the value does not exceed; the last bucket is overflow."""
    out: Column = F.lit(len(LATENCY_BOUNDS))
    for i, bound in reversed(list(enumerate(LATENCY_BOUNDS))):
        out = F.when(c <= bound, i).otherwise(out)
    return out


def latency_histogram(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, average and bucket counts in one pass."""
    c = F.col(column).cast("double")
    bucket = latency_bucket(c)
    counts = [F.count_if(bucket == i).alias(f"b{i}") for i in range(len(LATENCY_BOUNDS) + 1)]
    rows = df.where(_usable(c)).groupBy(*by).agg(
        F.count("*").alias("count"), F.coalesce(F.sum(c), F.lit(0.0)).alias("sum"), *counts
    )
    average = F.coalesce(F.try_divide(F.col("sum"), F.col("count")), F.lit(0.0))
    return rows.select(
        *by, "count", "sum", average.alias("average"), F.array(*(f"b{i}" for i in range(len(counts)))).alias("bucket_counts")
    )


def request_rollup(df: DataFrame) -> DataFrame:
    """Requests per route and status beside the route's total and latency."""
    c = F.col("latency_ms").cast("double")
    per = df.groupBy("route", "status").agg(
        F.count("*").alias("requests"),
        F.sum(F.when(_usable(c), c)).alias("_sum"),
        F.count_if(_usable(c)).alias("_n"),
    )
    route = per.groupBy("route").agg(
        F.sum("requests").alias("route_requests"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("route_average_ms")
    )
    return per.join(route, "route").select("route", "status", "requests", "route_requests", "route_average_ms")
