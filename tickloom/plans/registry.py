"""Where the checked queries are collected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bindings import checked

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and floats as DOUBLE, so both engines show the same types."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType | T.DecimalType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, needs: Sequence[str] = ()) -> Callable[[Build], Build]:
    """Register a query and, where one exists, the SQL that must give the same rows."""

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: plain(build(spark, sf))
        if sql is not None:
            ORACLE[name] = checked(sql, *needs)
        return build

    return keep


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    """Sums of doubles depend on order in the last bits; show them to ``places`` digits."""
    return df.withColumns({n: F.round(F.col(n), places) for n in names})
