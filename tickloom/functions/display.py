"""Bucketing, labels and number formatting (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IPFS_GATEWAY, IPFS_SCHEME

MILLIS_FROM = 10**11


def bucket_start(unix_ts: Column, seconds: int) -> Column:
    """Start of the bucket, in seconds; inputs above 1e11 are milliseconds."""
    secs = F.when(unix_ts > MILLIS_FROM, F.floor(unix_ts / 1000)).otherwise(unix_ts).cast("bigint")
    return secs - F.pmod(secs, F.lit(seconds).cast("bigint"))


def resolve_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, f"^{IPFS_SCHEME}", IPFS_GATEWAY)


def short_address(address: Column) -> Column:
    text = F.coalesce(address, F.lit(""))
    return F.when(text == "", "").otherwise(
        F.concat(F.left(text, F.lit(4)), F.lit("..."), F.right(text, F.lit(4)))
    )


def to_fixed(x: Column, places: int) -> Column:
    """Fixed-point text, rounding the exact binary value, exact ties away from zero.

    Spark formats from the shortest decimal text of a double, so 1.005 would round up
    although the number is a little below. Only such near ties need care: there the value
    is written as m / 2**k with whole m and compared with the tie in decimal arithmetic.
    """
    size = F.abs(x)
    steps = 10**places
    near_up = F.round(size, places)
    tie_twice = F.round(near_up * steps * 2).cast("decimal(38,0)") - 1
    text = size.try_cast("decimal(38,17)")
    looks_tied = text * (2 * steps) == tie_twice.cast("decimal(38,0)")
    k = (F.lit(55) - F.floor(F.log2(size))).cast("int")
    whole = (size * F.pow(F.lit(2.0), k.cast("double"))).try_cast("bigint").cast("decimal(19,0)")
    one = F.lit(1).cast("bigint")
    unit = F.call_function("shiftleft", one, F.lit(30)).cast("decimal(10,0)") * F.call_function(
        "shiftleft", one, k - 30
    ).cast("decimal(19,0)")
    below = whole * F.lit(2 * steps).cast("decimal(12,0)") < tie_twice.cast("decimal(14,0)") * unit
    risky = F.coalesce((size < 1e6) & (size > 1e-7) & looks_tied, F.lit(False))
    shown = F.when(risky & below, near_up - 1.0 / steps).otherwise(size)
    body = F.format_string(f"%.{places}f", shown)
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def compact_number(x: Column) -> Column:
    size = F.abs(x)
    unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3).otherwise(1.0)
    mark = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")
    return (
        F.when(~_finite(x), "--")
        .when(size >= 1, F.concat(to_fixed(x / unit, 2), mark))
        .otherwise(to_fixed(x, 4))
    )


def subscript_price(x: Column) -> Column:
    """Four decimals from 0.01 up; below, the count of leading zeros as a subscript and four digits."""
    size = F.abs(x)
    zeros = (-F.floor(F.log10(size)) - 1).cast("int")
    digits = F.format_string("%.18f", size).substr(zeros + 3, F.lit(4))
    marks = F.translate(zeros.cast("string"), "0123456789", "₀₁₂₃₄₅₆₇₈₉")
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0.0"), marks, digits)
    return (
        F.when(x.isNull() | (x == 0) | F.isnan(x), "0.00")
        .when(size >= 0.01, to_fixed(x, 4))
        .otherwise(small)
    )


def age_seconds(unix_ts: Column, now: Column) -> Column:
    """Whole seconds since the time, never negative; milliseconds are recognised."""
    ts = unix_ts.cast("bigint")
    millis = F.when(ts > MILLIS_FROM, ts).otherwise(ts * 1000)
    return F.floor(F.greatest(now.cast("bigint") * 1000 - millis, F.lit(0)) / 1000).cast("bigint")


def relative_age(unix_ts: Column, now: Column) -> Column:
    secs = age_seconds(unix_ts, now)

    def shown(unit: int, mark: str) -> Column:
        return F.concat(F.floor(secs / unit).cast("string"), F.lit(mark))

    return (
        F.when(unix_ts.isNull() | (unix_ts == 0), "--")
        .when(secs < 60, shown(1, "s"))
        .when(secs < 3600, shown(60, "m"))
        .when(secs < 86400, shown(3600, "h"))
        .otherwise(shown(86400, "d"))
    )


def heat_level(x: Column, thresholds: tuple[float, float, float]) -> Column:
    warm, hot, blazing = thresholds
    return (
        F.when(~_finite(x.cast("double")) | (x <= 0), 0)
        .when(x >= blazing, 3)
        .when(x >= hot, 2)
        .when(x >= warm, 1)
        .otherwise(0)
    )
