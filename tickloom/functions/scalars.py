"""Scalar functions on amounts, prices and asset identity (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..constants import NATIVE_DECIMALS, NATIVE_MINT


def _dbl(c: Column) -> Column:
    return c.cast("double")


def pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), _dbl(n))


def unix_auto(ts: Column) -> Column:
    """Seconds (double) from an epoch number in ns, us, ms or s, told apart by magnitude."""
    size, value = F.abs(ts), _dbl(ts)
    return (
        F.when(size >= 10**18, value / 1e9)
        .when(size >= 10**15, value / 1e6)
        .when(size >= 10**12, value / 1e3)
        .otherwise(value)
    )


def quote_decimals_of(trade_quote: Column, meta_quote: Column, meta_decimals: Column) -> Column:
    """Metadata decimals where the quote matches, else 9 for the native mint, else metadata."""
    return (
        F.when(meta_quote.isNotNull() & (trade_quote == meta_quote), meta_decimals)
        .when(trade_quote == NATIVE_MINT, F.lit(NATIVE_DECIMALS))
        .otherwise(meta_decimals)
    )


def quote_decimals_native_first(trade_quote: Column, meta_decimals: Column) -> Column:
    """As above with the native mint deciding first."""
    return F.when(trade_quote == NATIVE_MINT, F.lit(NATIVE_DECIMALS)).otherwise(meta_decimals)


def scale_amount(raw: Column, decimals: Column) -> Column:
    return F.when(decimals.isNull(), _dbl(raw)).otherwise(_dbl(raw) / pow10(decimals))


def raw_price(quote_raw: Column, token_raw: Column) -> Column:
    return F.try_divide(_dbl(quote_raw), _dbl(token_raw))


def trade_price(quote_raw: Column, token_raw: Column, token_dec: Column, quote_dec: Column) -> Column:
    scaled = F.try_divide(scale_amount(quote_raw, quote_dec), scale_amount(token_raw, token_dec))
    return F.when(token_dec.isNotNull() & quote_dec.isNotNull(), scaled).otherwise(
        raw_price(quote_raw, token_raw)
    )


def normalize_price(raw: Column, token_dec: Column, quote_dec: Column) -> Column:
    known = token_dec.isNotNull() & quote_dec.isNotNull()
    return F.when(known, raw * pow10(token_dec - quote_dec)).otherwise(raw)


def exact_price(token_raw: Column, quote_raw: Column, token_dec: Column, quote_dec: Column) -> Column:
    """Price from decimal strings; one division, so within an ulp of the rational value.

    Missing, malformed or zero amounts give null; missing or negative decimals mean 0.
    """

    def whole(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.rlike("^[+-]?[0-9]+$"), _dbl(text.try_cast("decimal(38,0)")))

    shift = F.greatest(F.coalesce(token_dec, F.lit(0)), F.lit(0)) - F.greatest(
        F.coalesce(quote_dec, F.lit(0)), F.lit(0)
    )
    zero = F.lit(0)
    return F.try_divide(
        whole(quote_raw) * pow10(F.greatest(shift, zero)),
        whole(token_raw) * pow10(F.greatest(-shift, zero)),
    )


def format_amount(raw: Column, decimals: Column) -> Column:
    """Place the decimal point in an integer string and drop trailing zeros."""
    text = raw.cast("string")
    digits = F.regexp_replace(text, r"^[+-]?0*(?=[0-9])", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), "0")
    point = F.length(padded) - decimals
    plain = F.regexp_replace(
        F.concat(padded.substr(F.lit(1), point), F.lit("."), padded.substr(point + 1, decimals)),
        r"\.?0+$",
        "",
    )
    signed = F.when(text.startswith("-") & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
    unchanged = decimals.isNull() | (decimals <= 0) | ~text.rlike("^[+-]?[0-9]+$")
    return F.when(unchanged, text).otherwise(signed)


def pct_change(latest: Column, previous: Column) -> Column:
    return F.try_divide(latest - previous, previous) * 100


def anchor_from_pct(latest: Column, pct: Column) -> Column:
    divisor = 1 + pct / 100
    usable = (latest > 0) & pct.isNotNull() & (divisor > 0)
    return F.when(usable, F.try_divide(latest, divisor)).otherwise(latest)


def empty_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def _native_pair(base: Column, quote: Column) -> Column:
    return F.when((base == NATIVE_MINT) & (quote != ""), quote).when(
        (quote == NATIVE_MINT) & (base != ""), base
    )


def tracked_asset(ref: Column, base: Column, quote: Column) -> Column:
    """The reference if set, else the side opposite the native mint, else ''."""
    return F.coalesce(empty_to_null(ref), _native_pair(base, quote), F.lit(""))


def topic_asset(ref: Column, payload: Column, base: Column, quote: Column) -> Column:
    """As ``tracked_asset``, but a pair without the native mint falls back to base, then quote."""
    return F.coalesce(
        empty_to_null(ref),
        empty_to_null(payload),
        _native_pair(base, quote),
        empty_to_null(base),
        quote,
        F.lit(""),
    )


def strict_other_side(base: Column, quote: Column) -> Column:
    """The non-native side, only where exactly one side is native."""
    base_native, quote_native = base == NATIVE_MINT, quote == NATIVE_MINT
    return F.when(base_native & ~quote_native, quote).when(~base_native & quote_native, base)


def other_side(asset: Column, base: Column, quote: Column) -> Column:
    return F.when(asset == base, quote).when(asset == quote, base)


def orient_pair(asset: Column, base: Column, quote: Column, base_amt: Column, quote_amt: Column) -> Column:
    """(token, quote, counter mint) of a base/quote pair seen from the asset."""
    flip = F.coalesce(asset == quote, F.lit(False))
    return F.struct(
        F.when(flip, quote_amt).otherwise(base_amt).alias("token_amount_raw"),
        F.when(flip, base_amt).otherwise(quote_amt).alias("quote_amount_raw"),
        other_side(asset, base, quote).alias("counter_mint"),
    )


def orient_swap(
    asset: Column,
    side: Column,
    base: Column,
    quote: Column,
    base_in: Column,
    base_out: Column,
    quote_in: Column,
    quote_out: Column,
) -> Column:
    """Swap seen from the asset: struct(side, token_amount_raw, quote_amount_raw, counter_mint, error).

    Where the asset is the quote side, buy and sell change places along with the amounts.
    """
    flip = F.coalesce(asset == quote, F.lit(False))
    selling, buying = side == "sell", side.isin("buy", "buy_exact_quote_in")
    base_amt = empty_to_null(F.when(selling, base_in).when(buying, base_out))
    quote_amt = empty_to_null(F.when(selling, quote_out).when(buying, quote_in))
    error = (
        F.when(F.coalesce(asset, F.lit("")) == "", "asset missing")
        .when(~F.coalesce(selling | buying, F.lit(False)), "unsupported side")
        .when(base_amt.isNull(), F.when(selling, "missing base_amount_in").otherwise("missing base_amount_out"))
        .when(quote_amt.isNull(), F.when(selling, "missing quote_amount_out").otherwise("missing quote_amount_in"))
    )
    return F.struct(
        F.when(selling, F.when(flip, "buy").otherwise("sell"))
        .when(buying, F.when(flip, "sell").otherwise("buy"))
        .alias("side"),
        F.when(flip, quote_amt).otherwise(base_amt).alias("token_amount_raw"),
        F.when(flip, base_amt).otherwise(quote_amt).alias("quote_amount_raw"),
        F.when(flip, base).otherwise(quote).alias("counter_mint"),
        error.alias("error"),
    )


SQL_FUNCTIONS = [
    f"""quote_decimals_of(trade_quote STRING, meta_quote STRING, meta_decimals INT) RETURNS INT
    RETURN CASE WHEN meta_quote IS NOT NULL AND trade_quote = meta_quote THEN meta_decimals
                WHEN trade_quote = '{NATIVE_MINT}' THEN {NATIVE_DECIMALS}
                ELSE meta_decimals END""",
    """scale_amount(raw DOUBLE, decimals INT) RETURNS DOUBLE
    RETURN CASE WHEN decimals IS NULL THEN raw ELSE raw / pow(10D, decimals) END""",
    """raw_price(quote_raw DOUBLE, token_raw DOUBLE) RETURNS DOUBLE
    RETURN try_divide(quote_raw, token_raw)""",
    """trade_price(quote_raw DOUBLE, token_raw DOUBLE, token_dec INT, quote_dec INT) RETURNS DOUBLE
    RETURN CASE WHEN token_dec IS NOT NULL AND quote_dec IS NOT NULL
                THEN try_divide(quote_raw / pow(10D, quote_dec), token_raw / pow(10D, token_dec))
                ELSE try_divide(quote_raw, token_raw) END""",
    """normalize_price(raw DOUBLE, token_dec INT, quote_dec INT) RETURNS DOUBLE
    RETURN CASE WHEN token_dec IS NULL OR quote_dec IS NULL THEN raw
                ELSE raw * pow(10D, token_dec - quote_dec) END""",
]


def register(spark: SparkSession) -> None:
    """Make the five amount functions callable from SQL in this session."""
    for body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
