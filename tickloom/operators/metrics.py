"""Rolling trade metrics per asset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LONG_WINDOWS, SHORT_SPAN, SHORT_WINDOWS, STATE_TTL, WINDOWS
from ..functions.display import bucket_start
from ..functions.scalars import (
    normalize_price,
    pct_change,
    quote_decimals_of,
    raw_price,
    scale_amount,
    trade_price,
)
from .common import display_key, requested, requested_left, shuffled, spread_join

COUNTS = ["txns", "buys", "sells"]
VOLUMES = ["volume", "buy_volume", "sell_volume"]
SUMMARY_PROBES = {"5m": 300, "1h": 3600, "4h": 14400, "24h": 86400}
DAY = 86400


def _meta(meta: DataFrame) -> DataFrame:
    return shuffled(
        meta.select(
            "asset_id",
            F.col("decimals").alias("_td"),
            F.col("quote_mint").alias("_mq"),
            F.col("quote_decimals").alias("_mqd"),
        )
    )


def _quote_dec(quote: str = "quote_mint") -> Column:
    return quote_decimals_of(F.col(quote), F.col("_mq"), F.col("_mqd"))


def _price(quote_raw: str, token_raw: str, quote: str) -> Column:
    return trade_price(F.col(quote_raw), F.col(token_raw), F.col("_td"), _quote_dec(quote))


# --- per minute ---------------------------------------------------------------------


def metrics_1m(trades: DataFrame, by_quote: bool = False) -> DataFrame:
    """Counts and raw volumes per asset and minute; only 'buy' and 'sell' exactly are counted apart.

    ``by_quote`` keeps the quote currencies of a minute apart, with the position of each one's first trade.
    """
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    quote = F.col("quote_amount_raw")
    keys = ["quote_mint"] if by_quote else []

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(30,0)")

    return (
        trades.where("token_amount_raw <> 0")
        .select(
            "asset_id",
            "insert_seq",
            "quote_mint",
            "side",
            "quote_amount_raw",
            bucket_start(F.col("event_unix_ts"), 60).alias("bucket"),
            raw_price(F.col("quote_amount_raw"), F.col("token_amount_raw")).alias("price"),
        )
        .groupBy("asset_id", "bucket", *keys)
        .agg(
            *(F.min("insert_seq").alias("open_seq") for _ in keys),
            F.min_by("price", "insert_seq").alias("open_raw_price"),
            F.max_by("price", "insert_seq").alias("close_raw_price"),
            F.min("quote_mint").alias("quote_mint_sample"),
            F.count("*").alias("txns"),
            F.count_if(buy).alias("buys"),
            F.count_if(sell).alias("sells"),
            total(quote).alias("volume_quote_raw"),
            total(F.when(buy, quote)).alias("buy_volume_quote_raw"),
            total(F.when(sell, quote)).alias("sell_volume_quote_raw"),
        )
        .drop(*keys)
    )


def long_windows(
    minutes: DataFrame,
    meta: DataFrame,
    assets: DataFrame,
    now: int,
    windows: Mapping[str, int] = LONG_WINDOWS,
    until: int | None = None,
) -> DataFrame:
    """Windows ending ``SHORT_SPAN`` ago, from minute rows; one row per asked asset.

    ``until`` replaces the end (exclusive, a minute start) where the short part begins
    on a minute boundary. Minutes kept apart by quote currency open with the first trade of them all.
    """
    end = now - SHORT_SPAN if until is None else until
    scoped = minutes.where((F.col("bucket") >= now - max(windows.values())) & (F.col("bucket") < end))
    dec = _quote_dec("quote_mint_sample")
    at = F.struct("bucket", *(c for c in minutes.columns if c == "open_seq"))
    scaled = (
        requested(scoped, assets)
        .join(_meta(meta), "asset_id", "left")
        .select(
            "asset_id",
            "bucket",
            at.alias("at"),
            *COUNTS,
            normalize_price(F.col("open_raw_price"), F.col("_td"), dec).alias("open_price"),
            scale_amount(F.col("volume_quote_raw"), dec).alias("volume"),
            scale_amount(F.col("buy_volume_quote_raw"), dec).alias("buy_volume"),
            scale_amount(F.col("sell_volume_quote_raw"), dec).alias("sell_volume"),
        )
    )
    aggs, filled = [], []
    for name, span in windows.items():
        inside = F.col("bucket") >= now - span
        aggs.append(F.min_by(F.when(inside, F.col("open_price")), F.when(inside, F.col("at"))).alias(f"anchor_price_{name}"))
        for c in COUNTS + VOLUMES:
            aggs.append(F.sum(F.when(inside, F.col(c))).alias(f"{c}_{name}"))
            filled.append(f"{c}_{name}")
    return requested_left(assets, scaled.groupBy("asset_id").agg(*aggs), zero=filled)


# --- per second ---------------------------------------------------------------------


def priced_points(trades: DataFrame, meta: DataFrame) -> DataFrame:
    """Trades as points: price and volume scaled by the asset's decimals."""
    return spread_join(trades, _meta(meta), ["asset_id"], "left").select(
        "asset_id",
        "event_time",
        "event_unix_ts",
        "slot",
        "insert_seq",
        "side",
        _price("quote_amount_raw", "token_amount_raw", "quote_mint").alias("price"),
        scale_amount(F.col("quote_amount_raw"), _quote_dec()).alias("volume"),
    )


def side_flags(side: Column, mode: str) -> tuple[Column, Column]:
    """(is buy, is sell). The third side value counts as neither, as sell or as buy."""
    if mode == "strict":
        return side == "buy", side == "sell"
    if mode == "reference_live":
        return side == "buy", side != "buy"
    if mode == "normalized":
        buy = side.startswith("buy")
        return buy, ~buy
    raise ValueError(f"unknown side mode {mode!r}")


def second_buckets(points: DataFrame, side_mode: str = "reference_live") -> DataFrame:
    """Points pre-aggregated to one row per asset and second."""
    buy, sell = side_flags(F.col("side"), side_mode)
    price, seq = F.col("price"), F.col("insert_seq")
    first_real = F.min_by(F.when(price != 0, price), F.when(price != 0, seq))
    return points.groupBy("asset_id", F.col("event_unix_ts").alias("second")).agg(
        F.coalesce(first_real, F.lit(0.0)).alias("open_price"),
        F.max_by(price, seq).alias("close_price"),
        F.count_if(buy).alias("buys"),
        F.count_if(sell).alias("sells"),
        F.sum("volume").alias("volume"),
        F.coalesce(F.sum(F.when(buy, F.col("volume"))), F.lit(0.0)).alias("buy_volume"),
        F.coalesce(F.sum(F.when(sell, F.col("volume"))), F.lit(0.0)).alias("sell_volume"),
    )


def windows_of_seconds(seconds: DataFrame, now: int, windows: Mapping[str, int]) -> DataFrame:
    """Window totals from second rows in (now - w, now]; seconds closing at price 0 are skipped."""
    live = seconds.where(
        (F.col("second") > now - max(windows.values())) & (F.col("second") <= now) & (F.col("close_price") != 0)
    )
    aggs = []
    for name, span in windows.items():
        inside = F.col("second") > now - span
        aggs.append(F.min_by(F.when(inside, F.col("open_price")), F.when(inside, F.col("second"))).alias(f"anchor_price_{name}"))
        aggs.append(F.sum(F.when(inside, F.col("buys") + F.col("sells")).otherwise(0)).alias(f"txns_{name}"))
        for c in ("buys", "sells"):
            aggs.append(F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"{c}_{name}"))
        for c in VOLUMES:
            aggs.append(F.sum(F.when(inside, F.col(c)).otherwise(0.0)).alias(f"{c}_{name}"))
    return live.groupBy("asset_id").agg(*aggs)


def short_windows(
    points: DataFrame,
    now: int,
    windows: Mapping[str, int] = SHORT_WINDOWS,
    side_mode: str = "reference_live",
) -> DataFrame:
    """The newest windows, from second buckets; points without a price are left out."""
    recent = points.where(
        (F.col("event_unix_ts") > now - max(windows.values()))
        & (F.col("event_unix_ts") <= now)
        & F.col("price").isNotNull()
    )
    return windows_of_seconds(second_buckets(recent, side_mode), now, windows)


def merge_windows(
    long: DataFrame, short: DataFrame, windows: Sequence[str] = tuple(LONG_WINDOWS), tail: str = "5m"
) -> DataFrame:
    """Long windows plus the short tail: counters add up, the long anchor wins."""
    joined = long.join(shuffled(short), "asset_id", "left")
    out = ["asset_id"]
    for name in windows:
        out.append(F.coalesce(f"anchor_price_{name}", f"anchor_price_{tail}").alias(f"anchor_price_{name}"))
        for c in ("buys", "sells", *VOLUMES):
            part = F.coalesce(F.col(f"{c}_{tail}"), F.lit(0))
            out.append((F.col(f"{c}_{name}") + part).alias(f"{c}_{name}"))
    return joined.select(*out)


def current_metrics(
    trades: DataFrame,
    meta: DataFrame,
    now: int,
    assets: DataFrame | None = None,
    side_mode: str = "reference_live",
    exact: bool = False,
    minutes: DataFrame | None = None,
    long: Mapping[str, int] = LONG_WINDOWS,
) -> DataFrame:
    """One wide row per asset that has a price: latest trade, anchors, counts and volumes.

    By default the minute that straddles the short window counts in both parts, as the
    live path does; ``exact`` cuts both at that minute's start and scales each quote currency of a
    minute by its own decimals. ``minutes`` takes stored minute rows instead of computing them.
    """
    real = trades.where("token_amount_raw <> 0")
    latest = latest_trade(real, meta, assets).where("latest_price > 0")
    asked = latest.select("asset_id")
    edge = (now - SHORT_SPAN) - (now - SHORT_SPAN) % 60
    short_spans = dict(SHORT_WINDOWS)
    tail = "5m"
    if exact:
        tail, short_spans["tail"] = "tail", now - edge + 1
    span = max(short_spans.values())
    recent = requested(real, assets).where(
        (F.col("event_unix_ts") > now - span) & (F.col("event_unix_ts") <= now)
    )
    short = short_windows(priced_points(recent, meta), now, short_spans, side_mode)
    rows = minutes
    if rows is None:
        day = real.where((F.col("event_unix_ts") >= now - max(long.values())) & (F.col("event_unix_ts") < now))
        rows = metrics_1m(day, by_quote=exact)
    parts = long_windows(rows, meta, asked, now, long, until=edge if exact else None)
    merged = merge_windows(parts, short, tuple(long), tail)
    zero = F.lit(0)

    def col(c: str, name: str) -> Column:
        return F.coalesce(F.col(f"{c}_{name}"), zero).alias(f"{c}_{name}")

    names = [*SHORT_WINDOWS, *long]
    return (
        latest.join(shuffled(short), "asset_id", "left")
        .join(shuffled(merged), "asset_id", "left")
        .select(
            "asset_id",
            "latest_price",
            F.col("latest_event_unix_ts").alias("latest_trade_at"),
            *(F.col(f"anchor_price_{n}") for n in names),
            *((F.coalesce(f"buys_{n}", zero) + F.coalesce(f"sells_{n}", zero)).alias(f"txns_{n}") for n in names),
            *(col(c, n) for c in ("buys", "sells", *VOLUMES) for n in names),
        )
    )


# --- relative to the asset's own last trade -----------------------------------------


def latest_trade(
    trades: DataFrame, meta: DataFrame, assets: DataFrame | Sequence[str] | None = None
) -> DataFrame:
    """Newest trade per asset in display order, with its price."""
    cols = ["event_id", "event_unix_ts", "side", "user_address", "market_id", "quote_mint", "token_amount_raw", "quote_amount_raw"]
    newest = requested(trades, assets).groupBy("asset_id").agg(F.max_by(F.struct(*cols), display_key()).alias("t"))
    return (
        newest.select("asset_id", "t.*")
        .join(_meta(meta), "asset_id", "left")
        .select(
            "asset_id",
            "event_id",
            F.col("event_unix_ts").alias("latest_event_unix_ts"),
            "side",
            "user_address",
            "market_id",
            "quote_mint",
            _price("quote_amount_raw", "token_amount_raw", "quote_mint").alias("latest_price"),
        )
    )


def _with_last(trades: DataFrame) -> DataFrame:
    """Trades with the time of their asset's newest one."""
    last = trades.groupBy("asset_id").agg(F.max("event_time").alias("last_time"))
    return spread_join(trades, last, ["asset_id"])


def _ago(seconds: int) -> Column:
    return F.col("last_time") - F.make_dt_interval(secs=F.lit(seconds))


def stats_24h(trades: DataFrame, meta: DataFrame, span: int = DAY) -> DataFrame:
    """Counts, volumes and distinct traders in the day before each asset's last trade.

    Rows are first reduced to one per (asset, trader, quote), which spreads a hot asset
    over its traders; distinct counts are then plain counts.
    """
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    quote = F.col("quote_amount_raw")
    inside = _with_last(trades).where(F.col("event_time") > _ago(span))
    per_trader = inside.groupBy("asset_id", "user_address", "quote_mint").agg(
        F.count("*").alias("txns"),
        F.count_if(buy).alias("buys"),
        F.count_if(sell).alias("sells"),
        F.sum(quote).alias("volume"),
        F.sum(F.when(buy, quote)).alias("buy_volume"),
        F.sum(F.when(sell, quote)).alias("sell_volume"),
    )
    dec = _quote_dec()
    traders = per_trader.join(_meta(meta), "asset_id", "left").groupBy("asset_id", "user_address").agg(
        *(F.sum(c).alias(c) for c in COUNTS),
        *(F.sum(scale_amount(F.col(c), dec)).alias(c) for c in VOLUMES),
    )
    return traders.groupBy("asset_id").agg(
        *(F.sum(c).alias(f"{c}_24h") for c in COUNTS),
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_24h") for c in VOLUMES),
        F.count("*").alias("makers_24h"),
        F.count_if(F.col("buys") > 0).alias("buyers_24h"),
        F.count_if(F.col("sells") > 0).alias("sellers_24h"),
    )


def price_anchors(trades: DataFrame, meta: DataFrame, probes: Mapping[str, int] = SUMMARY_PROBES) -> DataFrame:
    """Per asset: last price, and the price a while before it.

    The anchor is the newest trade at or before the probe; where that has no price, the
    oldest one at or after it. One conditional aggregate covers all probes.
    """
    amounts = F.struct("quote_amount_raw", "token_amount_raw", "quote_mint")
    key = display_key()
    aggs = [F.max_by(F.struct("event_unix_ts", "quote_amount_raw", "token_amount_raw", "quote_mint"), key).alias("last")]
    for name, span in probes.items():
        before, after = F.col("event_time") <= _ago(span), F.col("event_time") >= _ago(span)
        aggs.append(F.max_by(F.when(before, amounts), F.when(before, key)).alias(f"b_{name}"))
        aggs.append(F.min_by(F.when(after, amounts), F.when(after, key)).alias(f"a_{name}"))
    ends = _with_last(trades).groupBy("asset_id").agg(*aggs).join(_meta(meta), "asset_id", "left")

    def price(c: str) -> Column:
        return _price(f"{c}.quote_amount_raw", f"{c}.token_amount_raw", f"{c}.quote_mint")

    return ends.select(
        "asset_id",
        F.col("last.quote_mint").alias("quote_mint"),
        price("last").alias("latest_price"),
        F.col("last.event_unix_ts").alias("latest_event_unix_ts"),
        *(F.coalesce(price(f"b_{n}"), price(f"a_{n}")).alias(f"price_{n}_ago") for n in probes),
    )


def trade_summary(trades: DataFrame, meta: DataFrame, probes: Mapping[str, int] = SUMMARY_PROBES) -> DataFrame:
    return price_anchors(trades, meta, probes).join(shuffled(stats_24h(trades, meta)), "asset_id")


def metric_points(trades: DataFrame, meta: DataFrame, span: int = DAY) -> DataFrame:
    """Points of the day before each asset's last trade, and the one newest point before that day."""
    timed = _with_last(trades)
    inside = timed.where(F.col("event_time") > _ago(span)).drop("last_time")
    older = timed.where(F.col("event_time") <= _ago(span)).drop("last_time")
    anchor = (
        older.groupBy("asset_id").agg(F.max_by(F.struct(*(c for c in older.columns if c != "asset_id")), display_key()).alias("t"))
    ).select("asset_id", "t.*")
    return priced_points(inside.unionByName(anchor), meta).orderBy("event_unix_ts", "slot", "insert_seq")


def recent_points(trades: DataFrame, meta: DataFrame, since: int) -> DataFrame:
    recent = trades.where(F.col("event_unix_ts") >= since)
    return priced_points(recent, meta).orderBy("event_unix_ts", "slot", "insert_seq")


def stats_from_points(
    points: DataFrame,
    now: int,
    short: Mapping[str, int] = SHORT_WINDOWS,
    long: Mapping[str, int] = LONG_WINDOWS,
    horizon: int = DAY,
) -> DataFrame:
    """The second window algorithm, from points alone.

    Short windows include their cutoff second; their anchor is the newest point before,
    else the oldest inside, else the first price seen. Long windows are whole minutes;
    their anchor is the close of the newest older minute, else the oldest open.
    """
    p = points.where("price IS NOT NULL")
    ts, price, slot, seq = (F.col(c) for c in ("event_unix_ts", "price", "slot", "insert_seq"))
    order = F.struct(ts, slot, seq)
    buy = F.col("side") == "buy"
    edge = now - max(short.values())
    real = price != 0

    def at(pick, cond: Column, key: Column) -> Column:
        return pick(F.when(cond, price), F.when(cond, key))

    aggs = [
        F.max_by(price, order).alias("p"),
        F.max(ts).alias("t"),
        F.min_by(F.when(real, price), F.when(real, order)).alias("_first"),
        at(F.max_by, ts < edge, order).alias("_older"),
    ]
    for name, span in short.items():
        cut = now - span
        inside = ts >= cut
        # among points of the same second the first one seen stands for it
        near = at(F.max_by, (ts >= edge) & (ts < cut), F.struct(ts, -slot, -seq))
        aggs += [
            near.alias(f"_near_{name}"),
            at(F.min_by, inside, order).alias(f"_in_{name}"),
            F.count_if(inside & buy).alias(f"buys_{name}"),
            F.count_if(inside & ~buy).alias(f"sells_{name}"),
        ]
        for c, cond in (("volume", inside), ("buy_volume", inside & buy), ("sell_volume", inside & ~buy)):
            aggs.append(F.sum(F.when(cond, F.col("volume")).otherwise(0.0)).alias(f"{c}_{name}"))
    head = p.groupBy("asset_id").agg(*aggs)

    minute = bucket_start(ts, 60)
    minutes = p.groupBy("asset_id", minute.alias("minute")).agg(
        F.coalesce(F.min_by(F.when(real, price), F.when(real, order)), F.lit(0.0)).alias("open"),
        F.max_by(price, order).alias("close"),
        F.count_if(buy).alias("buys"),
        F.count_if(~buy).alias("sells"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(buy, F.col("volume")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(~buy, F.col("volume")).otherwise(0.0)).alias("sell_volume"),
    )
    current = now - now % 60
    m = F.col("minute")
    live = minutes.where((m > current - horizon) & (m <= current) & (F.col("close") != 0))
    aggs = []
    for name, span in long.items():
        inside = m > current - span
        older = ~inside & (F.col("close") > 0)
        aggs.append(F.max_by(F.when(older, F.col("close")), F.when(older, m)).alias(f"_was_{name}"))
        aggs.append(F.min_by(F.when(inside, F.col("open")), F.when(inside, m)).alias(f"_open_{name}"))
        for c in ("buys", "sells"):
            aggs.append(F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"{c}_{name}"))
        for c in VOLUMES:
            aggs.append(F.sum(F.when(inside, F.col(c)).otherwise(0.0)).alias(f"{c}_{name}"))
    rolled = live.groupBy("asset_id").agg(*aggs)

    fallback = F.coalesce(F.when(F.col("_first") > 0, F.col("_first")), F.col("p"))
    out = ["asset_id", "p", "t"]
    for name in short:
        anchor = F.coalesce(f"_near_{name}", "_older", f"_in_{name}", fallback)
        out.append(anchor.alias(f"anchor_price_{name}"))
        out += [F.col(f"{c}_{name}") for c in ("buys", "sells", *VOLUMES)]
    for name in long:
        out.append(F.coalesce(f"_was_{name}", f"_open_{name}", fallback).alias(f"anchor_price_{name}"))
        out += [F.coalesce(F.col(f"{c}_{name}"), F.lit(0)).alias(f"{c}_{name}") for c in ("buys", "sells", *VOLUMES)]
    return head.where("p > 0").join(shuffled(rolled), "asset_id", "left").select(*out)


# --- shapes of the wide row ---------------------------------------------------------


def stat_payload(metrics: DataFrame, windows: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """The compact payload: 33 short fields and the same as JSON; rows without a price are left out."""
    fields = [F.col("asset_id").alias("mint"), F.col("latest_price").alias("p"), F.col("latest_trade_at").alias("t")]
    for n in windows:
        fields += [
            F.coalesce(F.col(f"anchor_price_{n}"), F.lit(0.0)).alias(f"p{n}"),
            F.col(f"buys_{n}").alias(f"b{n}"),
            F.col(f"sells_{n}").alias(f"s{n}"),
            F.col(f"buy_volume_{n}").alias(f"bv{n}"),
            F.col(f"sell_volume_{n}").alias(f"sv{n}"),
            F.col(f"volume_{n}").alias(f"v{n}"),
        ]
    usable = metrics.where("latest_price IS NOT NULL AND latest_trade_at IS NOT NULL").select(*fields)
    return usable.withColumn("payload", F.to_json(F.struct("*")))


def change_columns() -> list[Column]:
    """Percent changes of a summary's latest price."""
    names = {"5m": "m5", "1h": "h1", "4h": "h4", "24h": "h24"}
    return [pct_change(F.col("latest_price"), F.col(f"price_{n}_ago")).alias(c) for n, c in names.items()]


def price_changes(summary: DataFrame) -> DataFrame:
    return summary.where("latest_price IS NOT NULL").select("asset_id", *change_columns())


def net_flow(metrics: DataFrame, windows: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """One row per asset and window: change, totals, and buy minus sell volume."""

    def row(n: str) -> Column:
        return F.struct(
            F.lit(n).alias("window"),
            F.col(f"anchor_price_{n}").cast("double").alias("anchor"),
            *(F.col(f"{c}_{n}").cast("bigint").alias(c) for c in ("buys", "sells")),
            *(F.col(f"{c}_{n}").cast("double").alias(c) for c in VOLUMES),
        )

    long = metrics.select("asset_id", "latest_price", F.explode(F.array(*(row(n) for n in windows))).alias("w"))
    change = F.when(F.col("latest_price") != 0, pct_change(F.col("latest_price"), F.col("w.anchor")))
    return long.select(
        "asset_id",
        "w.window",
        change.alias("price_change"),
        "w.buys",
        "w.sells",
        "w.volume",
        "w.buy_volume",
        "w.sell_volume",
        (F.col("w.buy_volume") - F.col("w.sell_volume")).alias("net_volume"),
    )


def refresh_targets(states: DataFrame, now: int) -> DataFrame:
    """What a sweep does with each held state: 'evict', 'refresh' or 'keep'."""
    idle = F.lit(now) - F.col("last_active")
    seen = F.col("last_active") > 0
    evict = ~F.col("subscribed") & seen & (idle > STATE_TTL)
    stale = F.col("last_persisted_minute") != now - now % 60
    refresh = F.col("subscribed") | (seen & (idle <= SHORT_SPAN)) | stale
    return states.withColumn("action", F.when(evict, "evict").when(refresh, "refresh").otherwise("keep"))


def missing_metrics(trades: DataFrame, metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Assets that trade but have no metrics row, most recently traded first where there is a limit."""
    seen = trades.groupBy("asset_id").agg(F.max("event_unix_ts").alias("latest_trade_at"))
    missing = seen.join(shuffled(metrics.select("asset_id")), "asset_id", "left_anti")
    return missing if limit is None else missing.orderBy(F.desc("latest_trade_at"), "asset_id").limit(limit)


def backfill_metrics(trades: DataFrame, meta: DataFrame, metrics: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Metrics with rows added for the assets that lacked one, at most ``limit`` of them where there is a limit."""
    todo = missing_metrics(trades, metrics, limit).select("asset_id")
    repaired = current_metrics(requested(trades, todo), meta, now)
    return metrics.unionByName(repaired)
