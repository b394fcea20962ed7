"""Checked queries: candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as C
from . import bindings as B
from .registry import query
from .sqlparts import normalized, quote_dec, scaled

RAW = "CAST(quote_amount_raw AS DOUBLE) / token_amount_raw"


def _bars(source: str, size: int, extra_key: str = "", where: str = "TRUE") -> str:
    return f"""
    SELECT asset_id{extra_key}, event_unix_ts - event_unix_ts % {size} AS bucket,
      arg_min({RAW}, insert_seq) AS open_raw_price, max({RAW}) AS high_raw_price,
      min({RAW}) AS low_raw_price, arg_max({RAW}, insert_seq) AS close_raw_price,
      min(quote_mint) AS quote_mint_sample, CAST(sum(quote_amount_raw) AS BIGINT) AS volume_quote_raw
    FROM {source} WHERE token_amount_raw <> 0 AND ({where}) GROUP BY ALL
    """


@query("daily_ohlcv", _bars("li_trades", 86400), ["li_trades"])
def daily_ohlcv(spark, sf):
    return C.candles(B.li_trades(spark, sf), 86400)


@query("candles_1m", _bars("ev_trades", 60), ["ev_trades"])
def candles_1m(spark, sf):
    return C.candles_1m(B.ev_trades(spark, sf))


@query("candles_by_quote", _bars("ev_trades", 3600, ", quote_mint"), ["ev_trades"])
def candles_by_quote(spark, sf):
    return C.candles(B.ev_trades(spark, sf), 3600, by_quote=True)


def _rollup(name: str):
    size = C.RESOLUTIONS[name]

    @query(f"rollup_candles_{name}", _bars("ev_trades", size), ["ev_trades"])
    def run(spark, sf):
        return C.candle_hierarchy(B.ev_trades(spark, sf))[name]


for _name in C.ROLLUP_FROM:
    _rollup(_name)

DISPLAY = f"""
, shown AS (
  SELECT b.asset_id, b.bucket AS time,
    {normalized('open_raw_price', 'm.decimals', quote_dec('quote_mint_sample'))} AS open,
    {normalized('high_raw_price', 'm.decimals', quote_dec('quote_mint_sample'))} AS high,
    {normalized('low_raw_price', 'm.decimals', quote_dec('quote_mint_sample'))} AS low,
    {normalized('close_raw_price', 'm.decimals', quote_dec('quote_mint_sample'))} AS close,
    {scaled('volume_quote_raw', quote_dec('quote_mint_sample'))} AS volume, FALSE AS is_gapfill
  FROM bars b LEFT JOIN ev_meta m USING (asset_id))
"""
HOURLY = ", bars AS (" + _bars("ev_trades", 3600) + ")"


@query(
    "list_candles",
    HOURLY + DISPLAY + """SELECT * FROM (SELECT * FROM shown WHERE asset_id = 'A07'
      AND time < (SELECT now_ts FROM now) - 86400 ORDER BY time DESC LIMIT 50) ORDER BY time""",
    ["ev_trades", "ev_meta", "now"],
)
def list_candles(spark, sf):
    bars = C.candles(B.ev_trades(spark, sf), 3600)
    return C.list_candles(bars, B.ev_meta(spark, sf), "A07", B.latest_time(spark, sf) - 86400, 50)


@query(
    "candles_any",
    """
    , ticks AS (SELECT asset_id, event_time, event_id, event_unix_ts - event_unix_ts % 2700 AS bucket,
        CAST(quote_amount_raw AS DOUBLE) / nullif(token_amount_raw, 0) AS price, quote_amount_raw FROM ev_trades),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id, bucket ORDER BY event_time, event_id) AS a,
        row_number() OVER (PARTITION BY asset_id, bucket ORDER BY event_time DESC, event_id DESC) AS z FROM ticks)
    SELECT asset_id, bucket, max(price) FILTER (a = 1) AS open, max(price) AS high, min(price) AS low,
      max(price) FILTER (z = 1) AS close, CAST(sum(quote_amount_raw) AS DOUBLE) AS volume
    FROM ranked GROUP BY ALL
    """,
    ["ev_trades"],
)
def candles_any(spark, sf):
    ticks = B.ev_trades(spark, sf).select(
        "asset_id", "event_time", "event_id", "event_unix_ts",
        C.raw_price(F.col("quote_amount_raw"), F.col("token_amount_raw")).alias("price"),
        F.col("quote_amount_raw").cast("double").alias("quote_amount"),
    )
    return C.candles_any(ticks, 2700)


@query("realtime_union", _bars("ev_trades", 300), ["ev_trades"])
def realtime_union(spark, sf):
    trades = B.ev_trades(spark, sf)
    cut = B.latest_time(spark, sf) - 10 * 86400
    stored = C.candles(trades.where(F.col("event_unix_ts") < cut), 300)
    return C.realtime_union(stored, trades, cut, 300)


@query(
    "refresh_candles",
    # a bar computed without the late trades stays as it was unless it is closed and inside the span
    f"""
    , old AS ({_bars('ev_trades', 3600, '', "event_time::DATE <> DATE '2024-01-15' OR insert_seq % 10 <> 0")}),
    dirty AS (SELECT DISTINCT asset_id, event_unix_ts - event_unix_ts % 3600 AS bucket FROM ev_trades, now
      WHERE event_time::DATE = DATE '2024-01-15' AND insert_seq % 10 = 0
        AND event_unix_ts - event_unix_ts % 3600 >= now_ts - 20 * 86400
        AND event_unix_ts - event_unix_ts % 3600 + 3600 <= now_ts - 3600),
    fresh AS ({_bars('ev_trades', 3600)})
    SELECT * FROM old ANTI JOIN dirty USING (asset_id, bucket)
    UNION ALL BY NAME SELECT * FROM fresh SEMI JOIN dirty USING (asset_id, bucket)
    """,
    ["ev_trades", "now"],
)
def refresh_candles(spark, sf):
    trades = B.ev_trades(spark, sf)
    late = (F.to_date("event_time") == "2024-01-15") & (F.col("insert_seq") % 10 == 0)
    stored = C.candles(trades.where(~late), 3600)
    now = B.latest_time(spark, sf)
    return C.refresh_candles(stored, trades, trades.where(late), now, 3600, lookback=20 * 86400)


@query(
    "continuous_candles",
    HOURLY + DISPLAY + """
    , prior AS (SELECT *, lag(close) OVER (PARTITION BY asset_id ORDER BY time) AS before FROM shown)
    SELECT asset_id, time, coalesce(before, open) AS open,
      CASE WHEN before IS NULL THEN high ELSE greatest(before, high) END AS high,
      CASE WHEN before IS NULL THEN low ELSE least(before, low) END AS low, close, volume FROM prior
    """,
    ["ev_trades", "ev_meta"],
)
def continuous_candles(spark, sf):
    bars = C.candles(B.ev_trades(spark, sf), 3600)
    return C.continuous_candles(C.display_candles(bars, B.ev_meta(spark, sf)))


@query(
    "merge_pages",
    HOURLY + DISPLAY + """
    SELECT asset_id, time, open, close, CASE WHEN time >= (SELECT now_ts FROM now) - 8 * 86400 THEN volume + 1 ELSE volume END AS volume
    FROM shown
    """,
    ["ev_trades", "ev_meta", "now"],
)
def merge_pages(spark, sf):
    bars = C.display_candles(C.candles(B.ev_trades(spark, sf), 3600), B.ev_meta(spark, sf))
    now = B.latest_time(spark, sf)
    page = bars.select("asset_id", "time", "open", "close", "volume")
    older = page.where(F.col("time") < now - 4 * 86400)
    newer = page.where(F.col("time") >= now - 8 * 86400).withColumn("volume", F.col("volume") + 1)
    return C.merge_pages(older, newer)


@query(
    "stage_markers",
    """
    SELECT event_id, l.asset_id, event_unix_ts - event_unix_ts % 14400 AS time,
      CASE WHEN token_amount_raw > 0 THEN (CAST(quote_amount_raw AS DOUBLE) / 1e9)
        / (CAST(token_amount_raw AS DOUBLE) / pow(10.0, coalesce(m.decimals, 6))) END AS price
    FROM chain_log l LEFT JOIN ev_meta m USING (asset_id) WHERE event_type = 'migrate'
    """,
    ["chain_log", "ev_meta"],
)
def stage_markers(spark, sf):
    log = B.chain_log(spark, sf)
    return C.stage_markers(log.unionByName(log), 14400, B.ev_meta(spark, sf))


@query(
    "candle_change",
    HOURLY + DISPLAY + """
    SELECT asset_id, time, close - open AS change,
      CASE WHEN open = 0 THEN 0.0::DOUBLE ELSE (close - open) / open * 100 END AS percent, close >= open AS is_up FROM shown
    """,
    ["ev_trades", "ev_meta"],
)
def candle_change(spark, sf):
    bars = C.candles(B.ev_trades(spark, sf), 3600)
    return C.candle_change(C.display_candles(bars, B.ev_meta(spark, sf)))
