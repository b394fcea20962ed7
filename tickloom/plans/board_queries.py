"""Checked queries: boards, search, detail and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LIQUIDITY_HEAT, MARKET_CAP_HEAT, NATIVE_MINT as NATIVE, TXN_HEAT, VOLUME_HEAT
from ..operators import board as G
from ..operators import grams as I
from ..operators import metrics as M
from ..operators import project as P
from ..session import scratch
from . import bindings as B
from .log_queries import ACTIVITY, MARKETS, TOKEN_UPDATES, TOKENS
from .metric_queries import CURRENT, LATEST, POINTS, STATS, _anchor_sql, _current
from .registry import query, rounded
from .sqlparts import scaled

NOW = "(SELECT now_ts FROM now)"
col = F.col
MODEL = TOKEN_UPDATES + TOKENS
SNAP = """
, snap AS (SELECT t.* EXCLUDE (creator), m.name, m.symbol, m.uri, m.decimals, m.total_supply_raw, m.quote_mint, m.quote_decimals,
    coalesce(m.creator, t.creator) AS creator FROM tokens t LEFT JOIN ev_meta m USING (asset_id))
"""
SNAP_COLS = ["asset_id", "name", "symbol", "uri", "total_supply_raw", "quote_mint", "creator", "first_seen_at", "current_stage", "migrated_at"]


def _model(spark, sf):
    log = B.chain_log(spark, sf)
    return log, P.project_tokens(log), B.ev_meta(spark, sf), P.project_markets(log)


@query("snapshots", MODEL + SNAP + f"SELECT {', '.join(SNAP_COLS)} FROM snap ORDER BY first_seen_at DESC, asset_id LIMIT 15", ["chain_log", "ev_meta"])
def snapshots(spark, sf):
    _, tokens, meta, _ = _model(spark, sf)
    return G.snapshots(tokens, meta, 15).select(*SNAP_COLS)


@query("snapshot_of_one", MODEL + SNAP + f"SELECT {', '.join(SNAP_COLS)} FROM snap WHERE asset_id = 'A04'", ["chain_log", "ev_meta"])
def snapshot_of_one(spark, sf):
    _, tokens, meta, _ = _model(spark, sf)
    return G.snapshots(tokens, meta, asset="A04").select(*SNAP_COLS)


def _own(dec: str, raw: str) -> str:
    return scaled(raw, dec)


BOARD = MARKETS + SNAP + f"""
, reserve AS (SELECT * FROM chain_log WHERE ref_mint IS NOT NULL AND event_type IN ('trade', 'create', 'swap', 'create_pool')
  QUALIFY row_number() OVER (PARTITION BY ref_mint ORDER BY slot DESC, tx_index DESC, outer_index DESC, inner_index DESC NULLS LAST) = 1),
sides AS (SELECT ref_mint AS asset_id, event_type, log_id AS n, ref_mint = base_mint AS is_base,
    CASE WHEN event_type = 'swap' THEN log_id * 6 ELSE token_amount_raw END AS base_res,
    CASE WHEN event_type = 'swap' THEN log_id * 7 ELSE quote_amount_raw END AS quote_res FROM reserve),
listed AS (SELECT s.*, a.base_mint AS ab, a.base_mint_decimals AS abd, a.quote_mint_decimals AS aqd, c.* EXCLUDE (asset_id),
    greatest(s.first_seen_at, coalesce(s.migrated_at, s.first_seen_at)) AS active_since,
    {scaled('s.total_supply_raw', 's.decimals')} * c.latest_price AS market_cap_quote
  FROM snap s LEFT JOIN markets a ON a.market_id = s.active_market_id LEFT JOIN current c ON c.asset_id = s.asset_id),
deep AS (SELECT l.*, CASE WHEN r.event_type IN ('trade', 'create') THEN
      (CASE WHEN r.event_type = 'trade' AND n % 5 <> 0 THEN n * 2 ELSE n * 3 END)::DOUBLE / pow(10.0, 9)
      + coalesce((CASE WHEN r.event_type = 'trade' AND n % 7 = 0 THEN n * 5 ELSE n * 4 END)::DOUBLE / pow(10.0, coalesce(l.decimals, 6)) * l.latest_price, 0)
    WHEN r.event_type IS NOT NULL THEN
      (CASE WHEN is_base THEN quote_res ELSE base_res END)::DOUBLE / pow(10.0, coalesce(CASE WHEN is_base THEN aqd ELSE abd END, 9))
      + coalesce((CASE WHEN is_base THEN base_res ELSE quote_res END)::DOUBLE / pow(10.0, coalesce(l.decimals, abd, 6)) * l.latest_price, 0)
    END AS liquidity_quote
  FROM listed l LEFT JOIN sides r ON r.asset_id = l.asset_id)
"""
ALL = ["chain_log", "ev_trades", "ev_meta", "now"]


def _board_sql(view: str, w: str, limit: int) -> str:
    order = {"hot": "txns_window DESC, volume_window DESC", "new": "active_since DESC NULLS LAST"}[view]
    return f"""SELECT asset_id, name, current_stage, active_market_id, latest_price, latest_trade_at,
      (latest_price - anchor_price_{w}) / nullif(anchor_price_{w}, 0) * 100 AS price_change,
      coalesce(volume_{w}, 0) AS volume_window, coalesce(txns_{w}, 0) AS txns_window, coalesce(buys_{w}, 0) AS buys_window,
      coalesce(sells_{w}, 0) AS sells_window, active_since, liquidity_quote, market_cap_quote
    FROM deep ORDER BY {order}, first_seen_at DESC, asset_id LIMIT {limit}"""


BOARD_COLS = ["asset_id", "name", "current_stage", "active_market_id", "latest_price", "latest_trade_at", "price_change", "volume_window",
              "txns_window", "buys_window", "sells_window", "active_since", "liquidity_quote", "market_cap_quote"]


def _board(spark, sf, view, w, limit):
    log, tokens, meta, markets = _model(spark, sf)
    return G.board(tokens, meta, markets, _current(spark, sf), log, view, w, limit)


@query("board_hot", CURRENT + MODEL + BOARD + _board_sql("hot", "24h", 20), ALL)
def board_hot(spark, sf):
    return rounded(_board(spark, sf, "hot", "1d", 20).select(*BOARD_COLS), "volume_window")


@query("board_new", CURRENT + MODEL + BOARD + _board_sql("new", "4h", 12), ALL)
def board_new(spark, sf):
    return rounded(_board(spark, sf, "new", "4h", 12).select(*BOARD_COLS), "volume_window")


@query("liquidity", CURRENT + MODEL + BOARD + "SELECT asset_id, liquidity_quote FROM deep WHERE liquidity_quote IS NOT NULL", ALL)
def liquidity(spark, sf):
    return _board(spark, sf, "hot", "24h", None).where("liquidity_quote IS NOT NULL").select("asset_id", "liquidity_quote")


@query(
    "market_cap",
    POINTS + f"SELECT l.asset_id, {scaled('m.total_supply_raw', 'm.decimals')} * l.price AS market_cap FROM ({LATEST}) l LEFT JOIN ev_meta m USING (asset_id)",
    ["ev_trades", "ev_meta"],
)
def market_cap(spark, sf):
    meta = B.ev_meta(spark, sf)
    last = M.latest_trade(B.ev_trades(spark, sf), meta).join(meta.select("asset_id", "decimals", "total_supply_raw"), "asset_id", "left")
    return last.select("asset_id", G.market_cap(col("total_supply_raw"), col("decimals"), col("latest_price")).alias("market_cap"))


def _heat(x, t):
    return f"(CASE WHEN {x} IS NULL OR {x} <= 0 THEN 0 WHEN {x} >= {t[2]} THEN 3 WHEN {x} >= {t[1]} THEN 2 WHEN {x} >= {t[0]} THEN 1 ELSE 0 END)::BIGINT"


@query(
    "board_labels",
    CURRENT + MODEL + BOARD + f"""
    , aged AS (SELECT *, greatest({NOW} + 900 - active_since, 0) AS s FROM deep)
    SELECT asset_id, CASE WHEN current_stage = 'pool' THEN 'PumpSwap' ELSE 'Pumpfun' END AS stage_label,
      (CASE WHEN s <= 600 THEN '🌱 ' WHEN s <= 3600 THEN '⚡ ' ELSE '🕒 ' END) || (CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm'
        WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END) AS age_label,
      {_heat('volume_24h', VOLUME_HEAT)} AS volume_heat, {_heat('txns_24h', TXN_HEAT)} AS txn_heat,
      {_heat('liquidity_quote', LIQUIDITY_HEAT)} AS liquidity_heat, {_heat('market_cap_quote', MARKET_CAP_HEAT)} AS market_cap_heat FROM aged
    """,
    ALL,
)
def board_labels(spark, sf):
    return G.board_labels(_board(spark, sf, "new", "24h", None), B.latest_time(spark, sf) + 900)


def _search_sql(text: str, limit: int) -> str:
    low = text.lower()
    return f"""SELECT asset_id, name, symbol, price AS latest_price, CASE WHEN lower(asset_id) = '{low}' THEN 0 WHEN lower(coalesce(symbol, '')) = '{low}' THEN 1
      WHEN lower(coalesce(name, '')) = '{low}' THEN 2 WHEN lower(asset_id) LIKE '{low}%' THEN 3 WHEN lower(coalesce(symbol, '')) LIKE '{low}%' THEN 4
      WHEN lower(coalesce(name, '')) LIKE '{low}%' THEN 5 ELSE 6 END::BIGINT AS rank
    FROM snap LEFT JOIN (SELECT asset_id, price FROM ({LATEST})) USING (asset_id)
    WHERE asset_id ILIKE '%{text}%' OR coalesce(name, '') ILIKE '%{text}%' OR coalesce(symbol, '') ILIKE '%{text}%'
    ORDER BY rank, first_seen_at DESC, asset_id LIMIT {limit}"""


def _search(name: str, raw: str, limit: int):
    @query(name, POINTS + MODEL + SNAP + _search_sql(raw.strip(), limit), ["chain_log", "ev_trades", "ev_meta"])
    def run(spark, sf):
        _, tokens, meta, _ = _model(spark, sf)
        metrics = M.latest_trade(B.ev_trades(spark, sf), meta).select("asset_id", "latest_price")
        return G.search(tokens, meta, metrics, raw, limit).drop("first_seen_at", "image_uri")


_search("search_name", " Ring ", 20)
_search("search_symbol", "brand#1", 8)
_search("search_id", "a0_", 20)


def _search_indexed(name: str, raw: str, limit: int):
    @query(name, POINTS + MODEL + SNAP + _search_sql(raw.strip(), limit), ["chain_log", "ev_trades", "ev_meta"])
    def run(spark, sf):
        """The index is written sorted by gram; text without three characters in a row goes to the scan."""
        _, tokens, meta, _ = _model(spark, sf)
        metrics = M.latest_trade(B.ev_trades(spark, sf), meta).select("asset_id", "latest_price")
        path = scratch(spark, "grams")
        I.write_index(I.gram_index(tokens, meta), path)
        return I.search_indexed(spark.read.parquet(path), tokens, meta, metrics, raw, limit).drop("first_seen_at", "image_uri")


_search_indexed("search_indexed_name", " Ring ", 20)
_search_indexed("search_indexed_wildcard", "rand%1", 12)
_search_indexed("search_indexed_short", "a1", 20)


@query("markets_of", MODEL + MARKETS + "SELECT * FROM markets WHERE asset_id = 'A06' ORDER BY started_at DESC, market_id LIMIT 10", ["chain_log"])
def markets_of(spark, sf):
    return G.markets_of(P.project_markets(B.chain_log(spark, sf)), "A06", 10)


def fmt(raw: str, dec: str) -> str:
    """Decimal point placed in a whole number, as text."""
    unit = f"CAST(pow(10, {dec}) AS BIGINT)"
    return f"""(CASE WHEN {dec} IS NULL OR {dec} <= 0 THEN {raw}::VARCHAR ELSE CAST({raw} // {unit} AS VARCHAR) ||
      (CASE WHEN {raw} % {unit} = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({raw} % {unit} AS VARCHAR), CAST({dec} AS INT), '0'), '0') END) END)"""


def exact(t: str, q: str, td: str, qd: str) -> str:
    td, qd = f"coalesce({td}, 0)", f"coalesce({qd}, 0)"
    return f"(CASE WHEN {t} <> 0 THEN ({q}::DOUBLE * pow(10.0, greatest({td} - {qd}, 0))) / ({t}::DOUBLE * pow(10.0, greatest({qd} - {td}, 0))) END)"


NQD = f"(CASE WHEN t.quote_mint = '{NATIVE}' THEN 9 WHEN t.quote_mint IS NOT NULL THEN m.quote_decimals END)"
def _shown(source: str) -> str:
    return f"""
, shown AS (SELECT t.*, {fmt('t.token_amount_raw', 'm.decimals')} AS token_amount, {fmt('t.quote_amount_raw', NQD)} AS quote_amount,
    {exact('t.token_amount_raw', 't.quote_amount_raw', 'm.decimals', NQD)} AS price FROM {source} t LEFT JOIN ev_meta m USING (asset_id))
"""


@query(
    "trades_of",
    _shown("ev_trades") + """SELECT event_id, side, event_unix_ts, token_amount, quote_amount, price FROM shown WHERE asset_id = 'A06'
      ORDER BY event_time DESC, slot DESC, insert_seq DESC LIMIT 100""",
    ["ev_trades", "ev_meta"],
)
def trades_of(spark, sf):
    return G.trades_of(B.ev_trades(spark, sf), B.ev_meta(spark, sf), "A06", 100).select("event_id", "side", "event_unix_ts", "token_amount", "quote_amount", "price")


PAGE_COLS = "event_id, activity_type, event_unix_ts, slot, insert_seq, quantity, total_quote, price, has_more, next_event_unix_ts, next_slot, next_insert_seq, snapshot_log_id"


def _page_sql(where: str, limit: int) -> str:
    return f"""
    , page AS (SELECT event_id, activity_type, event_unix_ts, slot, insert_seq, token_amount AS quantity, quote_amount AS total_quote, price,
        row_number() OVER (ORDER BY event_unix_ts DESC, slot DESC, insert_seq DESC) AS rn, count(*) OVER () AS total
      FROM shown WHERE asset_id = 'A06' AND {where}),
    edge AS (SELECT event_unix_ts AS u, slot AS sl, insert_seq AS iq FROM page WHERE rn = {limit} AND total > {limit})
    SELECT page.* EXCLUDE (rn, total), total > {limit} AS has_more, u AS next_event_unix_ts, sl AS next_slot, iq AS next_insert_seq,
      {B.position_sql(5)} AS snapshot_log_id FROM page LEFT JOIN edge ON TRUE WHERE rn <= {limit}
    """


@query("activity_page", ACTIVITY + _shown("activity") + _page_sql("TRUE", 60), ["chain_log", "ev_meta"])
def activity_page(spark, sf):
    rows = P.activity_of(B.chain_log(spark, sf), "A06")
    return G.activity_page(rows, B.ev_meta(spark, sf), "A06", 60, None, B.position(spark, sf, 5)).select(*PAGE_COLS.split(", "))


@query("activity_page_next", ACTIVITY + _shown("activity") + _page_sql("(event_unix_ts, slot, insert_seq) < (1705000000, 1000, 4000)", 500), ["chain_log", "ev_meta"])
def activity_page_next(spark, sf):
    rows = P.activity_of(B.chain_log(spark, sf), "A06", 1705000000)
    return G.activity_page(rows, B.ev_meta(spark, sf), "A06", 500, (1705000000, 1000, 4000), B.position(spark, sf, 5)).select(*PAGE_COLS.split(", "))


CREATED = """
, created AS (SELECT ref_mint AS asset_id, event_id, event_unix_ts, nullif(p_creator, '') AS creator, p_curve AS bonding_curve,
    'name ' || user_address AS name, CASE WHEN log_id % 5 = 0 THEN '' ELSE 'S' || user_address END AS symbol,
    'ipfs://' || user_address AS uri, (log_id * 100)::VARCHAR AS token_total_supply,
    CASE WHEN log_id % 2 = 0 THEN 'TP' END AS token_program, log_id % 2 = 0 AS is_mayhem_mode,
    CASE WHEN log_id % 3 <> 0 THEN log_id % 4 END AS decimals
  FROM chain_log WHERE event_type = 'create'
  QUALIFY row_number() OVER (PARTITION BY ref_mint ORDER BY slot DESC, tx_index DESC, outer_index DESC, inner_index DESC NULLS LAST) = 1)
"""


@query("create_summary", CREATED + "SELECT *, 'pumpfun' AS protocol, 'create' AS event_type FROM created", ["chain_log"])
def create_summary(spark, sf):
    return G.create_summary(B.chain_log(spark, sf))


@query(
    "token_detail",
    POINTS + _anchor_sql(M.SUMMARY_PROBES) + STATS.format(span=86400) + MODEL + MARKETS + SNAP + CREATED + f"""
    , mk AS (SELECT asset_id, string_agg(market_id, ',' ORDER BY started_at DESC, market_id) AS markets FROM (SELECT * FROM markets
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY started_at DESC, market_id) <= 10) GROUP BY asset_id),
    tr AS (SELECT asset_id, string_agg(event_id, ',' ORDER BY event_time DESC, slot DESC, insert_seq DESC) AS trades FROM (SELECT * FROM ev_trades
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY event_time DESC, slot DESC, insert_seq DESC) <= 20) GROUP BY asset_id),
    ev AS (SELECT ref_mint AS asset_id, string_agg(event_id, ',' ORDER BY log_id DESC) AS events FROM (SELECT * FROM chain_log WHERE ref_mint IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ref_mint ORDER BY log_id DESC) <= 20) GROUP BY 1),
    mv AS (SELECT ref_mint AS asset_id, event_id FROM chain_log WHERE event_type = 'migrate'
        QUALIFY row_number() OVER (PARTITION BY ref_mint ORDER BY slot DESC, tx_index DESC, outer_index DESC, inner_index DESC NULLS LAST) = 1),
    qm AS (SELECT asset_id, quote_mint FROM ev_trades QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY event_time DESC, slot DESC, insert_seq DESC) = 1)
    SELECT s.asset_id, s.name, c.event_id AS create_id, s.active_market_id AS market, mk.markets, tr.trades, ev.events,
      CASE WHEN s.migrated_at IS NOT NULL OR s.current_stage = 'pool' THEN mv.event_id END AS migrate_id,
      coalesce(qm.quote_mint, s.quote_mint) AS quote, CASE WHEN coalesce(qm.quote_mint, s.quote_mint) = '{NATIVE}' THEN 9 ELSE s.quote_decimals END::BIGINT AS quote_dec,
      CASE WHEN coalesce(qm.quote_mint, s.quote_mint) = '{NATIVE}' THEN 'SOL' ELSE coalesce(qm.quote_mint, s.quote_mint) END AS quote_symbol,
      a.latest_price, (a.latest_price - a.price_24h_ago) / nullif(a.price_24h_ago, 0) * 100 AS h24, stats.txns_24h, stats.makers_24h
    FROM snap s LEFT JOIN created c USING (asset_id) LEFT JOIN mk USING (asset_id) LEFT JOIN tr USING (asset_id) LEFT JOIN ev USING (asset_id)
    LEFT JOIN mv USING (asset_id) LEFT JOIN qm USING (asset_id) LEFT JOIN anchors a USING (asset_id) LEFT JOIN stats USING (asset_id)
    """,
    ["chain_log", "ev_trades", "ev_meta"],
)
def token_detail(spark, sf):
    log, tokens, meta, markets = _model(spark, sf)
    d = G.token_detail(tokens, meta, markets, B.ev_trades(spark, sf), log)

    def ids(c, field="event_id"):
        return F.array_join(F.transform(c, lambda x: x[field]), ",")

    return d.select(
        "asset_id", "name", col("create_event.event_id").alias("create_id"), col("active_market.market_id").alias("market"),
        ids("markets", "market_id").alias("markets"), ids("recent_trades").alias("trades"), ids("recent_events").alias("events"),
        col("migrate_event.event_id").alias("migrate_id"), col("quote.mint").alias("quote"), col("quote.decimals").alias("quote_dec"),
        col("quote.symbol").alias("quote_symbol"), "latest_price", col("price_changes.h24").alias("h24"),
        col("stats_24h.txns_24h").alias("txns_24h"), col("stats_24h.makers_24h").alias("makers_24h"),
    )


@query(
    "token_overview",
    POINTS + MODEL + MARKETS + f"""
    SELECT t.asset_id, e.event_unix_ts AS create_unix_ts, 'name ' || e.user_address AS create_name, m.protocol AS market_protocol,
      m.started_at AS market_started_at, l.event_unix_ts AS latest_event_unix_ts, l.side AS latest_trade_side, l.price AS latest_price
    FROM tokens t LEFT JOIN chain_log e ON e.event_id = t.create_event_id LEFT JOIN markets m ON m.market_id = t.active_market_id
    LEFT JOIN ({LATEST}) l ON l.asset_id = t.asset_id
    """,
    ["chain_log", "ev_trades", "ev_meta"],
)
def token_overview(spark, sf):
    log, tokens, meta, markets = _model(spark, sf)
    return G.token_overview(tokens, meta, log, markets, B.ev_trades(spark, sf)).select(
        "asset_id", "create_unix_ts", "create_name", "market_protocol", "market_started_at", "latest_event_unix_ts",
        "latest_trade_side", "latest_price",
    )


def _feed(name: str, mode: str):
    wins = {"prepend": "live", "append": "page"}[mode]

    @query(
        name,
        f"""
        , page AS (SELECT event_id, log_id, 'page' AS src FROM chain_log WHERE log_id <= {B.position_sql(6)}),
        live AS (SELECT event_id, log_id, 'live' AS src FROM chain_log WHERE log_id > {B.position_sql(4)}
          UNION ALL SELECT event_id, log_id + 2 * {B.position_sql(10)}, 'live' FROM chain_log WHERE log_id > {B.position_sql(8)})
        SELECT event_id, log_id, src, CASE WHEN src = '{wins}' THEN 0 ELSE 1 END::BIGINT AS part
        FROM (SELECT * FROM page UNION ALL SELECT * FROM live WHERE log_id > {B.position_sql(5)})
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY src = '{wins}' DESC, {'-' if mode == 'prepend' else ''}log_id) = 1
        """,
        ["chain_log"],
    )
    def run(spark, sf):
        """A page and the live rows overlap, and the newest live rows come again: every row takes part."""
        log = B.chain_log(spark, sf).select("event_id", "log_id")
        early, half, most, late, top = (B.position(spark, sf, t) for t in (4, 5, 6, 8, 10))
        page = log.where(col("log_id") <= most).withColumn("src", F.lit("page"))
        again = log.where(col("log_id") > late).withColumn("log_id", col("log_id") + 2 * top)
        live = log.where(col("log_id") > early).unionByName(again).withColumn("src", F.lit("live"))
        return G.feed_merge(page, live, half, mode)


_feed("feed_merge_prepend", "prepend")
_feed("feed_merge_append", "append")


@query(
    "live_activity",
    ACTIVITY + f"""
    , x AS (SELECT t.*, coalesce(m.decimals, 6) AS td, 9 AS qd FROM activity t LEFT JOIN ev_meta m USING (asset_id))
    SELECT event_id, asset_id, activity_type, side, {fmt('token_amount_raw', 'td')} AS quantity, {fmt('quote_amount_raw', 'qd')} AS total_quote,
      CASE WHEN token_amount_raw > 0 THEN (quote_amount_raw::DOUBLE / pow(10.0, qd)) / (token_amount_raw::DOUBLE / pow(10.0, td)) END AS price FROM x
    """,
    ["chain_log", "ev_meta"],
)
def live_activity(spark, sf):
    none = F.lit(None)
    detail = B.ev_meta(spark, sf).select(
        "asset_id", "decimals", none.cast("int").alias("create_decimals"), "quote_mint", "quote_decimals",
        none.cast("string").alias("base_mint"), none.cast("int").alias("base_mint_decimals"),
        none.cast("string").alias("market_quote_mint"), none.cast("int").alias("market_quote_decimals"),
    )
    return G.live_activity(B.chain_log(spark, sf), detail).select("event_id", "asset_id", "activity_type", "side", "quantity", "total_quote", "price")
