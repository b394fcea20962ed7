"""Boards, search, detail records and feeds over the read model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    AMM,
    CURVE,
    DEFAULT_TOKEN_DECIMALS,
    LIQUIDITY_HEAT,
    MARKET_CAP_HEAT,
    NATIVE_DECIMALS,
    NATIVE_MINT,
    STAGE_POOL,
    TXN_HEAT,
    VOLUME_HEAT,
)
from ..functions.display import age_seconds, heat_level, relative_age
from ..functions.scalars import (
    empty_to_null,
    exact_price,
    format_amount,
    pct_change,
    quote_decimals_native_first,
    scale_amount,
)
from .common import first_per_key, shuffled, top_per_key
from .logscan import latest_event
from .metrics import change_columns, latest_trade, trade_summary
from .project import active_market, project_activity

VIEWS = ("hot", "new")
BOARD_WINDOWS = ("1m", "5m", "1h", "4h", "24h")


def view_name(view: str | None) -> str:
    view = (view or "").strip().lower()
    return view if view in VIEWS else "hot"


def window_name(window: str | None) -> str:
    window = (window or "").strip().lower()
    if window in ("", "1d"):
        return "24h"
    if window not in BOARD_WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    return window


# --- snapshots and search -----------------------------------------------------------


def _snapshot_rows(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    m = meta.select(
        "asset_id", "name", "symbol", "uri", "image_uri", "decimals", "total_supply_raw", "quote_mint", "quote_decimals",
        F.col("creator").alias("_c"), F.col("bonding_curve").alias("_b"), F.col("token_program").alias("_t"),
        "is_mayhem_mode", "is_cashback_enabled",
    )
    return (
        tokens.join(shuffled(m), "asset_id", "left")
        .withColumn("creator", F.coalesce("_c", "creator"))
        .withColumn("bonding_curve", F.coalesce("_b", "bonding_curve"))
        .withColumn("token_program", F.coalesce("_t", "token_program"))
        .drop("_c", "_b", "_t")
    )


def snapshots(tokens: DataFrame, meta: DataFrame, limit: int | None = None, asset: str | None = None) -> DataFrame:
    """Tokens with metadata, newest first, or the one token asked for."""
    rows = _snapshot_rows(tokens, meta)
    if asset is not None:
        return rows.where(F.col("asset_id") == asset)
    if limit is None:
        return rows
    return rows.orderBy(F.desc("first_seen_at"), "asset_id").limit(limit)


def search(tokens: DataFrame, meta: DataFrame, metrics: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Case-blind substring search on id, name and symbol, best match first.

    ``%`` and ``_`` in the text work as wildcards, as they always did here.
    """
    wanted = text.strip()
    names = meta.select("asset_id", "name", "symbol", "image_uri")
    rows = tokens.select("asset_id", "first_seen_at").join(shuffled(names), "asset_id", "left")
    name, symbol = F.coalesce("name", F.lit("")), F.coalesce("symbol", F.lit(""))
    if not wanted:
        rows = rows.limit(0)
    anywhere, low = f"%{wanted}%", wanted.lower()
    hits = rows.where(F.col("asset_id").ilike(anywhere) | name.ilike(anywhere) | symbol.ilike(anywhere))
    fields = [F.lower("asset_id"), F.lower(symbol), F.lower(name)]
    rank: Column = F.lit(6)
    for level, field in reversed(list(enumerate(fields))):
        rank = F.when(field.like(low + "%"), 3 + level).otherwise(rank)
    for level, field in reversed(list(enumerate(fields))):
        rank = F.when(field == low, level).otherwise(rank)
    best = hits.withColumn("rank", rank).orderBy("rank", F.desc("first_seen_at"), "asset_id").limit(limit)
    return best.join(metrics.select("asset_id", "latest_price"), "asset_id", "left").orderBy(
        "rank", F.desc("first_seen_at"), "asset_id"
    )


# --- board --------------------------------------------------------------------------


def market_cap(supply_raw: Column, decimals: Column, price: Column) -> Column:
    return scale_amount(supply_raw, decimals) * price


RESERVE_FIELDS = [
    "real_sol_reserves", "virtual_sol_reserves", "real_token_reserves", "virtual_token_reserves", "base_mint",
    "quote_mint", "pool_base_token_reserves", "pool_quote_token_reserves", "base_amount_in", "quote_amount_in",
]


def latest_reserves(log: DataFrame) -> DataFrame:
    """Per asset its newest reserve-bearing event in chain order; only the winners' payloads are parsed."""
    bearing = ((F.col("protocol") == CURVE) & F.col("event_type").isin("trade", "create")) | (
        (F.col("protocol") == AMM) & F.col("event_type").isin("swap", "create_pool")
    )
    at = F.struct("slot", "tx_index", "instruction_path.outer_index", "instruction_path.inner_index")
    newest = (
        log.where(bearing & F.col("refs.mint").isNotNull())
        .groupBy(F.col("refs.mint").alias("asset_id"))
        .agg(F.max_by(F.struct("protocol", "payload"), at).alias("e"))
    )
    fields = ", ".join(f"{f} STRING" for f in RESERVE_FIELDS)
    parsed = newest.select("asset_id", F.col("e.protocol").alias("protocol"), F.inline(F.array(F.struct(F.from_json("e.payload", fields).alias("r")))))
    return parsed.select("asset_id", "protocol", *(empty_to_null(F.col(f"r.{f}")).alias(f"r_{f}") for f in RESERVE_FIELDS))


def liquidity(log: DataFrame, priced: DataFrame) -> DataFrame:
    """Quote reserve plus token reserve at the latest price.

    ``priced`` has asset_id, latest_price, decimals, quote_decimals and the active market's
    mints and decimals (``active_base_mint`` and so on).
    """
    df = priced.join(shuffled(latest_reserves(log)), "asset_id", "inner")
    asset, price = F.col("asset_id"), F.col("latest_price")
    zero = F.lit(0.0)

    def amount(raw: Column, decimals: Column) -> Column:
        return F.coalesce(scale_amount(raw.try_cast("decimal(38,0)"), decimals), zero)

    def at_price(raw: Column, decimals: Column) -> Column:
        return F.when(price.isNull(), zero).otherwise(amount(raw, decimals) * price)

    native = F.lit(NATIVE_DECIMALS)
    curve = amount(F.coalesce("r_real_sol_reserves", "r_virtual_sol_reserves"), native) + at_price(
        F.coalesce("r_real_token_reserves", "r_virtual_token_reserves"),
        F.coalesce("decimals", F.lit(DEFAULT_TOKEN_DECIMALS)),
    )
    base, quote = F.coalesce("r_base_mint", "active_base_mint"), F.coalesce("r_quote_mint", "active_quote_mint")
    base_res = F.coalesce("r_pool_base_token_reserves", "r_base_amount_in")
    quote_res = F.coalesce("r_pool_quote_token_reserves", "r_quote_amount_in")

    def side_dec(own: str, mint: Column) -> Column:
        return F.coalesce(F.col(own), F.when(mint == NATIVE_MINT, native).otherwise(F.col("quote_decimals")))

    is_base, is_quote = base == asset, quote == asset
    counter = F.when(is_base, quote_res).when(is_quote, base_res)
    counter_dec = F.when(is_base, side_dec("active_quote_mint_decimals", quote)).when(
        is_quote, side_dec("active_base_mint_decimals", base)
    )
    own = F.when(is_base, base_res).when(is_quote, quote_res)
    own_dec = F.coalesce("decimals", "active_base_mint_decimals", F.lit(DEFAULT_TOKEN_DECIMALS))
    pool = amount(counter, counter_dec) + at_price(own, own_dec)
    return df.select("asset_id", F.when(F.col("protocol") == CURVE, curve).when(F.col("protocol") == AMM, pool).alias("liquidity_quote"))


def board(
    tokens: DataFrame,
    meta: DataFrame,
    markets: DataFrame,
    metrics: DataFrame,
    log: DataFrame,
    view: str = "hot",
    window: str = "24h",
    limit: int | None = 100,
) -> DataFrame:
    """Ranked list of tokens with the chosen window's numbers; no limit means all of them.

    The page is cut before liquidity is computed, so the log is asked for its rows only.
    """
    view, w = view_name(view), window_name(window)
    active = markets.select(
        F.col("market_id").alias("active_market_id"),
        *(F.col(c).alias(f"active_{c}") for c in ("base_mint", "quote_mint", "base_mint_decimals", "quote_mint_decimals")),
    )
    numbers = metrics.select(
        "asset_id", "latest_price", "latest_trade_at", F.col(f"anchor_price_{w}").alias("anchor_price"),
        *(F.col(f"{c}_{w}").alias(f"{c}_window") for c in ("volume", "txns", "buys", "sells")),
    )
    rows = _snapshot_rows(tokens, meta).join(shuffled(active), "active_market_id", "left").join(shuffled(numbers), "asset_id", "left")
    counts = {f"{c}_window": F.coalesce(F.col(f"{c}_window"), F.lit(0)) for c in ("volume", "txns", "buys", "sells")}
    rows = rows.withColumns(counts).withColumns(
        {
            "active_since": F.greatest("first_seen_at", F.coalesce("migrated_at", "first_seen_at")),
            "price_change": pct_change(F.col("latest_price"), F.col("anchor_price")),
            "market_cap_quote": market_cap(F.col("total_supply_raw"), F.col("decimals"), F.col("latest_price")),
        }
    )
    order = {"hot": [F.desc("txns_window"), F.desc("volume_window")], "new": [F.desc_nulls_last("active_since")]}[view]
    order = [*order, F.desc("first_seen_at"), F.asc("asset_id")]
    page, chosen = rows, log
    if limit is not None:
        page = rows.orderBy(*order).limit(limit)
        chosen = log.join(page.select(F.col("asset_id").alias("_a")), F.col("refs.mint") == F.col("_a"), "left_semi")
    out = page.join(shuffled(liquidity(chosen, page)), "asset_id", "left")
    return out.drop("anchor_price").orderBy(*order)


def board_labels(rows: DataFrame, now: int) -> DataFrame:
    """Stage label, age label and heat levels of board rows."""
    age = age_seconds(F.col("active_since"), F.lit(now))
    mark = F.when(age <= 600, "🌱").when(age <= 3600, "⚡").otherwise("🕒")
    return rows.select(
        "asset_id",
        F.when(F.col("current_stage") == STAGE_POOL, "PumpSwap").otherwise("Pumpfun").alias("stage_label"),
        F.concat_ws(" ", mark, relative_age(F.col("active_since"), F.lit(now))).alias("age_label"),
        heat_level(F.col("volume_window"), VOLUME_HEAT).alias("volume_heat"),
        heat_level(F.col("txns_window"), TXN_HEAT).alias("txn_heat"),
        heat_level(F.col("liquidity_quote"), LIQUIDITY_HEAT).alias("liquidity_heat"),
        heat_level(F.col("market_cap_quote"), MARKET_CAP_HEAT).alias("market_cap_heat"),
    )


# --- lists of one asset -------------------------------------------------------------


def markets_of(markets: DataFrame, asset: str, limit: int = 10) -> DataFrame:
    return markets.where(F.col("asset_id") == asset).orderBy(F.desc("started_at"), "market_id").limit(limit)


def _newest() -> list[Column]:
    return [F.desc("event_time"), F.desc("slot"), F.desc("insert_seq")]


def _formatted(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Amounts as text and the price, from the asset's decimals."""
    m = meta.select("asset_id", F.col("decimals").alias("_td"), F.col("quote_decimals").alias("_qd"))
    quote_dec = F.when(F.col("quote_mint").isNotNull(), quote_decimals_native_first(F.col("quote_mint"), F.col("_qd")))
    token, quote = F.col("token_amount_raw").cast("string"), F.col("quote_amount_raw").cast("string")
    return (
        rows.join(shuffled(m), "asset_id", "left")
        .withColumns(
            {
                "token_amount": format_amount(token, F.col("_td")),
                "quote_amount": format_amount(quote, quote_dec),
                "price": exact_price(token, quote, F.col("_td"), quote_dec),
            }
        )
        .drop("_td", "_qd")
    )


def trades_of(trades: DataFrame, meta: DataFrame, asset: str, limit: int = 20) -> DataFrame:
    mine = trades.where(F.col("asset_id") == asset).orderBy(*_newest()).limit(limit)
    return _formatted(mine, meta).orderBy(*_newest())


def activity_page(
    activity: DataFrame,
    meta: DataFrame,
    asset: str,
    limit: int = 100,
    cursor: tuple[int, int, int] | None = None,
    snapshot_log_id: int = 0,
) -> DataFrame:
    """One page of an asset's timeline, newest first, strictly before the cursor (time, slot, seq).

    One row more than asked is read; it only says whether there is a next page. Each row
    carries ``has_more``, the next cursor and the log position the page is consistent with.
    """
    mine = activity.where(F.col("asset_id") == asset)
    if cursor is not None:
        time, slot, seq = cursor
        here = F.struct("event_unix_ts", "slot", "insert_seq")
        mine = mine.where((F.col("event_unix_ts") <= time) & (here < F.struct(F.lit(time).cast("bigint"), F.lit(slot).cast("bigint"), F.lit(seq).cast("bigint"))))
    read = mine.orderBy(*_newest()).limit(limit + 1)
    # at most limit + 1 rows of one asset
    whole = Window.partitionBy("asset_id")
    rank = F.row_number().over(whole.orderBy(*_newest()))
    ranked = read.withColumn("_rank", rank).withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
    last = F.max(F.when(F.col("_rank") == limit, F.struct("event_unix_ts", "slot", "insert_seq"))).over(whole)
    ranked = ranked.withColumn("_last", F.when(F.col("has_more"), last)).where(F.col("_rank") <= limit)
    cursor_cols = {f"next_{c}": F.col(f"_last.{c}") for c in ("event_unix_ts", "slot", "insert_seq")}
    page = _formatted(ranked.withColumns(cursor_cols), meta)
    return (
        page.withColumnsRenamed({"token_amount": "quantity", "quote_amount": "total_quote"})
        .withColumn("snapshot_log_id", F.lit(snapshot_log_id).cast("bigint"))
        .orderBy("_rank")
        .drop("_rank", "_last")
    )


def create_summary(log: DataFrame) -> DataFrame:
    """Per asset the newest curve create event, decoded."""
    e = latest_event(log, "create").where(F.col("protocol") == CURVE)
    fields = (
        "creator STRING, bonding_curve STRING, name STRING, symbol STRING, uri STRING, token_total_supply STRING, "
        "token_program STRING, is_mayhem_mode BOOLEAN, mint_decimals INT"
    )
    doc = e.select("asset_id", "event_id", "protocol", "event_type", "event_unix_ts", F.inline(F.array(F.struct(F.from_json("payload", fields).alias("d")))))
    return doc.select(
        "asset_id", "event_id", "protocol", "event_type", "event_unix_ts",
        *(empty_to_null(F.col(f"d.{c}")).alias(c) for c in ("creator", "bonding_curve")),
        "d.name", "d.symbol", "d.uri",
        *(empty_to_null(F.col(f"d.{c}")).alias(c) for c in ("token_total_supply", "token_program")),
        "d.is_mayhem_mode", F.col("d.mint_decimals").alias("decimals"),
    )


def _lists(rows: DataFrame, order: Sequence[Column], limit: int, cols: Sequence[str], name: str) -> DataFrame:
    """At most ``limit`` structs per asset, in order."""
    top = top_per_key(rows, ["asset_id"], order, limit)
    packed = F.sort_array(F.collect_list(F.struct("rank", *cols)))
    return top.groupBy("asset_id").agg(packed.alias(name))


def token_detail(
    tokens: DataFrame,
    meta: DataFrame,
    markets: DataFrame,
    trades: DataFrame,
    log: DataFrame,
    max_markets: int = 10,
    max_trades: int = 20,
    max_events: int = 20,
) -> DataFrame:
    """One nested row per token: snapshot, create and migrate events, markets, newest trades and events, quote, numbers.

    The parts are made apart and meet in one shuffle. Joined one by one, all of them would be sorted and aggregated in
    the same tasks, and each such step holds memory of its own.
    """
    snap = _snapshot_rows(tokens, meta)
    market_cols = [c for c in markets.columns if c != "asset_id"]
    market_list = _lists(markets, [F.desc("started_at"), F.asc("market_id")], max_markets, market_cols, "markets")
    trade_cols = ["event_id", "event_unix_ts", "side", "user_address", "market_id", "quote_mint", "token_amount_raw", "quote_amount_raw", "token_amount", "quote_amount", "price"]
    newest = top_per_key(trades, ["asset_id"], _newest(), max_trades).drop("rank")
    trade_list = _lists(_formatted(newest, meta), _newest(), max_trades, trade_cols, "recent_trades")
    events = log.where(F.col("refs.mint").isNotNull()).withColumn("asset_id", F.col("refs.mint"))
    event_list = _lists(events, [F.desc("log_id")], max_events, ["log_id", "event_id", "protocol", "event_type", "event_unix_ts", "payload"], "recent_events")
    create = create_summary(log)
    create = create.select("asset_id", F.struct(*(c for c in create.columns if c != "asset_id")).alias("create_event"))
    moved = latest_event(log, "migrate", CURVE).select("asset_id", F.struct("log_id", "event_id", "event_unix_ts", "payload").alias("_migrate"))
    current = active_market(tokens, markets).select("asset_id", F.struct("market_id", "market_type", "started_at", "ended_at").alias("active_market"))
    summary = trade_summary(trades, meta)
    stat_cols = [c for c in summary.columns if c.endswith("_24h") and not c.startswith("price")]
    changes = F.when(F.col("latest_price").isNotNull(), F.struct(*change_columns()))
    numbers = F.struct(
        F.col("quote_mint").alias("_traded_quote"), "latest_price", "latest_event_unix_ts", F.struct(*stat_cols).alias("stats_24h"), changes.alias("price_changes")
    )
    parts = {
        "create_event": create, "markets": market_list, "recent_trades": trade_list, "recent_events": event_list, "_migrate": moved,
        "active_market": current, "_numbers": summary.select("asset_id", numbers.alias("_numbers")),
    }
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
    # every part has at most one row per asset
    whole = rows.groupBy("asset_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in parts))
    out = snap.join(shuffled(whole.select("*", "_numbers.*").drop("_numbers")), "asset_id", "left")
    mint = F.coalesce(empty_to_null(F.col("_traded_quote")), empty_to_null(F.col("quote_mint")))
    quote = F.when(
        mint.isNotNull(),
        F.struct(
            mint.alias("mint"),
            quote_decimals_native_first(mint, F.col("quote_decimals")).alias("decimals"),
            F.when(mint == NATIVE_MINT, "SOL").otherwise(mint).alias("symbol"),
        ),
    )
    was_moved = F.col("migrated_at").isNotNull() | (F.col("current_stage") == STAGE_POOL)
    return (
        out.withColumn("quote", quote)
        .withColumn("migrate_event", F.when(was_moved, F.col("_migrate")))
        .drop("_migrate", "_traded_quote")
    )


def token_overview(tokens: DataFrame, meta: DataFrame, log: DataFrame, markets: DataFrame, trades: DataFrame) -> DataFrame:
    """Tokens beside their create event, current market and newest trade."""
    doc = F.from_json("payload", "name STRING, symbol STRING, uri STRING")
    # only a create event is ever a token's create_event_id
    made = log.where("event_type = 'create'").select(
        F.col("event_id").alias("create_event_id"), F.col("protocol").alias("create_protocol"),
        F.col("event_type").alias("create_event_type"), F.col("event_unix_ts").alias("create_unix_ts"),
        *(doc[c].alias(f"create_{c}") for c in ("name", "symbol", "uri")),
    )
    market = markets.select(
        F.col("market_id").alias("active_market_id"), F.col("protocol").alias("market_protocol"),
        F.col("started_at").alias("market_started_at"), F.col("ended_at").alias("market_ended_at"),
    )
    last = latest_trade(trades, meta).select(
        "asset_id", *(F.col(c).alias(f"latest_trade_{c}") for c in ("event_id", "market_id", "side", "user_address")),
        "latest_event_unix_ts", "latest_price",
    )
    return (
        tokens.join(shuffled(made), "create_event_id", "left").join(shuffled(market), "active_market_id", "left").join(shuffled(last), "asset_id", "left")
        .orderBy(F.desc("first_seen_at"), "asset_id")
    )


# --- feeds --------------------------------------------------------------------------


def feed_merge(snapshot: DataFrame, live: DataFrame, snapshot_log_id: int, mode: str = "prepend") -> DataFrame:
    """A loaded page and the live rows after it, each event once.

    ``prepend`` puts newer rows in front and lets them win, ``append`` adds them behind and
    keeps what is there. ``position`` columns give the order on screen.
    """
    if mode not in ("prepend", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    fresh = live.where(F.col("log_id") > snapshot_log_id)
    front, back = (0, 1) if mode == "prepend" else (1, 0)
    both = snapshot.withColumn("_part", F.lit(back)).unionByName(fresh.withColumn("_part", F.lit(front)))
    newest_first = F.desc("log_id") if mode == "prepend" else F.asc("log_id")
    kept = first_per_key(both, ["event_id"], F.asc("_part"), newest_first)
    within = F.when(F.col("_part") == front, F.col("log_id") * (-1 if mode == "prepend" else 1)).otherwise(-F.col("log_id"))
    return kept.withColumn("_within", within).orderBy("_part", "_within").withColumnRenamed("_part", "part").drop("_within")


def live_activity(log: DataFrame, detail: DataFrame) -> DataFrame:
    """Envelopes as display rows, with default decimals where the detail record has none.

    ``detail`` has asset_id, decimals, create_decimals, quote_mint, quote_decimals and the
    active market's base_mint, base_mint_decimals, market_quote_mint, market_quote_decimals.
    """
    rows = project_activity(log)
    complete = F.col("token_amount_raw").isNotNull() & F.col("quote_amount_raw").isNotNull()
    rows = rows.where((F.col("activity_type") != "trade") | complete)
    d = detail.select("asset_id", *(F.col(c).alias(f"d_{c}") for c in detail.columns if c != "asset_id"))
    nine, quote = F.lit(NATIVE_DECIMALS), F.col("quote_mint")
    token_dec = F.coalesce("d_decimals", "d_create_decimals", F.lit(DEFAULT_TOKEN_DECIMALS))
    quote_dec = (
        F.when(quote.isNull() | (quote == NATIVE_MINT), nine)
        .when(quote == F.col("d_quote_mint"), F.coalesce("d_quote_decimals", nine))
        .when(quote == F.col("d_base_mint"), F.coalesce("d_base_mint_decimals", nine))
        .when(quote == F.col("d_market_quote_mint"), F.coalesce("d_market_quote_decimals", nine))
        .otherwise(F.coalesce("d_quote_decimals", nine))
    )
    joined = rows.join(shuffled(d), "asset_id", "left").withColumn("_t", token_dec).withColumn("_q", quote_dec)
    token, total = F.col("token_amount_raw").cast("string"), F.col("quote_amount_raw").cast("string")
    price = F.try_divide(scale_amount(F.col("quote_amount_raw"), F.col("_q")), scale_amount(F.col("token_amount_raw"), F.col("_t")))
    return joined.select(
        *(c for c in rows.columns if c not in ("event_time", "token_amount_raw", "quote_amount_raw")),
        F.when(F.col("token_amount_raw") > 0, price).alias("price"),
        format_amount(token, F.col("_t")).alias("quantity"),
        format_amount(total, F.col("_q")).alias("total_quote"),
    )
