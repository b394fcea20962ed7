"""The given tables read as event log, trades, metadata and transactions.

Each binding has two forms: a DataFrame function for the engine and a common table
expression for the checking SQL. They are written apart and never share code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AMM, CURVE, NATIVE_MINT as NATIVE
from ..session import tune


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def _as_decimal_text(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def asset_name(number: Column) -> Column:
    """Asset id of a whole number; at least two digits."""
    return F.format_string("A%02d", number.cast("bigint"))


def meta_number(partkey: Column) -> Column:
    """Asset number of a part's metadata: every part has one, every fifth asset has none."""
    return partkey + F.floor(partkey / 4)


def ev_log(spark: SparkSession, sf: str, files: int | None = None) -> DataFrame:
    """Event log with kinds create, migrate and trade; two users share an asset.

    ``files`` deals the narrow rows evenly to that many partitions first. A range of positions lies in few
    splits of the table, so that a part of the log would be built by as few tasks.
    """
    e = table(spark, sf, "events")
    if files is not None:
        e = e.repartition(files)
    k = F.get_json_object("props", "$.k").cast("bigint")
    asset = asset_name(F.floor(F.col("user_id") / 2))
    kind = F.when(F.col("event_type") == "signup", "create").when(
        F.col("event_type") == "error", "migrate"
    ).otherwise("trade")
    side = F.when(F.col("event_type") == "purchase", "buy").when(
        F.col("event_type") == "view", "sell"
    ).when(F.col("event_type") == "click", "buy_exact_sol_in")
    base_first = F.col("user_id") % 2 == 0
    return e.select(
        F.col("event_id").alias("log_id"),
        F.col("event_id").alias("insert_seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("event_unix_ts"),
        asset.alias("asset_id"),
        kind.alias("kind"),
        side.alias("side"),
        F.round(F.col("value") * 100).cast("bigint").alias("quote_amount_raw"),
        k.alias("token_amount_raw"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_address"),
        F.concat(F.when(kind == "migrate", "Q").otherwise("C"), asset).alias("market_id"),
        F.floor(F.col("event_id") / 4).alias("slot"),
        (F.lit(3) - F.col("event_id") % 4).alias("tx_index"),
        (F.col("user_id") % 3).cast("int").alias("outer_index"),
        F.when(k % 2 == 0, F.lit(None)).otherwise(k).cast("int").alias("inner_index"),
        F.when(base_first, asset).otherwise(NATIVE).alias("base_mint"),
        F.when(base_first, F.lit(NATIVE)).otherwise(asset).alias("quote_mint"),
    )


def ev_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade facts; every seventh trade is in a second quote currency."""
    t = ev_log(spark, sf).where("kind = 'trade'")
    return t.select(
        "event_id", "event_time", "event_unix_ts", "slot", "insert_seq", "asset_id", "market_id", "side",
        "user_address",
        F.when(F.col("log_id") % 7 == 0, "USDC").otherwise(NATIVE).alias("quote_mint"),
        "token_amount_raw", "quote_amount_raw",
    )


def ev_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of four in five assets, one row per part."""
    p = table(spark, sf, "part")
    return p.select(
        asset_name(meta_number(F.col("p_partkey"))).alias("asset_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("symbol"),
        F.concat(F.lit("ipfs://doc/"), F.col("p_partkey").cast("string")).alias("uri"),
        F.lit(None).cast("string").alias("image_uri"),
        (F.col("p_size") % 3).alias("decimals"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("total_supply_raw"),
        F.lit(NATIVE).alias("quote_mint"),
        F.lit(2).alias("quote_decimals"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("M"), F.col("p_partkey").cast("string"))).alias("creator"),
        F.lit(None).cast("string").alias("bonding_curve"),
        F.lit(None).cast("string").alias("token_program"),
        F.lit(False).alias("is_mayhem_mode"),
        F.lit(True).alias("is_cashback_enabled"),
    )


def part_docs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    image = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("ipfs://img/"), key))
    return p.select(
        asset_name(F.col("p_partkey")).alias("asset_id"),
        F.to_json(
            F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"), image.alias("image"))
        ).alias("document"),
    )


def li_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades: the wide input, one asset per part."""
    li = table(spark, sf, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "buy").when(
        F.col("l_returnflag") == "R", "sell"
    ).otherwise("buy_exact_sol_in")
    time = F.col("l_shipdate").cast("timestamp")
    quote = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    token = F.col("l_quantity").cast("bigint")
    # a total order over line items, packed in one number per level
    seq = (
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100003 + F.col("l_partkey")
    ) * 64 + token
    return li.select(
        seq.alias("insert_seq"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), quote).alias("event_id"),
        time.alias("event_time"),
        F.unix_seconds(time).alias("event_unix_ts"),
        quote.alias("slot"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("asset_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("market_id"),
        side.alias("side"),
        F.concat(F.lit("U"), F.col("l_suppkey").cast("string")).alias("user_address"),
        F.lit(NATIVE).alias("quote_mint"),
        token.alias("token_amount_raw"),
        quote.alias("quote_amount_raw"),
    )


def chain_log(spark: SparkSession, sf: str, files: int | None = None) -> DataFrame:
    """The event table as a full envelope log with all seven kinds and JSON payloads; ``files`` as in ``ev_log``."""
    log = ev_log(spark, sf, files)
    n, k = F.col("log_id"), F.col("token_amount_raw")
    text = _as_decimal_text
    amm = (
        F.when(F.col("kind") == "create", n % 4 == 0)
        .when(F.col("kind") == "migrate", n % 4 < 2)
        .otherwise(n % 3 == 0)
    )
    event_type = (
        F.when(~amm, F.col("kind"))
        .when(F.col("kind") == "create", "create_pool")
        .when(F.col("kind") == "trade", "swap")
        .when(n % 4 == 0, "deposit")
        .otherwise("withdraw")
    )
    curve = F.concat(F.lit("C"), F.col("asset_id"))
    pool = F.concat(F.lit("Q"), F.col("asset_id"))
    user, asset = F.col("user_address"), F.col("asset_id")
    blank = F.lit("")
    maybe_creator = F.when(n % 3 == 0, blank).otherwise(F.concat(F.lit("K"), user))
    quote, base = text(F.col("quote_amount_raw")), text(k)
    curve_trade = F.to_json(
        F.struct(
            F.col("side").alias("side"), F.col("side").alias("ix_name"), asset.alias("mint"),
            user.alias("user"), curve.alias("bonding_curve"), quote.alias("sol_amount"),
            base.alias("token_amount"),
            text(n * 3).alias("virtual_sol_reserves"), text(n * 5).alias("virtual_token_reserves"),
            F.when(n % 5 == 0, blank).otherwise(text(n * 2)).alias("real_sol_reserves"),
            F.when(n % 7 == 0, blank).otherwise(text(n * 4)).alias("real_token_reserves"),
        )
    )
    curve_create = F.to_json(
        F.struct(
            F.lit("create").alias("ix_name"), asset.alias("mint"), curve.alias("bonding_curve"),
            user.alias("user"), maybe_creator.alias("creator"),
            F.concat(F.lit("name "), user).alias("name"),
            F.when(n % 5 == 0, blank).otherwise(F.concat(F.lit("S"), user)).alias("symbol"),
            F.concat(F.lit("ipfs://"), user).alias("uri"),
            F.when(n % 2 == 0, "TP").otherwise("").alias("token_program"),
            text(n * 5).alias("virtual_token_reserves"), text(n * 3).alias("virtual_sol_reserves"),
            text(n * 4).alias("real_token_reserves"), text(n * 100).alias("token_total_supply"),
            (n % 2 == 0).alias("is_mayhem_mode"), (n % 3 == 0).alias("is_cashback_enabled"),
            F.when(n % 3 != 0, (n % 4).cast("int")).alias("mint_decimals"),
        )
    )
    curve_migrate = F.to_json(
        F.struct(
            asset.alias("mint"), user.alias("user"), curve.alias("bonding_curve"), pool.alias("pool"),
            base.alias("mint_amount"), quote.alias("sol_amount"),
            F.when(n % 2 == 0, "TP").otherwise("").alias("token_program"),
            F.concat(F.lit("L"), asset).alias("lp_mint"),
        )
    )
    swap_side = F.when(F.col("side") == "buy_exact_sol_in", "buy_exact_quote_in").otherwise(F.col("side"))
    selling = swap_side == "sell"
    amm_swap = F.to_json(
        F.struct(
            swap_side.alias("side"), swap_side.alias("ix_name"), pool.alias("pool"), user.alias("user"),
            F.col("base_mint").alias("base_mint"), F.col("quote_mint").alias("quote_mint"),
            maybe_creator.alias("coin_creator"),
            F.when(selling, base).alias("base_amount_in"), F.when(~selling, base).alias("base_amount_out"),
            F.when(~selling, quote).alias("quote_amount_in"), F.when(selling, quote).alias("quote_amount_out"),
            text(n * 6).alias("pool_base_token_reserves"), text(n * 7).alias("pool_quote_token_reserves"),
        )
    )
    create_pool = F.to_json(
        F.struct(
            pool.alias("pool"), user.alias("creator"), F.col("base_mint").alias("base_mint"),
            F.col("quote_mint").alias("quote_mint"), F.concat(F.lit("L"), asset).alias("lp_mint"),
            base.alias("base_amount_in"), quote.alias("quote_amount_in"),
            maybe_creator.alias("coin_creator"),
            (n % 5).cast("int").alias("base_mint_decimals"), (n % 7).cast("int").alias("quote_mint_decimals"),
        )
    )
    deposit = event_type == "deposit"
    liquidity = F.to_json(
        F.struct(
            event_type.alias("action"), pool.alias("pool"), user.alias("user"),
            F.col("base_mint").alias("base_mint"), F.col("quote_mint").alias("quote_mint"),
            F.concat(F.lit("L"), asset).alias("lp_mint"),
            F.when(deposit, base).alias("base_amount_in"), F.when(deposit, quote).alias("quote_amount_in"),
            F.when(~deposit, base).alias("base_amount_out"), F.when(~deposit, quote).alias("quote_amount_out"),
        )
    )
    payload = (
        F.when(event_type == "trade", curve_trade)
        .when(event_type == "create", curve_create)
        .when(event_type == "migrate", curve_migrate)
        .when(event_type == "swap", amm_swap)
        .when(event_type == "create_pool", create_pool)
        .otherwise(liquidity)
    )
    refs = F.struct(
        F.when(~amm | (n % 2 == 0), asset).alias("mint"),
        F.when(amm | (event_type == "migrate"), pool).alias("pool"),
        F.when(~amm, curve).alias("bonding_curve"),
        user.alias("user"),
        F.when(event_type == "migrate", maybe_creator).alias("creator"),
        F.when(amm, F.col("base_mint")).alias("base_mint"),
        F.when(amm, F.col("quote_mint")).alias("quote_mint"),
        F.lit(None).cast("string").alias("lp_mint"),
    )
    return log.select(
        "log_id",
        F.lit(1).alias("schema_version"),
        "event_id",
        F.lit("solana").alias("chain"),
        F.when(amm, AMM).otherwise(CURVE).alias("protocol"),
        event_type.alias("event_type"),
        F.lit("processed").alias("commitment"),
        "slot",
        F.concat(F.lit("t"), F.col("slot").cast("string")).alias("tx_signature"),
        "tx_index",
        F.struct(
            F.when(F.col("inner_index").isNull(), "outer").otherwise("inner").alias("source"),
            F.col("outer_index").alias("outer_index"),
            F.col("inner_index").alias("inner_index"),
        ).alias("instruction_path"),
        F.when(n % 2 == 0, "logs").otherwise("inner_cpi").alias("event_source"),
        "event_unix_ts",
        refs.alias("refs"),
        # kept apart so that the text is built once, as a stored column would be read once
        F.inline(F.array(F.struct(payload.alias("payload")))),
    )


def position(spark: SparkSession, sf: str, tenths: int) -> int:
    """Log position that many tenths of the way through the log (one value, from file statistics)."""
    return int(table(spark, sf, "events").agg(F.max("event_id")).first()[0]) * tenths // 10


def latest_time(spark: SparkSession, sf: str) -> int:
    """Newest event second: the 'now' of every checked query (one value, from file statistics)."""
    row = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("t")).select(F.unix_seconds("t")).first()
    return int(row[0])


# --- the same inputs as SQL ---------------------------------------------------------

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body.strip(), needs)


_cte(
    "ev_log",
    f"""
    SELECT event_id AS log_id, event_id AS insert_seq, 'e' || event_id AS event_id, ts AS event_time,
      epoch_us(ts) // 1000000 AS event_unix_ts,
      printf('A%02d', user_id // 2) AS asset_id,
      CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'migrate' ELSE 'trade' END AS kind,
      CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'sell'
                      WHEN 'click' THEN 'buy_exact_sol_in' END AS side,
      CAST(round(value * 100) AS BIGINT) AS quote_amount_raw,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS token_amount_raw,
      'U' || user_id AS user_address,
      (CASE event_type WHEN 'error' THEN 'Q' ELSE 'C' END) || printf('A%02d', user_id // 2) AS market_id,
      events.event_id // 4 AS slot, 3 - events.event_id % 4 AS tx_index,
      CAST(user_id % 3 AS INTEGER) AS outer_index,
      CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 1
           THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS inner_index,
      CASE WHEN user_id % 2 = 0 THEN printf('A%02d', user_id // 2) ELSE '{NATIVE}' END AS base_mint,
      CASE WHEN user_id % 2 = 0 THEN '{NATIVE}' ELSE printf('A%02d', user_id // 2) END AS quote_mint
    FROM events
    """,
)
_cte(
    "ev_trades",
    f"""
    SELECT event_id, event_time, event_unix_ts, slot, insert_seq, asset_id, market_id, side, user_address,
      CASE WHEN log_id % 7 = 0 THEN 'USDC' ELSE '{NATIVE}' END AS quote_mint,
      token_amount_raw, quote_amount_raw
    FROM ev_log WHERE kind = 'trade'
    """,
    "ev_log",
)
_cte(
    "ev_meta",
    f"""
    SELECT printf('A%02d', p_partkey + p_partkey // 4) AS asset_id, p_name AS name, p_brand AS symbol,
      'ipfs://doc/' || p_partkey AS uri, CAST(NULL AS VARCHAR) AS image_uri, p_size % 3 AS decimals,
      CAST(round(p_retailprice * 100) AS BIGINT) AS total_supply_raw, '{NATIVE}' AS quote_mint,
      2 AS quote_decimals, CASE WHEN p_size % 2 = 0 THEN 'M' || p_partkey END AS creator
    FROM part
    """,
)
_cte(
    "li_trades",
    f"""
    SELECT ((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 64 + CAST(l_quantity AS BIGINT) AS insert_seq,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS event_id,
      l_shipdate AS event_time, epoch_us(l_shipdate) // 1000000 AS event_unix_ts,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS slot, 'P' || l_partkey AS asset_id,
      'S' || l_suppkey AS market_id,
      CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'buy_exact_sol_in' END AS side,
      'U' || l_suppkey AS user_address, '{NATIVE}' AS quote_mint,
      CAST(l_quantity AS BIGINT) AS token_amount_raw, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_amount_raw
    FROM lineitem
    """,
)
# chain_log keeps the payload fields as flat columns; p_ marks a payload field
_cte(
    "chain_log",
    f"""
    SELECT l.*, CASE WHEN amm THEN '{AMM}' ELSE '{CURVE}' END AS protocol,
      CASE WHEN NOT amm THEN kind WHEN kind = 'create' THEN 'create_pool' WHEN kind = 'trade' THEN 'swap'
           WHEN log_id % 4 = 0 THEN 'deposit' ELSE 'withdraw' END AS event_type,
      't' || slot AS tx_signature,
      CASE WHEN log_id % 2 = 0 THEN 'logs' ELSE 'inner_cpi' END AS event_source,
      'C' || asset_id AS p_curve, 'Q' || asset_id AS p_pool,
      CASE WHEN log_id % 3 = 0 THEN '' ELSE 'K' || user_address END AS p_creator,
      CASE WHEN NOT amm OR log_id % 2 = 0 THEN asset_id END AS ref_mint,
      CASE WHEN side = 'buy_exact_sol_in' THEN 'buy_exact_quote_in' ELSE side END AS swap_side
    FROM (SELECT *, CASE kind WHEN 'create' THEN log_id % 4 = 0 WHEN 'migrate' THEN log_id % 4 < 2
                    ELSE log_id % 3 = 0 END AS amm FROM ev_log) l
    """,
    "ev_log",
)
_cte(
    "now",
    "SELECT max(epoch_us(ts)) // 1000000 AS now_ts FROM events",
)


def position_sql(tenths: int) -> str:
    return f"(SELECT max(event_id) * {tenths} // 10 FROM events)"


def checked(sql: str, *needs: str) -> str:
    """Put the named inputs in front of a SELECT (which may itself start with ``, name AS (...)``)."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTE[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS (\n{CTE[name][0]}\n)" for name in order]
    body = sql.strip()
    if body.startswith(","):
        return "WITH " + ",\n".join(parts) + body
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
