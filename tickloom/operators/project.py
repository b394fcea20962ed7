"""Projection: event log -> current state and facts.

State tables merge column by column in log order. A state row keeps, beside each value,
the log position it came from, so merging is associative and commutative: a projected
batch merges into stored state by the same aggregate that built it, batches may be cut
anywhere, and merging a batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AMM, AMM_MARKET, CURVE, CURVE_MARKET, NATIVE_DECIMALS, NATIVE_MINT, STAGE_CURVE, STAGE_POOL
from ..functions.display import resolve_uri
from ..functions.scalars import empty_to_null, orient_pair, other_side
from ..sources.log import classify, is_kind, parse_payload, payload_asset, payload_error
from .common import first_per_key

LAST_SET = "last non-null"
FIRST_SET = "first non-null"
LAST = "last"
LEAST = "least"

Rules = Mapping[str, str]

TOKENS: Rules = {
    "creator": LAST_SET,
    "bonding_curve": LAST_SET,
    "token_program": LAST_SET,
    "create_event_id": FIRST_SET,
    "first_seen_at": LEAST,
    "current_stage": LAST,
    "active_market_id": LAST_SET,
    "active_market_type": LAST_SET,
    "migrated_at": LAST_SET,
}
METADATA: Rules = dict.fromkeys(
    [
        "name", "symbol", "uri", "decimals", "total_supply_raw", "quote_mint", "quote_decimals", "creator",
        "bonding_curve", "token_program", "is_mayhem_mode", "is_cashback_enabled", "source_event_id",
    ],
    LAST_SET,
)
MARKETS: Rules = {
    "asset_id": LAST,
    "protocol": LAST,
    "market_type": LAST,
    **dict.fromkeys(
        ["bonding_curve", "pool", "base_mint", "quote_mint", "base_mint_decimals", "quote_mint_decimals", "lp_mint"],
        LAST_SET,
    ),
    "started_at": LEAST,
    "create_event_id": FIRST_SET,
    # a close counts only after the market's first insert; both positions are kept until read
    "closed_at": LAST_SET,
    "first_insert": LEAST,
}
KEYS = {"tokens": "asset_id", "metadata": "asset_id", "markets": "market_id"}
RULES = {"tokens": TOKENS, "metadata": METADATA, "markets": MARKETS}
FACTS = ("trades", "activity")


# --- merging ------------------------------------------------------------------------


def _lift(updates: DataFrame, key: str, rules: Rules) -> DataFrame:
    """Values with their log position; null where the update does not set the column."""
    cols: list[Column] = [F.col(key)]
    for name, rule in rules.items():
        value = F.col(name)
        if rule == LEAST:
            cols.append(value.alias(name))
        else:
            placed = F.struct(F.col("log_id").alias("at"), value.alias("value"))
            wanted = F.col("_insert") if rule == LAST else value.isNotNull()
            cols.append(F.when(wanted, placed).alias(name))
    return updates.select(*cols)


def merge_rows(state: DataFrame, key: str, rules: Rules) -> DataFrame:
    aggs = [(F.max if rule in (LAST, LAST_SET) else F.min)(name).alias(name) for name, rule in rules.items()]
    return state.groupBy(key).agg(*aggs)


def settle(state: DataFrame, key: str, rules: Rules) -> DataFrame:
    """Plain values of a state table."""
    cols = [F.col(key)]
    for name, rule in rules.items():
        cols.append(F.col(name) if rule == LEAST else F.col(f"{name}.value").alias(name))
    return state.select(*cols)


# --- updates per event --------------------------------------------------------------


def _by_kind(**values: Column | None) -> Column:
    out = None
    for kind, value in values.items():
        if value is not None:
            out = F.when(is_kind(kind), value) if out is None else out.when(is_kind(kind), value)
    return out


def _set(name: str) -> Column:
    return empty_to_null(F.col(name))


def _creator_of_pool() -> Column:
    return F.coalesce(_set("doc.coin_creator"), _set("doc.creator"))


STATE_FIELDS = [
    "mint", "bonding_curve", "creator", "token_program", "pool", "base_mint", "quote_mint", "coin_creator",
    "name", "symbol", "uri", "mint_decimals", "token_total_supply", "is_mayhem_mode", "is_cashback_enabled",
    "base_mint_decimals", "quote_mint_decimals", "lp_mint",
]


def _updates(log: DataFrame, kinds: list[str]) -> DataFrame:
    wanted = F.lit(False)
    for kind in kinds:
        wanted = wanted | is_kind(kind)
    parsed = parse_payload(log.where(wanted), STATE_FIELDS).where(payload_error().isNull())
    return (
        parsed.withColumn("asset_id", empty_to_null(payload_asset()))
        .where("asset_id IS NOT NULL")
        .withColumn("_insert", F.lit(True))
    )


def token_state(log: DataFrame) -> DataFrame:
    on_curve = F.col("protocol") == CURVE
    u = _updates(log, ["curve_create", "curve_migrate", "amm_create_pool"]).select(
        "asset_id",
        "log_id",
        "_insert",
        _by_kind(curve_create=_set("doc.creator"), curve_migrate=_set("refs.creator"), amm_create_pool=_creator_of_pool()).alias("creator"),
        F.when(on_curve, _set("doc.bonding_curve")).alias("bonding_curve"),
        F.when(on_curve, _set("doc.token_program")).alias("token_program"),
        _by_kind(curve_create=F.col("event_id")).alias("create_event_id"),
        F.col("event_unix_ts").alias("first_seen_at"),
        F.when(is_kind("curve_create"), STAGE_CURVE).otherwise(STAGE_POOL).alias("current_stage"),
        F.when(is_kind("curve_create"), _set("doc.bonding_curve")).otherwise(_set("doc.pool")).alias("active_market_id"),
        F.when(is_kind("curve_create"), CURVE_MARKET).otherwise(AMM_MARKET).alias("active_market_type"),
        _by_kind(curve_migrate=F.col("event_unix_ts")).alias("migrated_at"),
    )
    return merge_rows(_lift(u, "asset_id", TOKENS), "asset_id", TOKENS)


def metadata_state(log: DataFrame) -> DataFrame:
    flip = F.col("asset_id") == F.col("doc.quote_mint")
    base_dec, quote_dec = F.col("doc.base_mint_decimals"), F.col("doc.quote_mint_decimals")
    c = "doc."
    u = _updates(log, ["curve_create", "amm_create_pool"]).select(
        "asset_id",
        "log_id",
        "_insert",
        *(_set(c + n).alias(n) for n in ("name", "symbol", "uri")),
        _by_kind(curve_create=F.col(c + "mint_decimals"), amm_create_pool=F.when(flip, quote_dec).otherwise(base_dec)).alias("decimals"),
        _set(c + "token_total_supply").try_cast("decimal(20,0)").alias("total_supply_raw"),
        _by_kind(
            curve_create=F.lit(NATIVE_MINT),
            amm_create_pool=empty_to_null(F.when(flip, F.col("doc.base_mint")).otherwise(F.col("doc.quote_mint"))),
        ).alias("quote_mint"),
        _by_kind(curve_create=F.lit(NATIVE_DECIMALS), amm_create_pool=F.when(flip, base_dec).otherwise(quote_dec)).alias("quote_decimals"),
        _by_kind(curve_create=_set(c + "creator"), amm_create_pool=_creator_of_pool()).alias("creator"),
        _set(c + "bonding_curve").alias("bonding_curve"),
        _set(c + "token_program").alias("token_program"),
        _by_kind(curve_create=F.coalesce(c + "is_mayhem_mode", F.lit(False))).alias("is_mayhem_mode"),
        _by_kind(curve_create=F.coalesce(c + "is_cashback_enabled", F.lit(False))).alias("is_cashback_enabled"),
        _set("event_id").alias("source_event_id"),
    )
    return merge_rows(_lift(u, "asset_id", METADATA), "asset_id", METADATA)


def market_state(log: DataFrame) -> DataFrame:
    u = _updates(log, ["curve_create", "curve_migrate", "amm_create_pool"])
    pool = F.when(~is_kind("curve_create"), _set("doc.pool"))
    market_id = F.when(is_kind("curve_create"), F.col("doc.bonding_curve")).otherwise(F.col("doc.pool"))
    inserts = F.struct(
        market_id.alias("market_id"),
        F.lit(True).alias("_insert"),
        F.col("asset_id"),
        F.when(is_kind("curve_create"), CURVE).otherwise(AMM).alias("protocol"),
        F.when(is_kind("curve_create"), CURVE_MARKET).otherwise(AMM_MARKET).alias("market_type"),
        _by_kind(curve_create=_set("doc.bonding_curve")).alias("bonding_curve"),
        pool.alias("pool"),
        _by_kind(amm_create_pool=_set("doc.base_mint"), curve_create=F.col("asset_id"), curve_migrate=F.col("asset_id")).alias("base_mint"),
        _by_kind(amm_create_pool=_set("doc.quote_mint"), curve_create=F.lit(NATIVE_MINT), curve_migrate=F.lit(NATIVE_MINT)).alias("quote_mint"),
        _by_kind(curve_create=F.col("doc.mint_decimals"), amm_create_pool=F.col("doc.base_mint_decimals")).alias("base_mint_decimals"),
        _by_kind(curve_create=F.lit(NATIVE_DECIMALS), amm_create_pool=F.col("doc.quote_mint_decimals")).alias("quote_mint_decimals"),
        F.when(~is_kind("curve_create"), _set("doc.lp_mint")).alias("lp_mint"),
        F.col("event_unix_ts").alias("started_at"),
        F.col("event_id").alias("create_event_id"),
        F.lit(None).cast("bigint").alias("closed_at"),
        F.col("log_id").alias("first_insert"),
    )
    blank = {f: F.lit(None).cast("string") for f in ("asset_id", "protocol", "market_type", "bonding_curve", "pool", "base_mint", "quote_mint")}
    closes = F.struct(
        F.col("doc.bonding_curve").alias("market_id"),
        F.lit(False).alias("_insert"),
        *(v.alias(k) for k, v in blank.items()),
        F.lit(None).cast("int").alias("base_mint_decimals"),
        F.lit(None).cast("int").alias("quote_mint_decimals"),
        F.lit(None).cast("string").alias("lp_mint"),
        F.lit(None).cast("bigint").alias("started_at"),
        F.lit(None).cast("string").alias("create_event_id"),
        F.col("event_unix_ts").alias("closed_at"),
        F.lit(None).cast("bigint").alias("first_insert"),
    )
    rows = F.when(is_kind("curve_migrate") & _set("doc.bonding_curve").isNotNull(), F.array(inserts, closes)).otherwise(F.array(inserts))
    exploded = u.select("log_id", F.explode(rows).alias("m")).select("log_id", "m.*").where("market_id IS NOT NULL")
    return merge_rows(_lift(exploded, "market_id", MARKETS), "market_id", MARKETS)


def settle_markets(state: DataFrame) -> DataFrame:
    """Markets that were inserted; closed only by a migration after the insert."""
    closed = F.when(F.col("closed_at.at") > F.col("first_insert"), F.col("closed_at.value"))
    return (
        state.where("first_insert IS NOT NULL")
        .withColumn("_ended", closed)
        .select(*(c for c in state.columns if c not in ("closed_at", "first_insert")), "_ended")
        .select(
            "market_id",
            *(F.col(n) if r == LEAST else F.col(f"{n}.value").alias(n) for n, r in MARKETS.items() if n not in ("closed_at", "first_insert")),
            F.col("_ended").alias("ended_at"),
        )
    )


def project_tokens(log: DataFrame) -> DataFrame:
    return settle(token_state(log), "asset_id", TOKENS)


def project_metadata(log: DataFrame) -> DataFrame:
    return settle(metadata_state(log), "asset_id", METADATA)


def project_markets(log: DataFrame) -> DataFrame:
    return settle_markets(market_state(log))


# --- facts --------------------------------------------------------------------------


def _amount(c: Column) -> Column:
    return empty_to_null(c).try_cast("decimal(20,0)")


def project_trades(log: DataFrame) -> DataFrame:
    """Curve trades as they are and AMM swaps turned to the asset's side; one row per event."""
    fields = ["bonding_curve", "pool", "ix_name", "user", "token_amount", "sol_amount"]
    df = classify(log.where(is_kind("curve_trade") | is_kind("amm_swap")), fields).where("reason IS NULL")
    curve = is_kind("curve_trade")

    def pick(a: str, b: str) -> Column:
        return F.when(curve, F.col(f"doc.{a}")).otherwise(F.col(b))

    rows = df.select(
        F.timestamp_seconds("event_unix_ts").alias("event_time"),
        "event_id",
        "event_unix_ts",
        F.col("log_id").alias("insert_seq"),
        "asset_id",
        pick("bonding_curve", "doc.pool").alias("market_id"),
        F.when(curve, CURVE_MARKET).otherwise(AMM_MARKET).alias("market_type"),
        "protocol",
        pick("side", "swap.side").alias("side"),
        pick("ix_name", "doc.ix_name").alias("ix_name"),
        pick("user", "doc.user").alias("user_address"),
        F.when(curve, F.lit(NATIVE_MINT)).otherwise(F.col("swap.counter_mint")).alias("quote_mint"),
        _amount(pick("token_amount", "swap.token_amount_raw")).alias("token_amount_raw"),
        _amount(pick("sol_amount", "swap.quote_amount_raw")).alias("quote_amount_raw"),
        "tx_signature",
        "slot",
        "event_source",
    )
    return first_per_key(rows, ["event_time", "event_id"], F.col("insert_seq"))


def project_activity(log: DataFrame) -> DataFrame:
    """All seven kinds on one timeline, with amounts from the asset's side and the payload as details."""
    fields = ["bonding_curve", "pool", "user", "creator", "action", "token_amount", "sol_amount", "mint_amount"]
    df = classify(log, fields).where("reason IS NULL")

    def pair(base: str, quote: str) -> Column:
        return orient_pair(F.col("asset_id"), F.col("doc.base_mint"), F.col("doc.quote_mint"), F.col(f"doc.{base}"), F.col(f"doc.{quote}"))

    put, took = pair("base_amount_in", "quote_amount_in"), pair("base_amount_out", "quote_amount_out")
    moved = F.when(F.col("doc.action") == "deposit", put).when(F.col("doc.action") == "withdraw", took)

    def amount(side: str) -> Column:
        curve = {"token_amount_raw": ("token_amount", "mint_amount"), "quote_amount_raw": ("sol_amount", "sol_amount")}[side]
        return _amount(
            _by_kind(
                curve_trade=F.col(f"doc.{curve[0]}"),
                curve_migrate=F.col(f"doc.{curve[1]}"),
                amm_swap=F.col(f"swap.{side}"),
                amm_create_pool=put[side],
                amm_liquidity=moved[side],
            )
        ).alias(side)

    on_curve = is_kind("curve_trade") | is_kind("curve_create")
    rows = df.select(
        F.timestamp_seconds("event_unix_ts").alias("event_time"),
        "event_id",
        "event_unix_ts",
        F.col("log_id").alias("insert_seq"),
        "asset_id",
        "protocol",
        "event_type",
        F.when(is_kind("amm_swap"), "trade").when(is_kind("amm_liquidity"), F.col("doc.action")).otherwise(F.col("event_type")).alias("activity_type"),
        F.when(on_curve, _set("doc.bonding_curve")).otherwise(_set("doc.pool")).alias("market_id"),
        F.when(on_curve, CURVE_MARKET).otherwise(AMM_MARKET).alias("market_type"),
        F.when(is_kind("amm_create_pool"), _set("doc.creator")).otherwise(_set("doc.user")).alias("user_address"),
        empty_to_null(_by_kind(curve_trade=F.col("doc.side"), amm_swap=F.col("swap.side"))).alias("side"),
        empty_to_null(
            _by_kind(
                curve_trade=F.lit(NATIVE_MINT), curve_migrate=F.lit(NATIVE_MINT), amm_swap=F.col("swap.counter_mint"),
                # the pool's quote column is the base side only where the asset is the quote side
                amm_create_pool=F.when(F.col("asset_id") == F.col("doc.quote_mint"), F.col("doc.base_mint")).otherwise(F.col("doc.quote_mint")),
                amm_liquidity=other_side(F.col("asset_id"), F.col("doc.base_mint"), F.col("doc.quote_mint")),
            )
        ).alias("quote_mint"),
        amount("token_amount_raw"),
        amount("quote_amount_raw"),
        "tx_signature",
        "slot",
        "event_source",
        F.col("payload").alias("details"),
    )
    return first_per_key(rows, ["event_time", "event_id"], F.col("insert_seq"))


def activity_of(log: DataFrame, asset: str, until: int | None = None) -> DataFrame:
    """One asset's timeline, of events up to a time: only rows that can be the asset's are parsed and ranked.

    An event's asset is its reference or stands in its payload, as it is or, in part, as escapes.
    """
    payload = F.col("payload")
    near = (F.col("refs.mint") == asset) | payload.contains(asset) | payload.contains("\\u")
    if until is not None:
        near = near & (F.col("event_unix_ts") <= until)
    return project_activity(log.where(near)).where(F.col("asset_id") == asset)


# --- batches ------------------------------------------------------------------------


def project_batch(log: DataFrame) -> dict[str, DataFrame]:
    """Everything one batch of the log contributes."""
    return {
        "tokens": token_state(log),
        "metadata": metadata_state(log),
        "markets": market_state(log),
        "trades": project_trades(log),
        "activity": project_activity(log),
    }


def merge_table(name: str, state: DataFrame, delta: DataFrame) -> DataFrame:
    if name in FACTS:
        return first_per_key(state.unionByName(delta), ["event_time", "event_id"], F.col("insert_seq"))
    return merge_rows(state.unionByName(delta), KEYS[name], RULES[name])


def merge_state(state: Mapping[str, DataFrame], delta: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """State after a batch; equal to projecting the whole log, whatever the cut."""
    return {name: merge_table(name, state[name], delta[name]) for name in delta}


def read_model(state: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Plain tables of a state."""
    out = {name: settle(state[name], KEYS[name], RULES[name]) for name in ("tokens", "metadata")}
    out["markets"] = settle_markets(state["markets"])
    return out | {name: state[name] for name in FACTS if name in state}


def replay_from(log: DataFrame, offset: int, state: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """State with everything after ``offset`` applied, and the new high-water mark (one row).

    Offset 0 without a state rebuilds, from position 0 on. The batch is as large as the caller lets it be;
    the result does not depend on where it is cut.
    """
    rest = log if state is None and offset == 0 else log.where(F.col("log_id") > offset)
    delta = project_batch(rest)
    mark = rest.agg(F.greatest(F.coalesce(F.max("log_id"), F.lit(offset)), F.lit(offset)).cast("bigint").alias("last_log_id"))
    return (dict(delta) if state is None else merge_state(state, delta)), mark


def projection_lag(log: DataFrame, checkpoint: int, now: int) -> DataFrame:
    """How far behind the checkpoint is, in log positions and in seconds."""
    done = F.max(F.when(F.col("log_id") <= checkpoint, F.struct("log_id", "event_unix_ts")))["event_unix_ts"]
    zero = F.lit(0)
    return log.agg(
        F.greatest(F.coalesce(F.max("log_id"), zero) - checkpoint, zero).alias("log_id_lag"),
        F.greatest(F.lit(now) - done, zero).alias("event_time_lag_seconds"),
    )


def active_market(tokens: DataFrame, markets: DataFrame) -> DataFrame:
    """Each token's market: the one its active id names, or without an id its newest open one."""
    m = markets.select("asset_id", "market_id", "market_type", "started_at", "ended_at")
    by_id = m.select("asset_id", F.col("market_id").alias("active_market_id"), F.struct("market_id", "market_type", "started_at", "ended_at").alias("_named"))
    open_ = m.where("ended_at IS NULL").groupBy("asset_id").agg(
        F.max_by(F.struct("market_id", "market_type", "started_at", "ended_at"), F.struct("started_at", "market_id")).alias("_open")
    )
    chosen = F.when(F.col("active_market_id").isNull(), F.col("_open")).otherwise(F.col("_named"))
    return (
        tokens.select("asset_id", "active_market_id")
        .join(by_id, ["asset_id", "active_market_id"], "left")
        .join(open_, "asset_id", "left")
        .select("asset_id", chosen.alias("m"))
        .select("asset_id", "m.*")
    )


def enrich_images(metadata: DataFrame, docs: DataFrame) -> DataFrame:
    """Metadata with the image its fetched document names; a blank or missing image changes nothing."""
    image = empty_to_null(F.get_json_object("document", "$.image"))
    found = docs.select("asset_id", resolve_uri(image).alias("_image")).where("_image IS NOT NULL")
    found = found.groupBy("asset_id").agg(F.max("_image").alias("_image"))
    return metadata.join(found, "asset_id", "left").withColumn("image_uri", F.coalesce("_image", "image_uri")).drop("_image")
