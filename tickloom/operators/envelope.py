"""Paired events as envelopes, and the whole path from transactions to the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AMM, CHAIN, COMMITMENT, CURVE, SCHEMA_VERSION
from ..functions.scalars import strict_other_side
from ..sources.txviews import event_bytes, explode_instructions
from .common import shuffled
from .decode import decode_events, decode_instructions, extract_decimals
from .pairing import pair_transactions

EVENT_TYPE = {
    "curve_buy": "trade", "curve_sell": "trade", "curve_buy_exact_sol_in": "trade", "curve_create": "create",
    "curve_create_v2": "create", "curve_migrate": "migrate", "amm_buy": "swap", "amm_buy_exact_quote_in": "swap",
    "amm_sell": "swap", "amm_create_pool": "create_pool", "amm_deposit": "deposit", "amm_withdraw": "withdraw",
}


def event_id(protocol: Column, event_type: Column, signature: Column, outer: Column, inner: Column) -> Column:
    head = F.concat_ws(":", F.lit(CHAIN), protocol, event_type, signature)
    return F.when(inner.isNull(), F.concat_ws(":", head, F.lit("outer"), outer)).otherwise(
        F.concat_ws(":", head, F.lit("inner"), outer, inner)
    )


def _payload(fields: dict[str, Column], args: list[str] = ()) -> Column:
    cols = [c.alias(n) for n, c in fields.items()]
    if args:
        cols.append(F.struct(*(_arg(a).alias(a) for a in args)).alias("instruction_args"))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _arg(name: str) -> Column:
    return F.col(f"instruction.args.{name}").cast("string")


def _ev(*names: str) -> dict[str, Column]:
    """Event fields; numbers travel as text."""
    flags = {"track_volume", "mayhem_mode", "is_mayhem_mode", "is_cashback_enabled", "base_mint_decimals", "quote_mint_decimals"}
    return {n: F.col(f"event.event.{n}") if n in flags else F.col(f"event.event.{n}").cast("string") for n in names}


def _acc(*names: str) -> dict[str, Column]:
    return {n: F.col("instruction.accounts")[n] for n in names}


def build_envelope(pairs: DataFrame, decimals: DataFrame | None = None) -> DataFrame:
    """Envelopes without log id; ``decimals`` gives a created mint's decimals per transaction."""
    kind = F.col("instruction.kind")
    protocol = F.when(kind.startswith("curve"), CURVE).otherwise(AMM)
    event_type = None
    for name, type_ in EVENT_TYPE.items():
        event_type = F.when(kind == name, type_) if event_type is None else event_type.when(kind == name, type_)
    df = pairs.withColumn("protocol", protocol).withColumn("event_type", event_type)
    if decimals is None:
        df = df.withColumn("mint_decimals", F.lit(None).cast("int"))
    else:
        d = decimals.select(F.col("signature").alias("_sig"), F.col("mint").alias("_mint"), "mint_decimals")
        same = (F.col("signature") == F.col("_sig")) & (F.col("event.event.mint") == F.col("_mint"))
        df = df.join(shuffled(d), same, "left").drop("_sig", "_mint")
    side = F.regexp_replace("instruction.kind", "^(curve|amm)_", "")
    by_type = F.col("event_type")
    selling = side == "sell"
    trade = _payload(
        {"side": side, **_ev("ix_name", "mint", "user"), **_acc("bonding_curve", "associated_bonding_curve"), **_ev("creator"),
         **_acc("creator_vault", "token_program"),
         **_ev("sol_amount", "token_amount", "fee", "creator_fee", "virtual_sol_reserves", "virtual_token_reserves",
               "real_sol_reserves", "real_token_reserves", "track_volume", "mayhem_mode", "cashback")},
        ["amount", "max_sol_cost", "min_sol_output", "spendable_sol_in", "min_tokens_out"],
    )
    create = _payload(
        {"ix_name": side, **_ev("mint", "bonding_curve", "user", "creator", "name", "symbol", "uri", "token_program",
         "virtual_token_reserves", "virtual_sol_reserves", "real_token_reserves", "token_total_supply",
         "is_mayhem_mode", "is_cashback_enabled"), "mint_decimals": F.col("mint_decimals")}
    )
    migrate = _payload(
        {**_ev("mint", "user", "bonding_curve", "pool", "mint_amount", "sol_amount", "pool_migration_fee"),
         **_acc("withdraw_authority", "associated_bonding_curve", "token_program", "pump_amm", "pool_authority", "lp_mint")}
    )
    swap = _payload(
        {"side": side, "ix_name": F.when(selling, "sell").otherwise(F.col("event.event.ix_name")), **_ev("pool", "user"),
         **_acc("base_mint", "quote_mint"),
         **_ev("coin_creator", "base_amount_in", "base_amount_out", "quote_amount_in", "quote_amount_out", "lp_fee",
               "protocol_fee", "coin_creator_fee", "cashback", "pool_base_token_reserves", "pool_quote_token_reserves")},
        ["base_amount_in", "min_quote_amount_out", "base_amount_out", "max_quote_amount_in", "spendable_quote_in", "min_base_amount_out"],
    )
    pool_args = F.struct(*(F.col(f"instruction.args.{a}") for a in ("index", "coin_creator", "is_mayhem_mode", "is_cashback_coin")))
    pool = _payload(
        {**_ev("pool", "creator", "base_mint", "quote_mint", "lp_mint", "base_amount_in", "quote_amount_in",
               "initial_liquidity", "coin_creator", "is_mayhem_mode"), "instruction_args": pool_args,
         **_ev("base_mint_decimals", "quote_mint_decimals")}
    )
    liquidity = _payload(
        {"action": by_type, **_ev("pool", "user"), **_acc("base_mint", "quote_mint", "lp_mint"),
         **_ev("lp_token_amount_in", "lp_token_amount_out", "base_amount_in", "quote_amount_in", "base_amount_out",
               "quote_amount_out", "lp_mint_supply")},
        ["lp_token_amount_in", "lp_token_amount_out", "max_base_amount_in", "max_quote_amount_in", "min_base_amount_out", "min_quote_amount_out"],
    )
    payload = F.when(by_type == "trade", trade).when(by_type == "create", create).when(by_type == "migrate", migrate).when(
        by_type == "swap", swap
    ).when(by_type == "create_pool", pool).otherwise(liquidity)

    ev, acc = lambda n: F.col(f"event.event.{n}"), lambda n: F.col("instruction.accounts")[n]
    curve, made = F.col("protocol") == CURVE, by_type == "create_pool"
    base = F.when(made, ev("base_mint")).when(~curve, acc("base_mint"))
    quote = F.when(made, ev("quote_mint")).when(~curve, acc("quote_mint"))
    refs = F.struct(
        F.when(curve, ev("mint")).otherwise(strict_other_side(base, quote)).alias("mint"),
        F.when(~curve | (by_type == "migrate"), ev("pool")).alias("pool"),
        F.when(by_type == "trade", acc("bonding_curve")).when(curve, ev("bonding_curve")).alias("bonding_curve"),
        F.when(~made, ev("user")).alias("user"),
        F.when(by_type.isin("trade", "create", "create_pool"), ev("creator")).when(by_type == "swap", ev("coin_creator")).alias("creator"),
        base.alias("base_mint"),
        quote.alias("quote_mint"),
        F.when(by_type == "migrate", acc("lp_mint")).when(made, ev("lp_mint")).when(by_type.isin("deposit", "withdraw"), acc("lp_mint")).alias("lp_mint"),
    )
    inner = F.when(F.col("instruction.inner_at") >= 0, F.col("instruction.inner_at"))
    outer = F.col("instruction.outer_index")
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        event_id(F.col("protocol"), by_type, F.col("signature"), outer, inner).alias("event_id"),
        F.lit(CHAIN).alias("chain"),
        "protocol",
        "event_type",
        F.lit(COMMITMENT).alias("commitment"),
        "slot",
        F.col("signature").alias("tx_signature"),
        "tx_index",
        F.struct(F.col("instruction.source").alias("source"), outer.alias("outer_index"), inner.alias("inner_index")).alias("instruction_path"),
        F.col("event.event_source").alias("event_source"),
        F.col("event.event.timestamp").alias("event_unix_ts"),
        refs.alias("refs"),
        payload.alias("payload"),
    )


def parse_transactions(views: DataFrame) -> DataFrame:
    """Transactions to envelopes: the whole decoding job, one shuffle by transaction."""
    steps = explode_instructions(views)
    pairs = pair_transactions(decode_instructions(steps), decode_events(event_bytes(views)))
    return build_envelope(pairs, extract_decimals(steps))
