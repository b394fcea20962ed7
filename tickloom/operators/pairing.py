"""Instructions with the events they raised.

Each instruction, in execution order, takes the first event not taken yet that matches it;
what stays over on either side is dropped. A group is what one transaction holds under one
match key, and a transaction is bounded by the chain's packet size, so groups are small
whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.txviews import TX
from .common import first_per_key, shuffled

Match = Callable[[Column, Column], Column]


def pair_events(
    instructions: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    instruction_order: Sequence[str],
    event_order: Sequence[str],
    match: Match | None = None,
) -> DataFrame:
    """``keys`` plus structs ``instruction`` and ``event``, one row per pair.

    ``match`` adds what equal keys cannot say (absent values that fit anything, events not
    seen yet). Order columns must tell the rows of a group apart; nulls sort first.
    """
    def packed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c not in order]
        row = F.struct(F.struct(*order).alias("at"), F.struct(*order, *rest).alias("row"))
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row), _by_at).alias(name))

    both = packed(instructions, instruction_order, "_i").join(shuffled(packed(events, event_order, "_e")), list(keys))
    fits = match or (lambda i, e: F.lit(True))
    places = F.sequence(F.lit(0), F.size("_e") - 1)

    def take(taken: Column, i: Column) -> Column:
        """Places taken so far, one per instruction; -1 where nothing fits."""
        free = F.filter(places, lambda j: ~F.array_contains(taken, j) & F.coalesce(fits(i.row, F.get("_e", j).row), F.lit(False)))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.lit(-1))))

    taken = F.aggregate("_i", F.array().cast("array<int>"), take)
    placed = both.select("*", F.inline(F.array(F.struct(taken.alias("_taken")))))
    pairs = F.transform("_i", lambda i, n: F.struct(i.row.alias("instruction"), F.get("_taken", n).alias("_n")))
    rows = placed.select(*keys, "_e", F.inline(pairs)).where("_n >= 0")
    return rows.select(*keys, "instruction", F.get("_e", F.col("_n")).row.alias("event"))


def _by_at(a: Column, b: Column) -> Column:
    return F.when(a.at < b.at, -1).when(b.at < a.at, 1).otherwise(0)


def pair_ordinal(
    instructions: DataFrame, events: DataFrame, keys: Sequence[str], instruction_order: Sequence[str], event_order: Sequence[str]
) -> DataFrame:
    """The n-th instruction of a key with its n-th event: the same pairs where nothing but the key decides."""
    def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rest = [c for c in df.columns if c not in keys]
        return df.select(*keys, rank.alias("_n"), F.struct(*rest).alias(name))

    left, right = numbered(instructions, instruction_order, "instruction"), numbered(events, event_order, "event")
    return left.join(right, [*keys, "_n"]).drop("_n")


# --- match keys of decoded transactions ---------------------------------------------

# instruction kind -> (family, fields that must be equal as (argument or account, event field))
SAME = {
    "curve_buy": ("curve_trade:buy", "mint=mint user=user"),
    "curve_buy_exact_sol_in": ("curve_trade:buy_exact_sol_in", "mint=mint user=user"),
    "curve_sell": ("curve_trade:sell", "mint=mint user=user"),
    "curve_create": ("curve_create", "mint=mint creator=creator name=name symbol=symbol uri=uri"),
    "curve_create_v2": ("curve_create", "mint=mint creator=creator name=name symbol=symbol uri=uri"),
    "curve_migrate": ("curve_migrate", "mint=mint user=user bonding_curve=bonding_curve pool=pool"),
    "amm_buy": ("amm_buy:buy", "pool=pool user=user base_amount_out=base_amount_out max_quote_amount_in=max_quote_amount_in"),
    "amm_buy_exact_quote_in": (
        "amm_buy:buy_exact_quote_in",
        "pool=pool user=user spendable_quote_in=max_quote_amount_in min_base_amount_out=min_base_amount_out",
    ),
    "amm_sell": ("amm_sell", "pool=pool user=user base_amount_in=base_amount_in min_quote_amount_out=min_quote_amount_out"),
    "amm_create_pool": (
        "amm_create_pool",
        "pool=pool creator=creator base_mint=base_mint quote_mint=quote_mint base_amount_in=base_amount_in "
        "quote_amount_in=quote_amount_in coin_creator=coin_creator is_mayhem_mode=is_mayhem_mode",
    ),
    "amm_deposit": (
        "amm_deposit",
        "pool=pool user=user lp_token_amount_out=lp_token_amount_out max_base_amount_in=max_base_amount_in "
        "max_quote_amount_in=max_quote_amount_in",
    ),
    "amm_withdraw": (
        "amm_withdraw",
        "pool=pool user=user lp_token_amount_in=lp_token_amount_in min_base_amount_out=min_base_amount_out "
        "min_quote_amount_out=min_quote_amount_out",
    ),
}
# fields compared only where the instruction gives them
MAYBE = {
    "curve_create": "bonding_curve user",
    "curve_create_v2": "bonding_curve user is_mayhem_mode is_cashback_enabled",
    "amm_buy": "track_volume",
    "amm_buy_exact_quote_in": "track_volume",
}
MAYBE_FIELDS = ["bonding_curve", "user", "is_mayhem_mode", "is_cashback_enabled", "track_volume"]
BUY_NAMES = {True: ("buy", "buy_exact_sol_in"), False: ("sell",)}


def _text(parts: list[Column]) -> Column:
    return F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _args(instructions: DataFrame) -> list[str]:
    return instructions.schema["args"].dataType.fieldNames()


def keyed_instructions(instructions: DataFrame) -> DataFrame:
    """Readable instructions with ``match_key`` and the values that only count where given."""
    args = _args(instructions)
    # a field that is both an argument and a role (such as creator) counts as the argument
    owned = {"amm_create_pool": {"creator", "base_mint", "quote_mint"}}

    def given(kind: str, name: str) -> Column:
        role = name not in args or name in owned.get(kind, ())
        return F.col("accounts")[name] if role else F.col(f"args.{name}")

    key, maybe = None, {f: None for f in MAYBE_FIELDS}
    for kind, (family, same) in SAME.items():
        parts = [F.lit(family), *(given(kind, p.split("=")[0]) for p in same.split())]
        hit = F.col("kind") == kind
        key = F.when(hit, _text(parts)) if key is None else key.when(hit, _text(parts))
        for name in MAYBE.get(kind, "").split():
            value = F.nullif(given(kind, name).cast("string"), F.lit(""))
            maybe[name] = F.when(hit, value) if maybe[name] is None else maybe[name].when(hit, value)
    values = F.struct(*(v.alias(n) for n, v in maybe.items()))
    kept = instructions.where("args IS NOT NULL AND accounts IS NOT NULL")
    cols = [*TX, "source", "outer_index", F.coalesce("inner_index", F.lit(-1)).alias("inner_at"), "kind", "args", "accounts"]
    return kept.select(*cols, key.alias("match_key"), values.alias("maybe"))


def keyed_events(events: DataFrame) -> DataFrame:
    """Readable events with ``match_key``; identical ones of a transaction collapse to the first seen."""
    e = lambda name: F.col(f"event.{name}")
    single = first_per_key(events.where("event IS NOT NULL"), ["signature", "kind", "event"], F.col("seen_group"), F.col("seen_at"), F.col("seen_cut"))
    named = F.when(
        F.col("kind") == "curve_trade",
        F.when(e("is_buy") & e("ix_name").isin(*BUY_NAMES[True]), F.concat(F.lit("curve_trade:"), e("ix_name"))).when(
            ~e("is_buy") & e("ix_name").isin(*BUY_NAMES[False]), F.concat(F.lit("curve_trade:"), e("ix_name"))
        ),
    ).when(F.col("kind") == "amm_buy", F.concat(F.lit("amm_buy:"), e("ix_name"))).otherwise(F.col("kind"))
    key = None
    done = set()
    for family, same in SAME.values():
        if family not in done:
            done.add(family)
            parts = [F.lit(family), *(e(p.split("=")[1]) for p in same.split())]
            hit = F.col("_family") == family
            key = F.when(hit, _text(parts)) if key is None else key.when(hit, _text(parts))
    return single.withColumn("_family", named).withColumn("match_key", key).where("match_key IS NOT NULL").select(
        *TX, "seen_group", "seen_at", "seen_cut", "event_source", "kind", "event", "match_key"
    )


def _fits(i: Column, e: Column) -> Column:
    seen = e.seen_group <= i.outer_index
    for name in MAYBE_FIELDS:
        seen = seen & (i.maybe[name].isNull() | i.maybe[name].eqNullSafe(e.event[name].cast("string")))
    return seen


def pair_transactions(instructions: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs of decoded instructions and events, transaction by transaction."""
    keys = [*TX, "match_key"]
    return pair_events(
        keyed_instructions(instructions), keyed_events(events), keys,
        ["outer_index", "inner_at"], ["seen_group", "seen_at", "seen_cut"], _fits,
    ).drop("match_key")
