"""Explicit schemas; nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# --- nested transaction -------------------------------------------------------------

_INSTRUCTION = [
    T.StructField("program_id_index", T.IntegerType()),
    T.StructField("program_id", T.StringType()),
    T.StructField("account_indices", T.ArrayType(T.IntegerType())),
    T.StructField("account_pubkeys", T.ArrayType(T.StringType())),
    T.StructField("data_len", T.IntegerType()),
    T.StructField("data_prefix", T.ArrayType(T.IntegerType())),
    T.StructField("data_base64", T.StringType()),
]
OUTER_INSTRUCTION = T.StructType(_INSTRUCTION)
INNER_INSTRUCTION = T.StructType(_INSTRUCTION + [T.StructField("stack_height", T.IntegerType())])
INNER_GROUP = T.StructType(
    [
        T.StructField("outer_instruction_index", T.IntegerType()),
        T.StructField("instructions", T.ArrayType(INNER_INSTRUCTION)),
    ]
)
TX_VIEW = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("signature", T.StringType()),
        T.StructField("tx_index", T.LongType()),
        T.StructField("is_vote", T.BooleanType()),
        T.StructField("account_keys", T.ArrayType(T.StringType())),
        T.StructField("loaded_writable_addresses", T.ArrayType(T.StringType())),
        T.StructField("loaded_readonly_addresses", T.ArrayType(T.StringType())),
        T.StructField("all_accounts", T.ArrayType(T.StringType())),
        T.StructField("outer_instructions", T.ArrayType(OUTER_INSTRUCTION)),
        T.StructField("inner_instruction_groups", T.ArrayType(INNER_GROUP)),
        T.StructField("log_messages", T.ArrayType(T.StringType())),
    ]
)

# --- event envelope -----------------------------------------------------------------

REF_FIELDS = ["mint", "pool", "bonding_curve", "user", "creator", "base_mint", "quote_mint", "lp_mint"]
REFS = T.StructType(_strings(*REF_FIELDS))
INSTRUCTION_PATH = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("outer_index", T.IntegerType()),
        T.StructField("inner_index", T.IntegerType()),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("commitment", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("tx_signature", T.StringType()),
        T.StructField("tx_index", T.LongType()),
        T.StructField("instruction_path", INSTRUCTION_PATH),
        T.StructField("event_source", T.StringType()),
        T.StructField("event_unix_ts", T.LongType()),
        T.StructField("refs", REFS),
        T.StructField("payload", T.StringType()),
    ]
)

# --- payloads; amounts are decimal strings ------------------------------------------

CURVE_TRADE = T.StructType(
    _strings(
        "side", "ix_name", "mint", "user", "bonding_curve", "associated_bonding_curve", "creator",
        "creator_vault", "token_program", "sol_amount", "token_amount", "fee", "creator_fee",
        "virtual_sol_reserves", "virtual_token_reserves", "real_sol_reserves", "real_token_reserves",
    )
    + [T.StructField("track_volume", T.BooleanType()), T.StructField("mayhem_mode", T.BooleanType())]
    + _strings("cashback")
    + [
        T.StructField(
            "instruction_args",
            T.StructType(
                _strings("amount", "max_sol_cost", "min_sol_output", "spendable_sol_in", "min_tokens_out")
            ),
        )
    ]
)
CURVE_CREATE = T.StructType(
    _strings(
        "ix_name", "mint", "bonding_curve", "user", "creator", "name", "symbol", "uri", "token_program",
        "virtual_token_reserves", "virtual_sol_reserves", "real_token_reserves", "token_total_supply",
    )
    + [
        T.StructField("is_mayhem_mode", T.BooleanType()),
        T.StructField("is_cashback_enabled", T.BooleanType()),
        T.StructField("mint_decimals", T.IntegerType()),
    ]
)
CURVE_MIGRATE = T.StructType(
    _strings(
        "mint", "user", "bonding_curve", "pool", "mint_amount", "sol_amount", "pool_migration_fee",
        "withdraw_authority", "associated_bonding_curve", "token_program", "pump_amm", "pool_authority",
        "lp_mint",
    )
)
AMM_SWAP = T.StructType(
    _strings(
        "side", "ix_name", "pool", "user", "base_mint", "quote_mint", "coin_creator", "base_amount_in",
        "base_amount_out", "quote_amount_in", "quote_amount_out", "lp_fee", "protocol_fee",
        "coin_creator_fee", "cashback", "pool_base_token_reserves", "pool_quote_token_reserves",
    )
    + [
        T.StructField(
            "instruction_args",
            T.StructType(
                _strings(
                    "base_amount_in", "min_quote_amount_out", "base_amount_out", "max_quote_amount_in",
                    "spendable_quote_in", "min_base_amount_out",
                )
            ),
        )
    ]
)
AMM_CREATE_POOL = T.StructType(
    _strings(
        "pool", "creator", "base_mint", "quote_mint", "lp_mint", "base_amount_in", "quote_amount_in",
        "initial_liquidity", "coin_creator",
    )
    + [
        T.StructField("is_mayhem_mode", T.BooleanType()),
        T.StructField(
            "instruction_args",
            T.StructType(
                [
                    T.StructField("index", T.IntegerType()),
                    T.StructField("coin_creator", T.StringType()),
                    T.StructField("is_mayhem_mode", T.BooleanType()),
                    T.StructField("is_cashback_coin", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("base_mint_decimals", T.IntegerType()),
        T.StructField("quote_mint_decimals", T.IntegerType()),
    ]
)
AMM_LIQUIDITY = T.StructType(
    _strings(
        "action", "pool", "user", "base_mint", "quote_mint", "lp_mint", "lp_token_amount_in",
        "lp_token_amount_out", "base_amount_in", "quote_amount_in", "base_amount_out", "quote_amount_out",
        "lp_mint_supply",
    )
    + [
        T.StructField(
            "instruction_args",
            T.StructType(
                _strings(
                    "lp_token_amount_in", "lp_token_amount_out", "max_base_amount_in", "max_quote_amount_in",
                    "min_base_amount_out", "min_quote_amount_out",
                )
            ),
        )
    ]
)
