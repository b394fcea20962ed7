"""Discriminators, byte layouts and account positions of the two programs.

A layout is read after the 8-byte discriminator. Types: key (32 bytes), u8, u16, u64, i64
(little-endian), bool (any non-zero byte), flag (0 or 1, anything else voids the record),
flag? (0 or 1, else absent), str (u32 length, then UTF-8).
"""

from __future__ import annotations

from ..constants import AMM_PROGRAM, CURVE_PROGRAM

# event kind -> discriminators
EVENT_DISCRIMINATORS = {
    "curve_trade": [[189, 219, 127, 211, 78, 230, 97, 238]],
    "curve_create": [[27, 114, 169, 77, 222, 235, 99, 118], [90, 133, 138, 45, 185, 75, 7, 42]],
    "curve_migrate": [[189, 233, 93, 185, 92, 148, 234, 148]],
    "amm_buy": [[103, 244, 82, 31, 44, 245, 119, 119]],
    "amm_sell": [[62, 47, 55, 10, 165, 3, 220, 42]],
    "amm_create_pool": [[177, 49, 12, 210, 160, 118, 167, 116]],
    "amm_deposit": [[120, 248, 61, 83, 31, 142, 107, 144]],
    "amm_withdraw": [[22, 9, 133, 26, 160, 44, 71, 192]],
}

# these must end where the layout ends; the others may carry more bytes
EXACT_EVENTS = ["amm_buy", "amm_sell", "amm_create_pool", "amm_deposit", "amm_withdraw"]

EVENT_LAYOUTS = {
    "curve_trade": """
        mint:key sol_amount:u64 token_amount:u64 is_buy:bool user:key timestamp:i64
        virtual_sol_reserves:u64 virtual_token_reserves:u64 real_sol_reserves:u64 real_token_reserves:u64
        fee_recipient:key fee_basis_points:u64 fee:u64 creator:key creator_fee_basis_points:u64 creator_fee:u64
        track_volume:bool total_unclaimed_tokens:u64 total_claimed_tokens:u64 current_sol_volume:u64
        last_update_timestamp:i64 ix_name:str mayhem_mode:bool cashback_fee_basis_points:u64 cashback:u64
    """,
    "curve_create": """
        name:str symbol:str uri:str mint:key bonding_curve:key user:key creator:key timestamp:i64
        virtual_token_reserves:u64 virtual_sol_reserves:u64 real_token_reserves:u64 token_total_supply:u64
        token_program:key is_mayhem_mode:bool is_cashback_enabled:bool
    """,
    "curve_migrate": """
        user:key mint:key mint_amount:u64 sol_amount:u64 pool_migration_fee:u64 bonding_curve:key timestamp:i64 pool:key
    """,
    "amm_buy": """
        timestamp:i64 base_amount_out:u64 max_quote_amount_in:u64 user_base_token_reserves:u64
        user_quote_token_reserves:u64 pool_base_token_reserves:u64 pool_quote_token_reserves:u64 quote_amount_in:u64
        lp_fee_basis_points:u64 lp_fee:u64 protocol_fee_basis_points:u64 protocol_fee:u64
        quote_amount_in_with_lp_fee:u64 user_quote_amount_in:u64 pool:key user:key user_base_token_account:key
        user_quote_token_account:key protocol_fee_recipient:key protocol_fee_recipient_token_account:key
        coin_creator:key coin_creator_fee_basis_points:u64 coin_creator_fee:u64 track_volume:bool
        total_unclaimed_tokens:u64 total_claimed_tokens:u64 current_sol_volume:u64 last_update_timestamp:i64
        min_base_amount_out:u64 ix_name:str cashback_fee_basis_points:u64 cashback:u64
    """,
    "amm_sell": """
        timestamp:i64 base_amount_in:u64 min_quote_amount_out:u64 user_base_token_reserves:u64
        user_quote_token_reserves:u64 pool_base_token_reserves:u64 pool_quote_token_reserves:u64 quote_amount_out:u64
        lp_fee_basis_points:u64 lp_fee:u64 protocol_fee_basis_points:u64 protocol_fee:u64
        quote_amount_out_without_lp_fee:u64 user_quote_amount_out:u64 pool:key user:key user_base_token_account:key
        user_quote_token_account:key protocol_fee_recipient:key protocol_fee_recipient_token_account:key
        coin_creator:key coin_creator_fee_basis_points:u64 coin_creator_fee:u64 cashback_fee_basis_points:u64 cashback:u64
    """,
    "amm_create_pool": """
        timestamp:i64 index:u16 creator:key base_mint:key quote_mint:key base_mint_decimals:u8 quote_mint_decimals:u8
        base_amount_in:u64 quote_amount_in:u64 pool_base_amount:u64 pool_quote_amount:u64 minimum_liquidity:u64
        initial_liquidity:u64 lp_token_amount_out:u64 pool_bump:u8 pool:key lp_mint:key user_base_token_account:key
        user_quote_token_account:key coin_creator:key is_mayhem_mode:bool
    """,
    "amm_deposit": """
        timestamp:i64 lp_token_amount_out:u64 max_base_amount_in:u64 max_quote_amount_in:u64
        user_base_token_reserves:u64 user_quote_token_reserves:u64 pool_base_token_reserves:u64
        pool_quote_token_reserves:u64 base_amount_in:u64 quote_amount_in:u64 lp_mint_supply:u64 pool:key user:key
        user_base_token_account:key user_quote_token_account:key user_pool_token_account:key
    """,
    "amm_withdraw": """
        timestamp:i64 lp_token_amount_in:u64 min_base_amount_out:u64 min_quote_amount_out:u64
        user_base_token_reserves:u64 user_quote_token_reserves:u64 pool_base_token_reserves:u64
        pool_quote_token_reserves:u64 base_amount_out:u64 quote_amount_out:u64 lp_mint_supply:u64 pool:key user:key
        user_base_token_account:key user_quote_token_account:key user_pool_token_account:key
    """,
}

# instruction kind -> (program, discriminator)
INSTRUCTION_DISCRIMINATORS = {
    "curve_buy": (CURVE_PROGRAM, [102, 6, 61, 18, 1, 218, 235, 234]),
    "curve_sell": (CURVE_PROGRAM, [51, 230, 133, 164, 1, 127, 131, 173]),
    "curve_buy_exact_sol_in": (CURVE_PROGRAM, [56, 252, 116, 8, 158, 223, 205, 95]),
    "curve_create": (CURVE_PROGRAM, [24, 30, 200, 40, 5, 28, 7, 119]),
    "curve_create_v2": (CURVE_PROGRAM, [214, 144, 76, 236, 95, 139, 49, 180]),
    "curve_migrate": (CURVE_PROGRAM, [155, 234, 231, 146, 236, 158, 162, 30]),
    "amm_buy": (AMM_PROGRAM, [102, 6, 61, 18, 1, 218, 235, 234]),
    "amm_buy_exact_quote_in": (AMM_PROGRAM, [198, 46, 21, 82, 180, 217, 232, 112]),
    "amm_sell": (AMM_PROGRAM, [51, 230, 133, 164, 1, 127, 131, 173]),
    "amm_create_pool": (AMM_PROGRAM, [233, 146, 209, 142, 207, 104, 64, 188]),
    "amm_deposit": (AMM_PROGRAM, [242, 35, 198, 137, 82, 225, 242, 182]),
    "amm_withdraw": (AMM_PROGRAM, [183, 18, 70, 156, 148, 109, 161, 34]),
}

INSTRUCTION_LAYOUTS = {
    "curve_buy": "amount:u64 max_sol_cost:u64 track_volume:flag?",
    "curve_sell": "amount:u64 min_sol_output:u64",
    "curve_buy_exact_sol_in": "spendable_sol_in:u64 min_tokens_out:u64 track_volume:flag?",
    "curve_create": "name:str symbol:str uri:str creator:key",
    "curve_create_v2": "name:str symbol:str uri:str creator:key is_mayhem_mode:flag is_cashback_enabled:flag?",
    "curve_migrate": "",
    "amm_buy": "base_amount_out:u64 max_quote_amount_in:u64 track_volume:flag?",
    "amm_buy_exact_quote_in": "spendable_quote_in:u64 min_base_amount_out:u64 track_volume:flag?",
    "amm_sell": "base_amount_in:u64 min_quote_amount_out:u64",
    "amm_create_pool": """
        index:u16 base_amount_in:u64 quote_amount_in:u64 coin_creator:key is_mayhem_mode:flag is_cashback_coin:flag?
    """,
    "amm_deposit": "lp_token_amount_out:u64 max_base_amount_in:u64 max_quote_amount_in:u64",
    "amm_withdraw": "lp_token_amount_in:u64 min_base_amount_out:u64 min_quote_amount_out:u64",
}

# account roles by position
CURVE_BUY_ACCOUNTS = """
    global fee_recipient mint bonding_curve associated_bonding_curve associated_user user system_program
    token_program creator_vault event_authority program global_volume_accumulator user_volume_accumulator
    fee_config fee_program
"""
AMM_BUY_ACCOUNTS = """
    pool user global_config base_mint quote_mint user_base_token_account user_quote_token_account
    pool_base_token_account pool_quote_token_account protocol_fee_recipient protocol_fee_recipient_token_account
    base_token_program quote_token_program system_program associated_token_program event_authority program
    coin_creator_vault_ata coin_creator_vault_authority global_volume_accumulator user_volume_accumulator
    fee_config fee_program
"""
LIQUIDITY_ACCOUNTS = """
    pool global_config user base_mint quote_mint lp_mint user_base_token_account user_quote_token_account
    user_pool_token_account pool_base_token_account pool_quote_token_account token_program token_2022_program
    event_authority program
"""
INSTRUCTION_ACCOUNTS = {
    "curve_buy": CURVE_BUY_ACCOUNTS,
    "curve_sell": """
        global fee_recipient mint bonding_curve associated_bonding_curve associated_user user system_program
        creator_vault token_program event_authority program fee_config fee_program
    """,
    "curve_buy_exact_sol_in": CURVE_BUY_ACCOUNTS,
    "curve_create": """
        mint mint_authority bonding_curve associated_bonding_curve global mpl_token_metadata metadata user
        system_program token_program associated_token_program rent event_authority program
    """,
    "curve_create_v2": """
        mint mint_authority bonding_curve associated_bonding_curve global user system_program token_program
        associated_token_program mayhem_program_id global_params sol_vault mayhem_state mayhem_token_vault
        event_authority program
    """,
    "curve_migrate": """
        global withdraw_authority mint bonding_curve associated_bonding_curve user system_program token_program
        pump_amm pool pool_authority pool_authority_mint_account pool_authority_wsol_account amm_global_config
        wsol_mint lp_mint user_pool_token_account pool_base_token_account pool_quote_token_account
        token_2022_program associated_token_program pump_amm_event_authority event_authority program
    """,
    "amm_buy": AMM_BUY_ACCOUNTS,
    "amm_buy_exact_quote_in": AMM_BUY_ACCOUNTS,
    "amm_sell": """
        pool user global_config base_mint quote_mint user_base_token_account user_quote_token_account
        pool_base_token_account pool_quote_token_account protocol_fee_recipient protocol_fee_recipient_token_account
        base_token_program quote_token_program system_program associated_token_program event_authority program
        coin_creator_vault_ata coin_creator_vault_authority fee_config fee_program
    """,
    "amm_create_pool": """
        pool global_config creator base_mint quote_mint lp_mint user_base_token_account user_quote_token_account
        user_pool_token_account pool_base_token_account pool_quote_token_account system_program token_2022_program
        base_token_program quote_token_program associated_token_program event_authority program
    """,
    "amm_deposit": LIQUIDITY_ACCOUNTS,
    "amm_withdraw": LIQUIDITY_ACCOUNTS,
}

# instructions that need fewer accounts than they name
ACCOUNTS_NEEDED = {"curve_create_v2": 1}
