"""Synthetic transactions: bytes built here, decoded and paired by the job."""

import base64
import json
import struct

import pytest

from tickloom.constants import AMM_PROGRAM, CURVE_PROGRAM
from tickloom.operators.decode import ALPHABET, EVENT_LAYOUTS, INSTRUCTION_LAYOUTS, base58, decode_events, decode_instructions, extract_decimals, instruction_census
from tickloom.operators.envelope import parse_transactions
from tickloom.schemas import TX_VIEW
from tickloom.sources import layouts as L
from tickloom.sources.txviews import event_bytes, explode_instructions, read_tx_views


def key(n):
    return bytes(31) + bytes([n])


def pack(disc, fields, values):
    out = bytes(disc)
    for name, type_ in fields:
        v = values.get(name, 0)
        if type_ == "key":
            out += key(v)
        elif type_ == "str":
            raw = (v or "").encode()
            out += struct.pack("<I", len(raw)) + raw
        elif type_ == "flag?" and name not in values:
            pass
        else:
            out += struct.pack({"u8": "<B", "bool": "<B", "flag": "<B", "flag?": "<B", "u16": "<H", "u64": "<Q", "i64": "<q"}[type_], v)
    return out


def event(kind, version=0, **values):
    return pack(L.EVENT_DISCRIMINATORS[kind][version], EVENT_LAYOUTS[kind], values)


def args(kind, **values):
    return pack(L.INSTRUCTION_DISCRIMINATORS[kind][1], INSTRUCTION_LAYOUTS[kind], values)


def keys_of(kind, **roles):
    return [base58(key(roles[r])) if r in roles else r for r in L.INSTRUCTION_ACCOUNTS[kind].split()]


def step(program, accounts, data):
    return {"program_id_index": 0, "program_id": program, "account_indices": [], "account_pubkeys": accounts, "data_len": len(data),
            "data_prefix": list(data[:16]), "data_base64": base64.b64encode(data).decode()}


def view(outer, inner=None, logs=(), signature="sig"):
    groups = [{"outer_instruction_index": i, "instructions": g} for i, g in (inner or {}).items()]
    return {"slot": 7, "signature": signature, "tx_index": 3, "is_vote": False, "account_keys": [], "loaded_writable_addresses": [],
            "loaded_readonly_addresses": [], "all_accounts": [], "outer_instructions": outer, "inner_instruction_groups": groups,
            "log_messages": ["Program data: " + base64.b64encode(x).decode() if isinstance(x, bytes) else x for x in logs]}


@pytest.fixture
def load(spark, tmp_path):
    def run(*views):
        (tmp_path / "views.json").write_text(json.dumps(list(views)))
        return read_tx_views(spark, str(tmp_path / "views.json"))

    return run


OTHER = step("other", [], b"\0")


def buy(mint=1, user=2, amount=5, **more):
    return step(CURVE_PROGRAM, keys_of("curve_buy", mint=mint, user=user), args("curve_buy", amount=amount, **more))


def bought(mint=1, user=2, **more):
    return event("curve_trade", mint=mint, user=user, is_buy=1, ix_name="buy", **more)


def test_base58():
    assert base58(key(0)) == "1" * 32 and base58(key(57)) == "1" * 31 + ALPHABET[57] and base58(b"\1\0") == "5R"


def test_direct_trade_from_a_log_line(load):
    row = parse_transactions(load(view([buy()], logs=[bought(sol_amount=2**64 - 1, timestamp=-5)]))).first()
    assert row.event_id == "solana:pumpfun:trade:sig:outer:0" and row.event_unix_ts == -5 and row.event_source == "logs"
    payload = json.loads(row.payload)
    assert payload["sol_amount"] == str(2**64 - 1) and payload["side"] == "buy" and payload["instruction_args"]["amount"] == "5"
    assert payload["instruction_args"]["min_sol_output"] is None and row.refs.mint == base58(key(1))


def test_same_event_as_log_and_as_inner_call_counts_once(load):
    wrapped = step(CURVE_PROGRAM, [], b"12345678" + bought())
    rows = parse_transactions(load(view([buy(), buy()], {0: [wrapped], 1: [wrapped]}, [bought()]))).collect()
    assert [r.event_id for r in rows] == ["solana:pumpfun:trade:sig:outer:0"]


def test_inner_trade_and_event_behind_an_eight_byte_prefix(load):
    wrapped = step(CURVE_PROGRAM, [], b"12345678" + bought())
    row = parse_transactions(load(view([OTHER], {0: [buy(), wrapped]}))).first()
    assert row.event_id == "solana:pumpfun:trade:sig:inner:0:0" and row.event_source == "inner_cpi"


def test_an_event_of_a_later_group_is_not_seen_yet(load):
    wrapped = step(CURVE_PROGRAM, [], bought())
    assert parse_transactions(load(view([buy(), OTHER], {1: [wrapped]}))).count() == 0
    assert parse_transactions(load(view([OTHER, buy()], {0: [wrapped]}))).count() == 1


def test_two_trades_take_events_in_order(load):
    rows = parse_transactions(load(view([buy(), buy(), buy()], logs=[bought(sol_amount=1), bought(sol_amount=2)]))).collect()
    got = {r.event_id[-1]: json.loads(r.payload)["sol_amount"] for r in rows}
    assert got == {"0": "1", "1": "2"}


def test_leftover_group_runs_last(load):
    rows = parse_transactions(load(view([buy()], {5: [buy()]}, [bought(sol_amount=1), bought(sol_amount=2)]))).collect()
    assert {r.event_id: json.loads(r.payload)["sol_amount"] for r in rows} == {
        "solana:pumpfun:trade:sig:outer:0": "1", "solana:pumpfun:trade:sig:inner:5:0": "2",
    }


def test_short_and_long_buffers(load):
    sell = event("amm_sell", pool=3, user=4, base_amount_in=9)
    df = decode_events(event_bytes(load(view([], logs=[bought()[:-1], bought() + b"\0", sell, sell + b"\0", sell[:-1], b"12345678xx"]))))
    assert [(r.kind, r.event is not None) for r in df.orderBy("seen_at").collect()] == [
        ("curve_trade", False), ("curve_trade", True), ("amm_sell", True), ("amm_sell", False), ("amm_sell", False),
    ]


def test_broken_text_voids_the_event(load):
    good = event("curve_create", name="ab")
    bad = good.replace(b"ab", b"\xff\xfe")
    huge = good[:8] + b"\xff\xff\xff\xff" + good[12:]
    df = decode_events(event_bytes(load(view([], logs=[good, bad, huge]))))
    assert [r.event is not None for r in df.orderBy("seen_at").collect()] == [True, False, False]


def test_missing_account_voids_all_but_create_v2(load):
    full, short = keys_of("curve_sell"), keys_of("curve_sell")[:-1]
    v2 = args("curve_create_v2", name="a", symbol="b", uri="c", creator=9, is_mayhem_mode=1)
    ix = [step(CURVE_PROGRAM, a, args("curve_sell")) for a in (full, short)]
    ix += [step(CURVE_PROGRAM, ["mint"], v2), step(CURVE_PROGRAM, [], v2), step(CURVE_PROGRAM, ["mint"], v2[:-1] + b"\7")]
    rows = decode_instructions(explode_instructions(load(view(ix)))).orderBy("outer_index").collect()
    assert [r.args is not None for r in rows] == [True, False, True, False, False]
    assert rows[2].accounts["mint"] == "mint" and rows[2].accounts["user"] is None and rows[2].args.is_cashback_enabled is None


def test_create_v2_matches_with_absent_fields(load):
    named = dict(name="a", symbol="b", uri="c", creator=9)
    made = event("curve_create", version=1, mint=1, user=2, bonding_curve=3, is_mayhem_mode=1, is_cashback_enabled=1, **named)
    bare = step(CURVE_PROGRAM, [base58(key(1))], args("curve_create_v2", is_mayhem_mode=1, **named))
    wrong = step(CURVE_PROGRAM, keys_of("curve_create_v2", mint=1, user=8, bonding_curve=3), args("curve_create_v2", is_mayhem_mode=1, **named))
    other = step(CURVE_PROGRAM, [base58(key(1))], args("curve_create_v2", is_mayhem_mode=0, **named))
    init = step("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", [base58(key(1))], bytes([20, 6]))
    df = load(view([wrong, other, bare], {2: [init]}, [made]))
    row = parse_transactions(df).first()
    assert row.event_id.endswith("outer:2") and json.loads(row.payload)["mint_decimals"] == 6 and json.loads(row.payload)["ix_name"] == "create_v2"
    assert extract_decimals(explode_instructions(df)).first().mint_decimals == 6
    census = instruction_census(explode_instructions(df), event_bytes(df)).first()
    assert (census.curve_create_v2_ix, census.curve_create_v2_parseable_ix, census.curve_create_event_bytes) == (3, 3, 1)


def test_pool_events(load):
    mints = dict(base_mint=5, quote_mint=6)
    ix = [
        step(AMM_PROGRAM, keys_of("amm_create_pool", pool=3, creator=4, lp_mint=7, **mints), args("amm_create_pool", index=2, base_amount_in=10, quote_amount_in=20, coin_creator=8, is_mayhem_mode=0)),
        step(AMM_PROGRAM, keys_of("amm_buy", pool=3, user=4, **mints), args("amm_buy_exact_quote_in", spendable_quote_in=30, min_base_amount_out=1, track_volume=1)),
        step(AMM_PROGRAM, keys_of("amm_deposit", pool=3, user=4, lp_mint=7, **mints), args("amm_deposit", lp_token_amount_out=1, max_base_amount_in=2, max_quote_amount_in=3)),
        step(AMM_PROGRAM, keys_of("amm_withdraw", pool=3, user=4, lp_mint=7, **mints), args("amm_withdraw", lp_token_amount_in=1)),
    ]
    logs = [
        event("amm_withdraw", pool=3, user=4, lp_token_amount_in=1, base_amount_out=11),
        event("amm_deposit", pool=3, user=4, lp_token_amount_out=1, max_base_amount_in=2, max_quote_amount_in=3, base_amount_in=2),
        event("amm_buy", pool=3, user=4, max_quote_amount_in=30, min_base_amount_out=1, ix_name="buy_exact_quote_in", track_volume=0),
        event("amm_buy", pool=3, user=4, max_quote_amount_in=30, min_base_amount_out=1, ix_name="buy_exact_quote_in", track_volume=1, quote_amount_in=29),
        event("amm_create_pool", pool=3, creator=4, coin_creator=8, base_amount_in=10, quote_amount_in=20, lp_mint=7, base_mint_decimals=6, **mints),
    ]
    rows = {r.event_type: r for r in parse_transactions(load(view(ix, logs=logs))).collect()}
    assert set(rows) == {"create_pool", "swap", "deposit", "withdraw"}
    assert json.loads(rows["swap"].payload)["quote_amount_in"] == "29" and rows["swap"].refs.mint is None
    made = json.loads(rows["create_pool"].payload)
    assert made["instruction_args"]["index"] == 2 and made["base_mint_decimals"] == 6 and rows["create_pool"].refs.creator == base58(key(4))
    assert json.loads(rows["withdraw"].payload)["base_amount_out"] == "11" and rows["deposit"].refs.lp_mint == base58(key(7))


def test_schema_reads_every_field(load):
    assert load(view([OTHER])).schema.fieldNames() == TX_VIEW.fieldNames()
