"""The given tables as binary transactions, built by Spark expressions, for the decoding checks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CURVE_PROGRAM, TOKEN_PROGRAM
from ..operators.decode import ALPHABET, EVENT_LAYOUTS, INSTRUCTION_LAYOUTS, SIZES
from ..sources import layouts as L
from ..sources.messages import SPAN, VARINT, Message, wire_type
from . import bindings as B

col = F.col


def _hex_le(number: Column, size: int) -> Column:
    text = F.lpad(F.hex(number.cast("bigint")), 2 * size, "0")
    text = F.right(text, F.lit(2 * size))
    return F.reverse(F.regexp_replace(text, "(.)(.)", "$2$1"))


def key_hex(number: Column) -> Column:
    """A 32-byte key holding a small number; as text it is ones, then that number."""
    return F.lpad(F.hex(number.cast("bigint")), 64, "0")


def record(disc: list[int], fields: list[tuple[str, str]], values: dict[str, Column]) -> Column:
    """Bytes of a layout; fields without a value are zero or empty."""
    parts: list[Column] = [F.lit(bytes(disc).hex().upper())]
    for name, type_ in fields:
        value = values.get(name)
        if type_ == "key":
            parts.append(key_hex(value if value is not None else F.lit(0)))
        elif type_ == "str":
            text = value if value is not None else F.lit("")
            parts.append(F.concat(_hex_le(F.length(text.cast("binary")), 4), F.hex(text.cast("binary"))))
        else:
            number = F.lit(0) if value is None else value
            parts.append(_hex_le(number.cast("bigint"), SIZES[type_]))
    return F.unhex(F.concat(*parts))


def event_record(kind: str, values: dict[str, Column], version: int = 0) -> Column:
    return record(L.EVENT_DISCRIMINATORS[kind][version], EVENT_LAYOUTS[kind], values)


def instruction_record(kind: str, values: dict[str, Column]) -> Column:
    return record(L.INSTRUCTION_DISCRIMINATORS[kind][1], INSTRUCTION_LAYOUTS[kind], values)


def base58_small(number: Column) -> Column:
    """Text of a key that holds a number from 1 to 57."""
    return F.concat(F.lit("1" * 31), F.substring(F.lit(ALPHABET), (number + 1).cast("int"), F.lit(1)))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    log = B.ev_log(spark, sf)
    return log.withColumn("mint_no", F.expr("CAST(substring(asset_id, 2) AS BIGINT)") % 50 + 1).withColumn(
        "user_no", F.expr("CAST(substring(user_address, 2) AS BIGINT)") % 50 + 1
    )


def trade_events(spark: SparkSession, sf: str) -> DataFrame:
    """One binary trade event per trade; a few are cut short."""
    t = _numbered(spark, sf).where("kind = 'trade'")
    is_buy = (col("side") != "sell").cast("int")
    data = event_record(
        "curve_trade",
        {
            "mint": col("mint_no"), "sol_amount": col("quote_amount_raw"), "token_amount": col("token_amount_raw"), "is_buy": is_buy,
            "user": col("user_no"), "timestamp": col("event_unix_ts"), "virtual_sol_reserves": col("log_id") * 3 - 7000,
            "ix_name": col("side"), "cashback": col("slot"),
        },
    )
    cut = F.when(col("log_id") % 53 == 0, F.substring(data, 1, 200)).otherwise(data)
    # kept apart so that the bytes are built once, as a stored column would be read once
    return t.select("log_id", F.inline(F.array(F.struct(cut.alias("data")))))


def tx_views(spark: SparkSession, sf: str) -> DataFrame:
    """Four log entries per transaction: trades and creates as instructions with their events.

    Trades are outer instructions whose event is a log line; creates are inner calls with
    the event as an inner call too, followed by the mint's initialisation. Every ninth
    trade lacks its event, and every event line comes twice.
    """
    t = _numbered(spark, sf).where("kind <> 'migrate'")
    mint, user = base58_small(col("mint_no")), base58_small(col("user_no"))
    is_buy = (col("side") != "sell").cast("int")
    trade = event_record(
        "curve_trade",
        {"mint": col("mint_no"), "sol_amount": col("quote_amount_raw"), "token_amount": col("token_amount_raw"), "is_buy": is_buy,
         "user": col("user_no"), "timestamp": col("event_unix_ts"), "ix_name": col("side")},
    )
    name = F.concat(F.lit("näme "), col("user_address"))
    create = event_record(
        "curve_create",
        {"name": name, "symbol": col("user_address"), "uri": F.lit("ipfs://x"), "mint": col("mint_no"), "bonding_curve": F.lit(5),
         "user": col("user_no"), "creator": col("user_no"), "timestamp": col("event_unix_ts"), "token_total_supply": col("log_id")},
    )
    args = {"amount": col("token_amount_raw"), "max_sol_cost": col("quote_amount_raw"), "spendable_sol_in": col("token_amount_raw")}
    call = F.when(col("side") == "buy", instruction_record("curve_buy", args)).when(
        col("side") == "sell", instruction_record("curve_sell", args)
    ).when(col("side") == "buy_exact_sol_in", instruction_record("curve_buy_exact_sol_in", args))
    make = instruction_record("curve_create", {"name": name, "symbol": col("user_address"), "uri": F.lit("ipfs://x"), "creator": col("user_no")})

    # kept apart so that the bytes of a record are built once
    built = F.struct(trade.alias("trade_bytes"), create.alias("create_bytes"), call.alias("call_bytes"), make.alias("make_bytes"))
    t = t.select("*", F.inline(F.array(built)))
    trade, create, call, make = (col(f"{n}_bytes") for n in ("trade", "create", "call", "make"))

    def accounts(kind: str) -> Column:
        known = {"mint": mint, "user": user, "bonding_curve": F.lit("1" * 31 + "6")}
        return F.array(*(known.get(r, F.lit(r)) for r in L.INSTRUCTION_ACCOUNTS[kind].split()))

    def step(program: str, keys: Column, data: Column) -> Column:
        return F.struct(
            F.lit(0).alias("program_id_index"), F.lit(program).alias("program_id"), F.array().cast("array<int>").alias("account_indices"),
            keys.alias("account_pubkeys"), F.length(data).alias("data_len"), F.array().cast("array<int>").alias("data_prefix"),
            F.base64(data).alias("data_base64"),
        )

    names = F.when(col("side") == "sell", accounts("curve_sell")).otherwise(accounts("curve_buy"))
    outer = F.when(col("kind") == "trade", step(CURVE_PROGRAM, names, call)).otherwise(step("router", F.array().cast("array<string>"), F.lit(b"\0")))
    wrapped = F.unhex(F.concat(F.lit("E445A52E51CB9A1D"), F.hex(create)))
    init = F.unhex(F.concat(F.lit("14"), _hex_le(col("log_id") % 10, 1)))
    inner = F.array(
        step(CURVE_PROGRAM, accounts("curve_create"), make),
        step(CURVE_PROGRAM, F.array().cast("array<string>"), wrapped),
        step(TOKEN_PROGRAM, F.array(mint), init),
    )
    line = F.concat(F.lit("Program data: "), F.base64(trade))
    lines = F.when((col("kind") == "trade") & (col("log_id") % 9 != 0), F.array(line, F.lit("Program log: x"), line)).otherwise(F.array().cast("array<string>"))
    rows = t.select("slot", "log_id", F.struct(outer.alias("call"), F.when(col("kind") == "create", inner).alias("calls"), lines.alias("lines")).alias("x"))
    packed = rows.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("log_id", "x"))).alias("xs"))
    groups = F.transform("xs", lambda r, i: F.struct(i.alias("outer_instruction_index"), r.x.calls.alias("instructions")))
    none = F.array().cast("array<string>")
    return packed.select(
        "slot",
        F.concat(F.lit("t"), col("slot").cast("string")).alias("signature"),
        F.lit(0).cast("bigint").alias("tx_index"),
        F.lit(False).alias("is_vote"),
        none.alias("account_keys"), none.alias("loaded_writable_addresses"), none.alias("loaded_readonly_addresses"),
        none.alias("all_accounts"),
        F.transform("xs", lambda r: r.x.call).alias("outer_instructions"),
        F.filter(groups, lambda g: g.instructions.isNotNull()).alias("inner_instruction_groups"),
        F.flatten(F.transform("xs", lambda r: r.x.lines)).alias("log_messages"),
    )


# --- binary messages ----------------------------------------------------------------


def varint(number: int) -> bytes:
    number &= (1 << 64) - 1
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes(out) + bytes([number])


def message_bytes(value: dict, kind: Message) -> bytes:
    """The wire form of a nested dict: fields that are null are left out, and untracked zeros, too."""
    out = bytearray()
    for f in kind.fields:
        held = value.get(f.name)
        if held is None or not f.tracked and not held:
            continue
        if wire_type(f) == VARINT:
            out += varint(f.number << 3 | VARINT) + varint(int(held))
            continue
        body = message_bytes(held, f.message) if f.message is not None else held.encode()
        out += varint(f.number << 3 | SPAN) + varint(len(body)) + body
    return bytes(out)


def to_messages(df: DataFrame, kind: Message, column: str = "value") -> DataFrame:
    """JSON text in ``column`` as binary messages; other columns stay."""
    schema = T.StructType([f if f.name != column else T.StructField(column, T.BinaryType()) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = pa.array([message_bytes(json.loads(x), kind) for x in batch.column(column).to_pylist()], pa.binary())
            columns = [body if c == column else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)
