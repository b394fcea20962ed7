"""Envelopes from their wire form: enumerations as numbers, the payload as one of seven fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from .messages import Message, message, read_messages

# payload field of the message -> its type
VARIANTS: dict[str, T.StructType] = {
    "pumpfun_trade": schemas.CURVE_TRADE,
    "pumpfun_create": schemas.CURVE_CREATE,
    "pumpfun_migrate": schemas.CURVE_MIGRATE,
    "pumpamm_swap": schemas.AMM_SWAP,
    "pumpamm_create_pool": schemas.AMM_CREATE_POOL,
    "pumpamm_deposit": schemas.AMM_LIQUIDITY,
    "pumpamm_withdraw": schemas.AMM_LIQUIDITY,
}
WIRE = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        *(T.StructField(n, T.IntegerType()) for n in ("chain", "protocol", "event_type", "commitment")),
        T.StructField("slot", T.LongType()),
        T.StructField("tx_signature", T.StringType()),
        T.StructField("tx_index", T.LongType()),
        T.StructField(
            "instruction_path",
            T.StructType([T.StructField(n, T.IntegerType()) for n in ("source", "outer_index", "inner_index")]),
        ),
        T.StructField("event_source", T.IntegerType()),
        T.StructField("event_unix_ts", T.LongType()),
        T.StructField("refs", schemas.REFS),
        *(T.StructField(n, t) for n, t in VARIANTS.items()),
    ]
)


def enum_name(number: Column, names: list[str]) -> Column:
    """Name of an enumeration value; unknown numbers give ''."""
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), F.coalesce(number, F.lit(0))), F.lit(""))


def from_wire(df: DataFrame, column: str = "event", keep: Sequence[str] = (), why: Column | None = None) -> DataFrame:
    """Envelope columns and ``error`` from a struct in wire form, behind the columns to ``keep``.

    ``why`` tells rows that have no message at all; their columns are null.
    """
    e = lambda n: F.col(f"{column}.{n}")

    def named(number: Column, names: list[str]) -> Column:
        return F.when(F.col(column).isNotNull(), enum_name(number, names))

    path = e("instruction_path")
    bare = F.lit(True)
    for v in VARIANTS:
        bare = bare & e(v).isNull()
    error = F.when(path.isNull(), "instruction path missing").when(bare, "unsupported payload")
    if why is not None:
        error = F.coalesce(why, error)
    payload = F.coalesce(*(F.to_json(e(v), {"ignoreNullFields": "false"}) for v in VARIANTS))
    return df.select(
        *keep,
        e("schema_version"),
        e("event_id"),
        named(e("chain"), C.CHAIN_NAMES).alias("chain"),
        named(e("protocol"), C.PROTOCOL_NAMES).alias("protocol"),
        named(e("event_type"), C.EVENT_TYPE_NAMES).alias("event_type"),
        named(e("commitment"), C.COMMITMENT_NAMES).alias("commitment"),
        e("slot"),
        e("tx_signature"),
        e("tx_index"),
        F.struct(
            named(path["source"], C.INSTRUCTION_SOURCE_NAMES).alias("source"),
            F.coalesce(path["outer_index"], F.lit(0)).alias("outer_index"),
            path["inner_index"].alias("inner_index"),
        ).alias("instruction_path"),
        named(e("event_source"), C.EVENT_ORIGIN_NAMES).alias("event_source"),
        e("event_unix_ts"),
        e("refs"),
        payload.alias("payload"),
        error.alias("error"),
    )


def read_json_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from the message's JSON form."""
    return from_wire(df.select(F.inline(F.array(F.struct(F.from_json(column, WIRE).alias("event"))))))


def _struct(of: T.StructType, name: str) -> T.StructType:
    return of[name].dataType


def envelope_message() -> Message:
    """Field numbers, and the fields whose absence is null, as on the wire."""
    args = {
        name: {"instruction_args": message(_struct(kind, "instruction_args"), None)}
        for name, kind in VARIANTS.items()
        if "instruction_args" in kind.names
    }
    # fixed values
    args["pumpamm_create_pool"] = {"instruction_args": message(_struct(schemas.AMM_CREATE_POOL, "instruction_args"), ("is_cashback_coin",))}
    swap = ("base_amount_in", "base_amount_out", "quote_amount_in", "quote_amount_out")
    tracked = {
        "pumpfun_create": ("mint_decimals",),
        "pumpamm_swap": swap,
        "pumpamm_deposit": ("lp_token_amount_in", "lp_token_amount_out", *swap),
        "pumpamm_withdraw": ("lp_token_amount_in", "lp_token_amount_out", *swap),
    }
    first_variant = 20
    nested = {name: message(kind, tracked.get(name, ()), args.get(name)) for name, kind in VARIANTS.items()}
    nested["instruction_path"] = message(_struct(WIRE, "instruction_path"), ("inner_index",))
    nested["refs"] = message(schemas.REFS, None)
    return message(WIRE, (), nested, {name: first_variant + k for k, name in enumerate(VARIANTS)}, list(VARIANTS))


def read_proto_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from binary messages, behind the other columns of ``df``.

    A null or malformed message (cut off, a bad tag, text that is not UTF-8) is a row of nulls
    with the reason in ``error``.
    """
    read = read_messages(df, envelope_message(), column)
    others = [c for c in read.columns if c not in ("event", "malformed")]
    why = F.when(F.col("malformed"), "malformed message").when(F.col("event").isNull(), "message missing")
    return from_wire(read, keep=others, why=why)


def read_proto_events_by_package(df: DataFrame, descriptor: bytes, column: str = "value", message: str = "serviceevent.v1.EventEnvelope") -> DataFrame:
    """The same by Spark's protobuf package, where it is on the class path; needs the message's descriptor set."""
    from pyspark.sql.protobuf.functions import from_protobuf

    event = from_protobuf(F.col(column), message, binaryDescriptorSet=descriptor, options={"enums.as.ints": "true"})
    return from_wire(df.select(event.alias("event")))
