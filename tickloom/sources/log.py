"""The append-only event log: typed payloads, insert-once append, routing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..constants import AMM, CURVE
from ..functions.scalars import empty_to_null, orient_swap, tracked_asset
from ..operators.common import first_per_key

# payload column -> (protocol, event types, schema)
PAYLOADS: dict[str, tuple[str, tuple[str, ...], T.StructType]] = {
    "curve_trade": (CURVE, ("trade",), schemas.CURVE_TRADE),
    "curve_create": (CURVE, ("create",), schemas.CURVE_CREATE),
    "curve_migrate": (CURVE, ("migrate",), schemas.CURVE_MIGRATE),
    "amm_swap": (AMM, ("swap",), schemas.AMM_SWAP),
    "amm_create_pool": (AMM, ("create_pool",), schemas.AMM_CREATE_POOL),
    "amm_liquidity": (AMM, ("deposit", "withdraw"), schemas.AMM_LIQUIDITY),
}
CORRUPT = "_corrupt"


def is_kind(name: str) -> Column:
    protocol, types, _ = PAYLOADS[name]
    return (F.col("protocol") == protocol) & F.col("event_type").isin(*types)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENVELOPE).parquet(path)


def _document_schema(fields: Iterable[str] | None = None) -> T.StructType:
    """All payload kinds as one schema: they agree on every shared field but the nested arguments."""
    merged: dict[str, T.StructField] = {}
    args: dict[str, T.StructField] = {}
    for _, _, schema in PAYLOADS.values():
        for f in schema.fields:
            if f.name == "instruction_args":
                args.update({g.name: g for g in f.dataType.fields})
            else:
                merged[f.name] = f
    merged["instruction_args"] = T.StructField("instruction_args", T.StructType(list(args.values())))
    chosen = [f for n, f in merged.items() if fields is None or n in fields]
    return T.StructType([*chosen, T.StructField(CORRUPT, T.StringType())])


def parse_payload(log: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Add ``doc``: the payload parsed once, with the named fields only.

    The one-element ``inline`` keeps the optimizer from copying the parse into every
    expression above that reads a field of it.
    """
    wanted = None if fields is None else set(fields)
    doc = F.from_json("payload", _document_schema(wanted), {"columnNameOfCorruptRecord": CORRUPT})
    return log.select("*", F.inline(F.array(F.struct(doc.alias("doc")))))


def payload_error() -> Column:
    known = F.lit(False)
    for name in PAYLOADS:
        known = known | is_kind(name)
    return F.when(
        ~F.coalesce(known, F.lit(False)),
        F.concat(F.lit("unsupported event type: "), F.concat_ws(".", "protocol", "event_type")),
    ).when(F.col(f"doc.{CORRUPT}").isNotNull(), "malformed payload")


def decode_payload(log: DataFrame) -> DataFrame:
    """One nullable struct per payload kind, chosen by (protocol, event type).

    ``payload_error`` says why a payload has none: an unsupported pair or malformed JSON.
    """
    df = parse_payload(log)
    out = {}
    for name, (_, _, schema) in PAYLOADS.items():
        cols = []
        for f in schema.fields:
            if f.name == "instruction_args":
                args = F.struct(*(F.col(f"doc.instruction_args.{g.name}") for g in f.dataType.fields))
                cols.append(F.when(F.col("doc.instruction_args").isNotNull(), args).alias(f.name))
            else:
                cols.append(F.col(f"doc.{f.name}"))
        out[name] = F.when(is_kind(name) & payload_error().isNull(), F.struct(*cols))
    return df.withColumns(out).withColumn("payload_error", payload_error()).drop("doc")


def payload_asset() -> Column:
    """The asset of a parsed event: the payload's own on the curve, the tracked side of a pair on the AMM."""
    return F.when(F.col("protocol") == CURVE, F.col("doc.mint")).otherwise(
        tracked_asset(F.col("refs.mint"), F.col("doc.base_mint"), F.col("doc.quote_mint"))
    )


SWAP_FIELDS = ["side", "base_mint", "quote_mint", "base_amount_in", "base_amount_out", "quote_amount_in", "quote_amount_out"]
ASSET_FIELDS = ["mint", "base_mint", "quote_mint"]


def classify(log: DataFrame, fields: Iterable[str] = ()) -> DataFrame:
    """Parsed log with its asset, the swap from the asset's side, and ``reason``.

    The reason is null where the event can be projected, else says why not.
    """
    df = parse_payload(log, [*fields, *SWAP_FIELDS, *ASSET_FIELDS]).withColumn("asset_id", payload_asset())
    swap = orient_swap(F.col("asset_id"), *(F.col(f"doc.{c}") for c in SWAP_FIELDS))
    swap = F.when(is_kind("amm_swap"), swap)
    df = df.select("*", F.inline(F.array(F.struct(swap.alias("swap")))))
    reason = F.coalesce(
        payload_error(),
        F.when(empty_to_null(F.col("asset_id")).isNull(), "asset missing"),
        F.col("swap.error"),
    )
    return df.withColumn("reason", reason)


def dead_letters(log: DataFrame) -> DataFrame:
    """Events that cannot be projected, each with its reason."""
    return classify(log).where("reason IS NOT NULL").select(*log.columns, "reason")


def append_log(new: DataFrame, existing: DataFrame, arrival: str = "log_id") -> DataFrame:
    """The rows of ``new`` whose event id the log does not hold yet; of copies the first to arrive.

    Copies go before the join, so an id repeated very often reaches it once.
    """
    fresh = first_per_key(new, ["event_id"], F.col(arrival).asc_nulls_last())
    return fresh.join(existing.select("event_id"), "event_id", "left_anti").select(*new.columns)


def subject_of() -> Column:
    return F.concat_ws(".", F.lit("solana"), F.lit("tracked"), "protocol", "event_type")


def write_by_subject(log: DataFrame, path: str) -> None:
    """Route the log into one folder per subject."""
    log.withColumn("subject", subject_of()).write.mode("append").partitionBy("subject").parquet(path)
