"""Raw transactions: nested records to instructions and event bytes, one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AMM_PROGRAM, CURVE_PROGRAM, LOG_DATA_PREFIX
from ..schemas import TX_VIEW

TX = ["slot", "signature", "tx_index"]


def read_tx_views(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transactions from JSON. Records that span lines make a file one task; large inputs
    should hold one record per line and be read with ``multi_line=False``.
    """
    return spark.read.schema(TX_VIEW).option("multiLine", multi_line).json(path)


def all_accounts() -> Column:
    return F.concat("account_keys", "loaded_writable_addresses", "loaded_readonly_addresses")


def account_at(accounts: Column, index: Column) -> Column:
    missing = F.concat(F.lit("<missing:"), index.cast("string"), F.lit(">"))
    return F.coalesce(F.get(accounts, index), missing)


def resolve_accounts(df: DataFrame, indices: str = "account_indices", out: str = "account_pubkeys") -> DataFrame:
    """Names for a list of account indices: static keys, then writable, then read-only."""
    return df.withColumn(out, F.transform(indices, lambda i: account_at(all_accounts(), i)))


def _bytes(base64: Column) -> Column:
    return F.try_to_binary(base64, F.lit("base64"))


def _live_groups() -> Column:
    """Inner groups; of two for the same outer instruction the later one counts."""
    groups = F.col("inner_instruction_groups")

    def kept(g: Column, i: Column) -> Column:
        later = F.slice(groups, i + 2, F.size(groups))
        return ~F.exists(later, lambda h: h.outer_instruction_index == g.outer_instruction_index)

    return F.filter(F.coalesce(groups, F.array()), kept)


def _step(x: Column, outer: Column, inner: Column) -> Column:
    return F.struct(
        outer.cast("int").alias("outer_index"),
        inner.cast("int").alias("inner_index"),
        x.program_id.alias("program_id"),
        x.account_pubkeys.alias("account_pubkeys"),
        x.data_prefix.alias("data_prefix"),
        x.data_base64.alias("data_base64"),
    )


def explode_instructions(df: DataFrame) -> DataFrame:
    """All instructions of each transaction with their path.

    Execution order is (outer_index, inner_index nulls first): an outer instruction, then
    its inner group; groups without an outer instruction come last.
    """
    outer = F.transform("outer_instructions", lambda x, i: _step(x, i, F.lit(None)))
    inner = F.flatten(
        F.transform(_live_groups(), lambda g: F.transform(g.instructions, lambda x, j: _step(x, g.outer_instruction_index, j)))
    )
    rows = df.select(*TX, F.inline(F.concat(outer, inner)))
    return rows.withColumn("source", F.when(F.col("inner_index").isNull(), "outer").otherwise("inner")).withColumn(
        "data", _bytes(F.col("data_base64"))
    )


def extract_log_payloads(df: DataFrame) -> DataFrame:
    """Decoded data of log lines that carry some, with the line's position."""
    lines = df.select(*TX, F.posexplode("log_messages").alias("line", "text")).where(F.col("text").startswith(LOG_DATA_PREFIX))
    data = _bytes(F.substring("text", len(LOG_DATA_PREFIX) + 1, 2**31 - 1))
    return lines.select(*TX, "line", data.alias("data")).where("data IS NOT NULL")


def event_bytes(df: DataFrame) -> DataFrame:
    """Every byte string that may hold an event, with when it is first seen.

    Log lines are seen before anything runs (group -1). An inner call to either program is
    seen with its group, as it is and without its first eight bytes.
    """
    def seen(group: Column, at: Column, cut: int, origin: str, data: Column) -> Column:
        return F.struct(
            group.cast("int").alias("seen_group"), at.cast("int").alias("seen_at"), F.lit(cut).alias("seen_cut"),
            F.lit(origin).alias("event_source"), data.alias("data"),
        )

    prefix = len(LOG_DATA_PREFIX)
    logs = F.transform(
        F.coalesce("log_messages", F.array()),
        lambda t, i: seen(F.lit(-1), i, 0, "logs", F.when(t.startswith(LOG_DATA_PREFIX), _bytes(t.substr(F.lit(prefix + 1), F.length(t))))),
    )

    def both(g: Column, x: Column, j: Column) -> Column:
        data = F.when(x.program_id.isin(CURVE_PROGRAM, AMM_PROGRAM), _bytes(x.data_base64))
        tail = F.when(F.length(data) > 8, F.substring(data, 9, 2**31 - 1))
        where = g.outer_instruction_index
        return F.array(seen(where, j, 0, "inner_cpi", data), seen(where, j, 1, "inner_cpi", tail))

    calls = F.flatten(F.flatten(F.transform(_live_groups(), lambda g: F.transform(g.instructions, lambda x, j: both(g, x, j)))))
    return df.select(*TX, F.inline(F.concat(logs, calls))).where("length(data) >= 8")
