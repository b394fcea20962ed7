"""Checked queries: transactions, binary decoding, pairing, envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import EVENT_ORIGIN_NAMES, EVENT_TYPE_NAMES, PROTOCOL_NAMES
from ..operators import decode as D
from ..operators import pairing as R
from ..operators.envelope import parse_transactions
from ..session import scratch
from ..sources import log as S
from ..sources import txviews as X
from ..sources import wire
from . import bindings as B
from . import encode as E
from .registry import query

col = F.col

# --- accounts and instructions from line items --------------------------------------


def _tx_accounts(spark, sf):
    """Orders as transactions: part keys as accounts, and index lists that partly miss."""
    li = B.table(spark, sf, "lineitem")
    keys = F.array_sort(F.collect_set(F.concat(F.lit("P"), col("l_partkey").cast("string"))))
    extra = F.array_sort(F.collect_set(F.concat(F.lit("S"), col("l_suppkey").cast("string"))))
    ids = F.array_sort(F.collect_list(col("l_linenumber").cast("int") - 1))
    return li.groupBy("l_orderkey").agg(keys.alias("account_keys"), extra.alias("loaded_writable_addresses"), ids.alias("account_indices")).withColumn(
        "loaded_readonly_addresses", F.array(F.lit("R0"))
    )


@query(
    "resolve_accounts",
    """
    WITH tx AS (SELECT l_orderkey, list_sort(list_distinct(list('P' || l_partkey))) || list_sort(list_distinct(list('S' || l_suppkey))) || ['R0'] AS accounts,
      list_sort(list(l_linenumber - 1)) AS idx FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_transform(idx, lambda i: coalesce(accounts[i + 1], '<missing:' || i || '>')), ',') AS names FROM tx
    """,
)
def resolve_accounts(spark, sf):
    out = X.resolve_accounts(_tx_accounts(spark, sf))
    return out.select("l_orderkey", F.array_join("account_pubkeys", ",").alias("names"))


LINES = """
WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos FROM lineitem)
"""


def _lines(spark, sf):
    """Line items numbered inside their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return B.table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(order) - 1)


def _line_views(spark, sf):
    """One transaction per order: even lines are outer instructions, odd ones inner calls of the line before."""
    def step(data):
        return F.struct(
            F.lit("prog").alias("program_id"), F.array(F.concat(F.lit("P"), col("l_partkey").cast("string"))).alias("account_pubkeys"),
            F.lit(None).cast("array<int>").alias("data_prefix"), F.base64(data.cast("binary")).alias("data_base64"),
        )

    rows = _lines(spark, sf).select("l_orderkey", "pos", step(col("l_suppkey").cast("string")).alias("ix"), F.concat(F.lit("Program data: "), F.base64(col("l_partkey").cast("string").cast("binary"))).alias("line"))
    packed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "ix", "line"))).alias("xs"))
    odd = F.filter("xs", lambda x: x.pos % 2 == 1)
    return packed.select(
        col("l_orderkey").alias("slot"), F.concat(F.lit("t"), col("l_orderkey").cast("string")).alias("signature"), F.lit(0).alias("tx_index"),
        F.transform(F.filter("xs", lambda x: x.pos % 2 == 0), lambda x: x.ix).alias("outer_instructions"),
        F.transform(odd, lambda x: F.struct(((x.pos - 1) / 2).cast("int").alias("outer_instruction_index"), F.array(x.ix).alias("instructions"))).alias("inner_instruction_groups"),
        F.flatten(F.transform("xs", lambda x: F.when(x.pos % 3 == 0, F.array(F.lit("Program log: no"), x.line)).otherwise(F.array(x.line, F.lit("Program data: %%%"))))).alias("log_messages"),
    )


@query(
    "explode_instructions",
    LINES + """SELECT l_orderkey AS slot, pos // 2 AS outer_index, CASE WHEN pos % 2 = 1 THEN 0 END::BIGINT AS inner_index,
      'P' || l_partkey AS account, l_suppkey::VARCHAR AS data FROM lines""",
)
def explode_instructions(spark, sf):
    out = X.explode_instructions(_line_views(spark, sf))
    return out.select("slot", "outer_index", "inner_index", col("account_pubkeys")[0].alias("account"), col("data").cast("string").alias("data"))


@query("extract_log_payloads", LINES + "SELECT l_orderkey AS slot, pos * 2 + (CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) AS line, l_partkey::VARCHAR AS data FROM lines")
def extract_log_payloads(spark, sf):
    return X.extract_log_payloads(_line_views(spark, sf)).select("slot", "line", col("data").cast("string").alias("data"))


@query(
    "pair_events",
    LINES + """
    , instr AS (SELECT l_orderkey, l_suppkey % 3 AS k, pos, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY pos) AS n FROM lines),
    evts AS (SELECT l_orderkey, l_suppkey % 3 AS k, pos, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY pos) AS n FROM lines WHERE l_linenumber % 5 <> 0)
    SELECT l_orderkey, k, i.pos AS ipos, e.pos AS epos FROM instr i JOIN evts e USING (l_orderkey, k, n)
    """,
)
def pair_events(spark, sf):
    rows = _lines(spark, sf).select("l_orderkey", (col("l_suppkey") % 3).alias("k"), "pos", "l_linenumber")
    events = rows.where("l_linenumber % 5 <> 0")
    seen = events.unionByName(events.where("pos % 4 = 0")).dropDuplicates(["l_orderkey", "k", "pos"])
    out = R.pair_events(rows, seen, ["l_orderkey", "k"], ["pos"], ["pos"])
    return out.select("l_orderkey", "k", col("instruction.pos").alias("ipos"), col("event.pos").alias("epos"))


@query(
    "pair_ordinal",
    LINES + """
    , instr AS (SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS n FROM lines),
    evts AS (SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS n FROM lines WHERE l_linenumber % 2 = 0)
    SELECT l_orderkey, i.pos AS ipos, e.pos AS epos FROM instr i JOIN evts e USING (l_orderkey, n)
    """,
)
def pair_ordinal(spark, sf):
    rows = _lines(spark, sf).select("l_orderkey", "pos", "l_linenumber")
    out = R.pair_ordinal(rows, rows.where("l_linenumber % 2 = 0"), ["l_orderkey"], ["pos"], ["pos"])
    return out.select("l_orderkey", col("instruction.pos").alias("ipos"), col("event.pos").alias("epos"))


# --- binary -------------------------------------------------------------------------

KEYS = f"""
, keyed AS (SELECT *, repeat('1', 31) || '{D.ALPHABET}'[CAST(substr(asset_id, 2) AS BIGINT) % 50 + 2] AS mint,
    repeat('1', 31) || '{D.ALPHABET}'[CAST(substr(user_address, 2) AS BIGINT) % 50 + 2] AS usr FROM ev_log)
"""


@query(
    "decode_events",
    KEYS + """
    SELECT log_id, CASE WHEN ok THEN mint END AS mint, CASE WHEN ok THEN usr END AS "user", CASE WHEN ok THEN quote_amount_raw END AS sol_amount,
      CASE WHEN ok THEN token_amount_raw END AS token_amount, CASE WHEN ok THEN side <> 'sell' END AS is_buy, CASE WHEN ok THEN event_unix_ts END AS ts,
      CASE WHEN ok THEN (CASE WHEN log_id * 3 < 7000 THEN (log_id * 3 - 7000 + 18446744073709551616::HUGEINT)::VARCHAR ELSE (log_id * 3 - 7000)::VARCHAR END) END AS virtual_sol,
      CASE WHEN ok THEN side END AS ix_name, CASE WHEN ok THEN slot END AS cashback
    FROM (SELECT *, log_id % 53 <> 0 AS ok FROM keyed WHERE kind = 'trade')
    """,
    ["ev_log"],
)
def decode_events(spark, sf):
    e = D.decode_events(E.trade_events(spark, sf))
    return e.select(
        "log_id", "event.mint", "event.user", "event.sol_amount", "event.token_amount", "event.is_buy", col("event.timestamp").alias("ts"),
        col("event.virtual_sol_reserves").cast("string").alias("virtual_sol"), "event.ix_name", "event.cashback",
    )


def _steps(spark, sf):
    return X.explode_instructions(E.tx_views(spark, sf))


@query(
    "decode_instructions",
    KEYS + """
    , steps AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY log_id) - 1 AS pos FROM keyed WHERE kind <> 'migrate')
    SELECT slot, pos AS outer_index, CASE WHEN kind = 'create' THEN 0 END::BIGINT AS inner_index,
      'curve_' || (CASE WHEN kind = 'create' THEN 'create' ELSE side END) AS kind, mint, usr AS "user",
      CASE WHEN side IN ('buy', 'sell') THEN token_amount_raw END AS amount, CASE WHEN side = 'buy_exact_sol_in' THEN token_amount_raw END AS spendable,
      CASE WHEN kind = 'create' THEN 'näme ' || user_address END AS name, CASE WHEN kind = 'create' THEN usr END AS creator
    FROM steps
    """,
    ["ev_log"],
)
def decode_instructions(spark, sf):
    out = D.decode_instructions(_steps(spark, sf))
    a = col("accounts")
    return out.where("args IS NOT NULL").select(
        "slot", "outer_index", "inner_index", "kind", a["mint"].alias("mint"), a["user"].alias("user"), "args.amount",
        col("args.spendable_sol_in").alias("spendable"), "args.name", "args.creator",
    )


@query(
    "extract_decimals",
    KEYS + "SELECT 't' || slot AS signature, mint, arg_min(log_id % 10, log_id) AS mint_decimals FROM keyed WHERE kind = 'create' GROUP BY ALL",
    ["ev_log"],
)
def extract_decimals(spark, sf):
    return D.extract_decimals(_steps(spark, sf))


@query(
    "instruction_census",
    """SELECT count(*) FILTER (side = 'buy') AS curve_buy_ix, count(*) FILTER (side = 'sell') AS curve_sell_ix,
      count(*) FILTER (side = 'buy_exact_sol_in') AS curve_buy_exact_sol_in_ix, count(*) FILTER (kind = 'create') AS curve_create_ix,
      0::BIGINT AS curve_create_v2_ix, 0::BIGINT AS curve_migrate_ix, count(*) FILTER (kind = 'create') AS curve_other_ix,
      0::BIGINT AS curve_create_v2_parseable_ix, count(*) FILTER (kind = 'create') AS curve_create_event_bytes,
      count(*) FILTER (kind = 'create') AS curve_create_event_parseable FROM ev_log""",
    ["ev_log"],
)
def instruction_census(spark, sf):
    views = E.tx_views(spark, sf)
    return D.instruction_census(X.explode_instructions(views), X.event_bytes(views))


# an instruction takes the first event of its key; with one missing, the next one of the same trader moves up
ENVELOPES = KEYS + """
, steps AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY log_id) - 1 AS pos FROM keyed WHERE kind <> 'migrate'),
calls AS (SELECT *, row_number() OVER (PARTITION BY slot, mint, usr, side ORDER BY pos) AS n FROM steps WHERE kind = 'trade'),
lines AS (SELECT *, row_number() OVER (PARTITION BY slot, mint, usr, side ORDER BY pos) AS n FROM steps WHERE kind = 'trade' AND log_id % 9 <> 0),
envelopes AS (
  SELECT 'solana:pumpfun:trade:t' || c.slot || ':outer:' || c.pos AS event_id, 'trade' AS event_type, c.slot, c.mint AS ref_mint, c.usr AS ref_user, 'logs' AS event_source,
    e.event_unix_ts, e.quote_amount_raw::VARCHAR AS sol_amount, e.token_amount_raw::VARCHAR AS token_amount, c.side, NULL AS name, NULL AS mint_decimals
  FROM calls c JOIN lines e USING (slot, mint, usr, side, n)
  UNION ALL
  SELECT 'solana:pumpfun:create:t' || slot || ':inner:' || pos || ':0', 'create', slot, mint, usr, 'inner_cpi', event_unix_ts, NULL, NULL, NULL,
    'näme ' || user_address, (arg_min(log_id % 10, log_id) OVER (PARTITION BY slot, mint))::VARCHAR FROM steps WHERE kind = 'create')
"""


def _envelope_view(df):
    p = lambda f: F.get_json_object("payload", f"$.{f}")
    return df.select(
        "event_id", "event_type", "slot", col("refs.mint").alias("ref_mint"), col("refs.user").alias("ref_user"), "event_source", "event_unix_ts",
        p("sol_amount").alias("sol_amount"), p("token_amount").alias("token_amount"), p("side").alias("side"), p("name").alias("name"),
        p("mint_decimals").alias("mint_decimals"),
    )


@query("build_envelope", ENVELOPES + "SELECT * FROM envelopes", ["ev_log"])
def build_envelope(spark, sf):
    return _envelope_view(parse_transactions(E.tx_views(spark, sf)))


@query("read_tx_views", ENVELOPES + "SELECT event_type, count(*) AS n, count(DISTINCT ref_mint) AS mints FROM envelopes GROUP BY 1", ["ev_log"])
def read_tx_views(spark, sf):
    """The same transactions written as JSON and read back through the schema."""
    path = scratch(spark, "views")
    E.tx_views(spark, sf).write.json(path)
    views = X.read_tx_views(spark, path, multi_line=False)
    return parse_transactions(views).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("refs.mint").alias("mints"))


# --- wire form ----------------------------------------------------------------------


def _wire_json(spark, sf):
    """The log as messages in JSON form: enumerations as numbers, some of them unknown."""
    log = B.chain_log(spark, sf)
    n = col("log_id")

    def number(c, names):
        return F.array_position(F.array(*(F.lit(x) for x in names)), c).cast("int") - 1

    variants = {
        "pumpfun_trade": "trade", "pumpfun_create": "create", "pumpfun_migrate": "migrate", "pumpamm_swap": "swap",
        "pumpamm_create_pool": "create_pool", "pumpamm_deposit": "deposit", "pumpamm_withdraw": "withdraw",
    }
    head = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), "event_id", F.lit(1).alias("chain"), number(col("protocol"), PROTOCOL_NAMES).alias("protocol"),
            number(col("event_type"), EVENT_TYPE_NAMES).alias("event_type"), F.when(n % 10 == 0, 9).otherwise(1).alias("commitment"), "slot",
            "tx_signature", "tx_index",
            F.when(
                n % 11 != 0,
                F.struct(F.when(col("instruction_path.source") == "outer", 1).otherwise(2).alias("source"), "instruction_path.outer_index", "instruction_path.inner_index"),
            ).alias("instruction_path"),
            number(col("event_source"), EVENT_ORIGIN_NAMES).alias("event_source"), "event_unix_ts", "refs",
        )
    )
    field = None
    for name, type_ in variants.items():
        hit = col("event_type") == type_
        field = F.when(hit, name) if field is None else field.when(hit, name)
    body = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"'), field, F.lit('":'), col("payload"), F.lit("}"))
    return log.withColumn("_head", head).select("log_id", F.when(n % 17 == 0, col("_head")).otherwise(body).alias("value"))


_WIRE_COLUMNS = """event_id, 'solana' AS chain, protocol, event_type, CASE WHEN log_id % 10 = 0 THEN '' ELSE 'processed' END AS commitment, slot, tx_signature, tx_index,
      CASE WHEN log_id % 11 = 0 THEN NULL WHEN inner_index IS NULL THEN 'outer' ELSE 'inner' END AS source,
      CASE WHEN log_id % 11 = 0 THEN NULL ELSE outer_index END AS outer_index, CASE WHEN log_id % 11 = 0 THEN NULL ELSE inner_index END AS inner_index,
      event_source, event_unix_ts, ref_mint AS mint,
      CASE WHEN log_id % 17 <> 0 AND event_type IN ('trade', 'swap') THEN CASE WHEN event_type = 'swap' THEN swap_side ELSE side END END AS side,
      CASE WHEN log_id % 11 = 0 THEN 'instruction path missing' WHEN log_id % 17 = 0 THEN 'unsupported payload' END AS error"""


def _wire_view(out):
    path = col("instruction_path")
    there = path["source"].isNotNull() & (F.coalesce(col("error"), F.lit("")) != "instruction path missing")
    return out.select(
        "event_id", "chain", "protocol", "event_type", "commitment", "slot", "tx_signature", "tx_index", F.when(there, path["source"]).alias("source"),
        F.when(there, path["outer_index"]).alias("outer_index"), path["inner_index"].alias("inner_index"), "event_source", "event_unix_ts",
        col("refs.mint").alias("mint"), F.get_json_object("payload", "$.side").alias("side"), "error",
    )


@query("read_json_events", f"SELECT {_WIRE_COLUMNS} FROM chain_log", ["chain_log"])
def read_json_events(spark, sf):
    return _wire_view(wire.read_json_events(_wire_json(spark, sf)))


@query(
    "read_proto_events",
    f"""
    , wire AS (SELECT log_id, {_WIRE_COLUMNS} FROM chain_log WHERE log_id % 13 <> 0)
    SELECT * EXCLUDE (log_id) FROM wire
    UNION ALL BY NAME SELECT 'malformed message' AS error FROM chain_log WHERE log_id % 13 = 0
    """,
    ["chain_log"],
)
def read_proto_events(spark, sf):
    """The same messages in binary form, some of them cut off; unknown enumerations and missing paths among them."""
    sent = E.to_messages(_wire_json(spark, sf), wire.envelope_message())
    cut = F.when(col("log_id") % 13 == 0, F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(col("value"))
    return _wire_view(wire.read_proto_events(sent.withColumn("value", cut)))


@query("write_by_subject", "SELECT 'solana.tracked.' || protocol || '.' || event_type AS subject, count(*) AS n, sum(log_id)::BIGINT AS ids FROM chain_log GROUP BY 1", ["chain_log"])
def write_by_subject(spark, sf):
    path = scratch(spark, "routed")
    S.write_by_subject(B.chain_log(spark, sf), path)
    return spark.read.parquet(path).groupBy("subject").agg(F.count("*").alias("n"), F.sum("log_id").alias("ids"))
