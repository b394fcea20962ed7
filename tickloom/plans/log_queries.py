"""Checked queries: the event log, scans over it, and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NATIVE_MINT as NATIVE
from ..operators import logscan as L
from ..operators import project as P
from ..session import scratch
from ..sources import log as S
from ..sources.pages import PagedLog
from . import bindings as B
from .registry import query

NOW = "(SELECT now_ts FROM now)"
LOG = ["chain_log"]
col = F.col

# --- log ----------------------------------------------------------------------------


@query(
    "decode_payload",
    """
    SELECT log_id, event_type, CASE WHEN event_type = 'trade' THEN token_amount_raw::VARCHAR END AS trade_tokens,
      CASE WHEN event_type = 'create' THEN 'name ' || user_address END AS name,
      CASE WHEN event_type = 'create' THEN log_id % 2 = 0 END AS mayhem,
      CASE WHEN event_type = 'create' AND log_id % 3 <> 0 THEN log_id % 4 END AS decimals,
      CASE WHEN event_type = 'migrate' THEN p_pool END AS migrate_pool,
      CASE WHEN event_type = 'swap' THEN swap_side END AS swap_side,
      CASE WHEN event_type = 'create_pool' THEN log_id % 5 END AS base_decimals,
      CASE WHEN event_type IN ('deposit', 'withdraw') THEN event_type END AS action,
      CAST(NULL AS VARCHAR) AS payload_error
    FROM chain_log
    """,
    LOG,
)
def decode_payload(spark, sf):
    return S.decode_payload(B.chain_log(spark, sf)).select(
        "log_id", "event_type", col("curve_trade.token_amount").alias("trade_tokens"), col("curve_create.name").alias("name"),
        col("curve_create.is_mayhem_mode").alias("mayhem"), col("curve_create.mint_decimals").alias("decimals"),
        col("curve_migrate.pool").alias("migrate_pool"), col("amm_swap.side").alias("swap_side"),
        col("amm_create_pool.base_mint_decimals").alias("base_decimals"), col("amm_liquidity.action").alias("action"), "payload_error",
    )


@query(
    "append_log",
    "SELECT log_id, event_id FROM ev_log WHERE log_id % 4 <> 1",
    ["ev_log"],
)
def append_log(spark, sf):
    """New rows come twice and partly known; each unknown id comes out once."""
    log = B.ev_log(spark, sf)
    copies = log.unionByName(log.withColumn("log_id", col("log_id") + 1000000))
    return S.append_log(copies, log.where("log_id % 4 = 1")).select("log_id", "event_id")


@query("subject_of", "SELECT 'solana.tracked.' || protocol || '.' || event_type AS subject, count(*) AS n FROM chain_log GROUP BY ALL", LOG)
def subject_of(spark, sf):
    return B.chain_log(spark, sf).groupBy(S.subject_of().alias("subject")).agg(F.count("*").alias("n"))


BROKEN = """
, broken AS (SELECT log_id, event_type, protocol, CASE
    WHEN log_id % 41 = 0 THEN 'unsupported event type: ' || protocol || '.burn'
    WHEN log_id % 37 = 0 THEN 'malformed payload'
    WHEN log_id % 43 = 0 AND event_type = 'swap' THEN 'unsupported side' END AS reason FROM chain_log)
"""


def broken_log(spark, sf, files=None):
    """The log with unsupported types, broken JSON and odd swap sides mixed in."""
    n = col("log_id")
    payload = F.when(n % 37 == 0, "{not json").when(
        (n % 43 == 0) & (col("event_type") == "swap"), F.regexp_replace("payload", '"side":"[a-z_]+"', '"side":"odd"')
    ).otherwise(col("payload"))
    return B.chain_log(spark, sf, files).withColumn("payload", payload).withColumn(
        "event_type", F.when(n % 41 == 0, "burn").otherwise(col("event_type"))
    )


@query("dead_letters", BROKEN + "SELECT log_id, reason FROM broken WHERE reason IS NOT NULL", LOG)
def dead_letters(spark, sf):
    return S.dead_letters(broken_log(spark, sf)).select("log_id", "reason")


# --- scans --------------------------------------------------------------------------


@query("events_by_ref_mint", "SELECT log_id, event_type FROM chain_log WHERE ref_mint = 'A03' ORDER BY log_id DESC LIMIT 100", LOG)
def events_by_mint(spark, sf):
    return L.events_by_ref(B.chain_log(spark, sf), "mint", "A03", 100).select("log_id", "event_type")


@query("events_by_ref_pool", "SELECT log_id, event_type FROM chain_log WHERE (amm OR event_type = 'migrate') AND p_pool = 'QA03' ORDER BY log_id DESC LIMIT 50", LOG)
def events_by_pool(spark, sf):
    return L.events_by_ref(B.chain_log(spark, sf), "pool", "QA03", 50).select("log_id", "event_type")


def _paged(spark, sf, key):
    """The log in a hundred files, written in two parts of which the second begins before the first ends."""
    log = B.chain_log(spark, sf, spark.sparkContext.defaultParallelism).withColumn("asset_id", F.col("refs.mint"))
    store = PagedLog(scratch(spark, "paged"), key)
    early, late = B.position(spark, sf, 5), B.position(spark, sf, 7)
    store.append(log.where((F.col("log_id") <= early) | (F.col("log_id") > late)), 0, 50)
    store.append(log.where((F.col("log_id") > early) & (F.col("log_id") <= late)), 1, 50)
    return store


@query("paged_events_newest", f"SELECT log_id, event_type FROM chain_log WHERE ref_mint = 'A03' AND log_id < {B.position_sql(8)} ORDER BY log_id DESC LIMIT 100", LOG)
def paged_events_newest(spark, sf):
    return _paged(spark, sf, "asset_id").newest(spark, "A03", 100, B.position(spark, sf, 8)).select("log_id", "event_type")


@query("paged_events_after", "SELECT log_id, event_id FROM chain_log WHERE log_id > 700 ORDER BY log_id LIMIT 512", LOG)
def paged_events_after(spark, sf):
    return _paged(spark, sf, None).after(spark, 700, 512).select("log_id", "event_id")


@query("paged_events_after_asset", f"SELECT log_id, event_id FROM chain_log WHERE log_id > {B.position_sql(3)} AND ref_mint = 'A05' ORDER BY log_id LIMIT 64", LOG)
def paged_events_after_asset(spark, sf):
    return _paged(spark, sf, "asset_id").after(spark, B.position(spark, sf, 3), 64, "A05").select("log_id", "event_id")


@query("events_after", "SELECT log_id, event_id FROM chain_log WHERE log_id > 700 ORDER BY log_id LIMIT 512", LOG)
def events_after(spark, sf):
    return L.events_after(B.chain_log(spark, sf), 700, 512).select("log_id", "event_id")


@query("events_after_asset", "SELECT log_id, event_id FROM chain_log WHERE log_id > 700 AND ref_mint = 'A05' ORDER BY log_id LIMIT 512", LOG)
def events_after_asset(spark, sf):
    return L.events_after(B.chain_log(spark, sf), 700, 512, "A05").select("log_id", "event_id")


def _latest(name: str, event_type: str, protocol: str | None):
    @query(
        name,
        f"""SELECT ref_mint AS asset_id, log_id, event_id FROM chain_log
        WHERE event_type = '{event_type}' AND ref_mint IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ref_mint ORDER BY slot DESC, tx_index DESC, outer_index DESC, inner_index DESC NULLS LAST) = 1""",
        LOG,
    )
    def run(spark, sf):
        return L.latest_event(B.chain_log(spark, sf), event_type, protocol).select("asset_id", "log_id", "event_id")


_latest("latest_create_event", "create", None)
_latest("latest_migrate_event", "migrate", S.CURVE)


@query(
    "tracked_only",
    """
    , born AS (SELECT ref_mint AS asset_id, min(log_id) AS since FROM chain_log WHERE event_type = 'create' GROUP BY 1),
    known(asset_id, since) AS (VALUES ('A01', -1), ('A02', -1)),
    seen AS (SELECT asset_id, min(since) AS since FROM (SELECT * FROM born UNION ALL SELECT * FROM known) GROUP BY 1)
    SELECT l.log_id, l.asset_id FROM chain_log l JOIN seen USING (asset_id) WHERE l.log_id >= since
    """,
    LOG,
)
def tracked_only(spark, sf):
    known = B.ev_meta(spark, sf).where("asset_id IN ('A01', 'A02')")
    return L.tracked_only(B.chain_log(spark, sf), known).select("log_id", "asset_id")


# --- projection ---------------------------------------------------------------------

TOKEN_UPDATES = """
, token_updates AS (SELECT log_id, asset_id,
    CASE WHEN event_type = 'create_pool' THEN coalesce(nullif(p_creator, ''), user_address) ELSE nullif(p_creator, '') END AS creator,
    CASE WHEN event_type <> 'create_pool' THEN p_curve END AS bonding_curve,
    CASE WHEN event_type <> 'create_pool' AND log_id % 2 = 0 THEN 'TP' END AS token_program,
    CASE WHEN event_type = 'create' THEN event_id END AS create_event_id,
    event_unix_ts AS first_seen_at,
    CASE WHEN event_type = 'create' THEN 'bonding_curve' ELSE 'pool' END AS current_stage,
    CASE WHEN event_type = 'create' THEN p_curve ELSE p_pool END AS active_market_id,
    CASE WHEN event_type = 'create' THEN 'pumpfun_curve' ELSE 'pumpamm_pool' END AS active_market_type,
    CASE WHEN event_type = 'migrate' THEN event_unix_ts END AS migrated_at
  FROM chain_log WHERE event_type IN ('create', 'migrate', 'create_pool'))
"""


def _last(*names: str) -> str:
    return ", ".join(f"arg_max({n}, log_id) FILTER ({n} IS NOT NULL) AS {n}" for n in names)


TOKENS = f"""
, tokens AS (SELECT asset_id, {_last('creator', 'bonding_curve', 'token_program', 'active_market_id', 'active_market_type', 'migrated_at')},
    arg_min(create_event_id, log_id) FILTER (create_event_id IS NOT NULL) AS create_event_id,
    min(first_seen_at) AS first_seen_at, arg_max(current_stage, log_id) AS current_stage
  FROM token_updates GROUP BY asset_id)
"""
METADATA = f"""
, metadata_updates AS (SELECT log_id, asset_id,
    CASE WHEN event_type = 'create' THEN 'name ' || user_address END AS name,
    CASE WHEN event_type = 'create' AND log_id % 5 <> 0 THEN 'S' || user_address END AS symbol,
    CASE WHEN event_type = 'create' THEN 'ipfs://' || user_address END AS uri,
    CASE WHEN event_type = 'create' THEN (CASE WHEN log_id % 3 <> 0 THEN log_id % 4 END)
         WHEN asset_id = quote_mint THEN log_id % 7 ELSE log_id % 5 END AS decimals,
    CASE WHEN event_type = 'create' THEN log_id * 100 END AS total_supply_raw,
    '{NATIVE}' AS quote_mint,
    CASE WHEN event_type = 'create' THEN 9 WHEN asset_id = quote_mint THEN log_id % 5 ELSE log_id % 7 END AS quote_decimals,
    CASE WHEN event_type = 'create_pool' THEN coalesce(nullif(p_creator, ''), user_address) ELSE nullif(p_creator, '') END AS creator,
    CASE WHEN event_type = 'create' THEN p_curve END AS bonding_curve,
    CASE WHEN event_type = 'create' AND log_id % 2 = 0 THEN 'TP' END AS token_program,
    CASE WHEN event_type = 'create' THEN log_id % 2 = 0 END AS is_mayhem_mode,
    CASE WHEN event_type = 'create' THEN log_id % 3 = 0 END AS is_cashback_enabled,
    event_id AS source_event_id
  FROM chain_log WHERE event_type IN ('create', 'create_pool')),
metadata AS (SELECT asset_id, {_last(*P.METADATA)} FROM metadata_updates GROUP BY asset_id)
"""
MARKETS = f"""
, market_updates AS (SELECT log_id, asset_id, CASE WHEN event_type = 'create' THEN p_curve ELSE p_pool END AS market_id,
    CASE WHEN event_type = 'create' THEN 'pumpfun' ELSE 'pumpamm' END AS protocol,
    CASE WHEN event_type = 'create' THEN 'pumpfun_curve' ELSE 'pumpamm_pool' END AS market_type,
    CASE WHEN event_type = 'create' THEN p_curve END AS bonding_curve,
    CASE WHEN event_type <> 'create' THEN p_pool END AS pool,
    CASE WHEN event_type = 'create_pool' THEN base_mint ELSE asset_id END AS base_mint,
    CASE WHEN event_type = 'create_pool' THEN quote_mint ELSE '{NATIVE}' END AS quote_mint,
    CASE WHEN event_type = 'create' AND log_id % 3 <> 0 THEN log_id % 4 WHEN event_type = 'create_pool' THEN log_id % 5 END AS base_mint_decimals,
    CASE WHEN event_type = 'create' THEN 9 WHEN event_type = 'create_pool' THEN log_id % 7 END AS quote_mint_decimals,
    CASE WHEN event_type <> 'create' THEN 'L' || asset_id END AS lp_mint, event_unix_ts AS started_at, event_id AS create_event_id
  FROM chain_log WHERE event_type IN ('create', 'migrate', 'create_pool')),
closes AS (SELECT log_id AS close_id, p_curve AS market_id, event_unix_ts AS closed_at FROM chain_log WHERE event_type = 'migrate'),
opened AS (SELECT market_id, arg_max(asset_id, log_id) AS asset_id, arg_max(protocol, log_id) AS protocol, arg_max(market_type, log_id) AS market_type,
    {_last('bonding_curve', 'pool', 'base_mint', 'quote_mint', 'base_mint_decimals', 'quote_mint_decimals', 'lp_mint')},
    min(started_at) AS started_at, arg_min(create_event_id, log_id) AS create_event_id, min(log_id) AS first_log
  FROM market_updates GROUP BY market_id),
markets AS (SELECT o.* EXCLUDE (first_log), (SELECT arg_max(closed_at, close_id) FROM closes c
    WHERE c.market_id = o.market_id AND c.close_id > o.first_log) AS ended_at FROM opened o)
"""
FACT_TRADES = f"""
, facts AS (SELECT event_id, event_unix_ts, log_id AS insert_seq, asset_id,
    CASE WHEN event_type = 'trade' THEN p_curve ELSE p_pool END AS market_id,
    CASE WHEN event_type = 'trade' THEN 'pumpfun_curve' ELSE 'pumpamm_pool' END AS market_type, protocol,
    CASE WHEN event_type = 'trade' THEN side WHEN (swap_side = 'sell') = (asset_id = quote_mint) THEN 'buy' ELSE 'sell' END AS side,
    CASE WHEN event_type = 'trade' THEN side ELSE swap_side END AS ix_name, user_address, '{NATIVE}' AS quote_mint,
    CASE WHEN event_type = 'swap' AND asset_id = quote_mint THEN quote_amount_raw ELSE token_amount_raw END AS token_amount_raw,
    CASE WHEN event_type = 'swap' AND asset_id = quote_mint THEN token_amount_raw ELSE quote_amount_raw END AS quote_amount_raw,
    tx_signature, slot, event_source
  FROM chain_log WHERE event_type IN ('trade', 'swap'))
"""
ACTIVITY = f"""
, activity AS (SELECT event_id, event_unix_ts, log_id AS insert_seq, asset_id, protocol, event_type,
    CASE WHEN event_type = 'swap' THEN 'trade' ELSE event_type END AS activity_type,
    CASE WHEN event_type IN ('trade', 'create') THEN p_curve ELSE p_pool END AS market_id,
    CASE WHEN event_type IN ('trade', 'create') THEN 'pumpfun_curve' ELSE 'pumpamm_pool' END AS market_type, user_address,
    CASE WHEN event_type = 'trade' THEN side WHEN event_type = 'swap' THEN (CASE WHEN (swap_side = 'sell') = (asset_id = quote_mint) THEN 'buy' ELSE 'sell' END) END AS side,
    CASE WHEN event_type <> 'create' THEN '{NATIVE}' END AS quote_mint,
    CASE WHEN event_type = 'create' THEN NULL WHEN amm AND asset_id = quote_mint THEN quote_amount_raw ELSE token_amount_raw END AS token_amount_raw,
    CASE WHEN event_type = 'create' THEN NULL WHEN amm AND asset_id = quote_mint THEN token_amount_raw ELSE quote_amount_raw END AS quote_amount_raw,
    tx_signature, slot, event_source
  FROM chain_log)
"""


@query("project_tokens", TOKEN_UPDATES + TOKENS + "SELECT * FROM tokens", LOG)
def project_tokens(spark, sf):
    return P.project_tokens(B.chain_log(spark, sf))


@query("project_metadata", METADATA + "SELECT * REPLACE (decimals::BIGINT AS decimals, quote_decimals::BIGINT AS quote_decimals) FROM metadata", LOG)
def project_metadata(spark, sf):
    return P.project_metadata(B.chain_log(spark, sf))


@query("project_markets", MARKETS + "SELECT * FROM markets", LOG)
def project_markets(spark, sf):
    return P.project_markets(B.chain_log(spark, sf))


@query("project_trades", FACT_TRADES + "SELECT * FROM facts", LOG)
def project_trades(spark, sf):
    log = B.chain_log(spark, sf)
    return P.project_trades(log.unionByName(log)).drop("event_time")


@query("project_activity", ACTIVITY + "SELECT * FROM activity", LOG)
def project_activity(spark, sf):
    return P.project_activity(B.chain_log(spark, sf)).drop("event_time", "details")


def _halves(spark, sf):
    """The log in two batches cut across assets and time, the second one partly a repeat."""
    log = B.chain_log(spark, sf)
    return log.where("log_id % 3 = 1"), log.where("log_id % 3 <> 1 OR log_id % 5 = 0")


def _merged(name, spark, sf):
    a, b = _halves(spark, sf)
    build = {"tokens": P.token_state, "metadata": P.metadata_state, "markets": P.market_state, "trades": P.project_trades}[name]
    return P.merge_table(name, build(a), build(b))


@query("merge_state_tokens", TOKEN_UPDATES + TOKENS + "SELECT * FROM tokens", LOG)
def merge_tokens(spark, sf):
    return P.settle(_merged("tokens", spark, sf), "asset_id", P.TOKENS)


@query("merge_state_markets", MARKETS + "SELECT * FROM markets", LOG)
def merge_markets(spark, sf):
    return P.settle_markets(_merged("markets", spark, sf))


@query("merge_state_trades", FACT_TRADES + "SELECT * FROM facts", LOG)
def merge_trades(spark, sf):
    return _merged("trades", spark, sf).drop("event_time")


@query("replay_from", TOKEN_UPDATES + TOKENS + "SELECT * FROM tokens", LOG)
def replay_from(spark, sf):
    """Rebuild up to a position, then catch up from it."""
    log = B.chain_log(spark, sf)
    state, _ = P.replay_from(log.where("log_id <= 4000"), 0)
    state, _ = P.replay_from(log, 4000, state)
    return P.read_model(state)["tokens"]


@query("replay_mark", "SELECT max(log_id) AS last_log_id FROM chain_log", LOG)
def replay_mark(spark, sf):
    return P.replay_from(B.chain_log(spark, sf), 4000)[1]


@query(
    "projection_lag",
    f"""SELECT greatest(max(log_id) - {B.position_sql(6)}, 0) AS log_id_lag,
      greatest({NOW} - arg_max(event_unix_ts, log_id) FILTER (log_id <= {B.position_sql(6)}), 0) AS event_time_lag_seconds FROM chain_log""",
    ["chain_log", "now"],
)
def projection_lag(spark, sf):
    return P.projection_lag(B.chain_log(spark, sf), B.position(spark, sf, 6), B.latest_time(spark, sf))


@query(
    "active_market",
    TOKEN_UPDATES + TOKENS + MARKETS + """
    , asked AS (SELECT asset_id, CASE WHEN asset_id > 'A08' THEN active_market_id END AS active_market_id FROM tokens),
    newest AS (SELECT * FROM markets WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY started_at DESC, market_id DESC) = 1)
    SELECT a.asset_id, CASE WHEN a.active_market_id IS NULL THEN n.market_id ELSE m.market_id END AS market_id,
      CASE WHEN a.active_market_id IS NULL THEN n.started_at ELSE m.started_at END AS started_at
    FROM asked a LEFT JOIN markets m ON m.market_id = a.active_market_id AND m.asset_id = a.asset_id LEFT JOIN newest n ON n.asset_id = a.asset_id
    """,
    LOG,
)
def active_market(spark, sf):
    log = B.chain_log(spark, sf)
    tokens = P.project_tokens(log).withColumn("active_market_id", F.when(col("asset_id") > "A08", col("active_market_id")))
    return P.active_market(tokens, P.project_markets(log)).select("asset_id", "market_id", "started_at")


@query(
    "enrich_images",
    """
    SELECT m.asset_id, m.name, CASE WHEN p.p_size % 7 <> 0 THEN 'https://ipfs.io/ipfs/img/' || p.p_partkey END AS image_uri
    FROM ev_meta m LEFT JOIN part p ON m.asset_id = printf('A%02d', p.p_partkey)
    """,
    ["ev_meta"],
)
def enrich_images(spark, sf):
    return P.enrich_images(B.ev_meta(spark, sf), B.part_docs(spark, sf)).select("asset_id", "name", "image_uri")
