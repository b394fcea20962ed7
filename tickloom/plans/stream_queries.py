"""Checked queries: streams drained to the end, and operational metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LATENCY_BOUNDS
from ..functions.display import bucket_start
from ..operators import metrics as M
from ..operators import ops as O
from ..session import scratch
from ..sources.logstream import log_stream
from ..operators import candles as C
from ..streaming import bars as T
from ..streaming import pipelines as S
from ..streaming.rolling import metrics_stream
from ..streaming.tables import VersionedTable, drain, latest_rows, upsert_stream
from . import bindings as B
from .candle_queries import _bars
from .log_queries import BROKEN, MARKETS, TOKEN_UPDATES, TOKENS, broken_log
from .metric_queries import POINTS
from .registry import query, rounded

col = F.col


def as_stream(spark: SparkSession, df: DataFrame, order: str, cuts: list, repeat_first: bool = False, first_last: bool = False, newest_first: bool = False, dealt: bool = False) -> DataFrame:
    """The rows written in parts cut at ``cuts`` of ``order``, and read back as a stream, a part per batch.

    Rows already ``dealt`` evenly to as many partitions as a part has files are not dealt again.
    """
    path = scratch(spark, "source")
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.where(col(order) >= low)
        if high is not None:
            part = part.where(col(order) < high)
        parts.append(part)
    if repeat_first:
        parts.append(parts[0])
    if first_last:
        parts = parts[1:] + parts[:1]
    if newest_first:
        parts = parts[::-1]
    files = spark.sparkContext.defaultParallelism
    for part in parts:
        # the file source takes files in the order written, so a batch is a part
        (part if dealt else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _log(spark, sf) -> DataFrame:
    """The log, built by as many tasks for a range of positions as for all of it."""
    return B.chain_log(spark, sf, spark.sparkContext.defaultParallelism)


def _cuts(spark, sf) -> list[int]:
    """Three positions that cut the log into four."""
    top = B.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return [top // 4, top // 2, top * 3 // 4]


def _sink(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = scratch(spark, "sink")
    table = VersionedTable(path)
    drain(stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: table.write(df, i)), scratch(spark, "checkpoint"))
    return table.all(spark)


@query("ingest_stream", "SELECT log_id, event_id, event_type FROM chain_log WHERE log_id % 41 <> 0", ["chain_log"])
def ingest_stream(spark, sf):
    """Four files, the first one twice, unknown kinds among them."""
    log = _log(spark, sf).withColumn("event_type", F.when(col("log_id") % 41 == 0, "burn").otherwise(col("event_type")))
    stream = as_stream(spark, log, "log_id", _cuts(spark, sf), repeat_first=True, dealt=True)
    return _sink(spark, S.ingest_stream(stream)).select("log_id", "event_id", "event_type")


@query("ingest_stream_late", "SELECT log_id, event_id FROM chain_log", ["chain_log"])
def ingest_stream_late(spark, sf):
    """The newest file first: events of any age arrive once."""
    stream = as_stream(spark, _log(spark, sf), "log_id", _cuts(spark, sf), newest_first=True, dealt=True)
    return _sink(spark, S.ingest_stream(stream)).select("log_id", "event_id")


@query("replay_then_live_restarted", "SELECT log_id, event_id FROM chain_log WHERE log_id > 500", ["chain_log"])
def replay_then_live_restarted(spark, sf):
    """Stopped after the first live files and run again; the second run brings old rows too."""
    log, cuts = _log(spark, sf), _cuts(spark, sf)
    source, path, checkpoint = scratch(spark, "source"), scratch(spark, "feed"), scratch(spark, "checkpoint")
    for low, high, seen in ((cuts[0], cuts[2], cuts[1]), (cuts[1], None, None)):
        part = log.where(col("log_id") >= low)
        (part if high is None else part.where(col("log_id") < high)).write.mode("append").parquet(source)
        live = spark.readStream.schema(log.schema).parquet(source)
        S.replay_then_live(log if seen is None else log.where(col("log_id") < seen), live, 500, path, checkpoint)
    return VersionedTable(path).all(spark).select("log_id", "event_id")


@query("log_stream_followed", "SELECT log_id, event_id FROM chain_log WHERE log_id > 500", ["chain_log"])
def log_stream_followed(spark, sf):
    """One stream over the stored log: history, then rows that come later, some of them again, after a restart."""
    log, cuts = _log(spark, sf), _cuts(spark, sf)
    source, path, checkpoint = scratch(spark, "log"), scratch(spark, "feed"), scratch(spark, "checkpoint")
    for low, high in ((None, cuts[1]), (cuts[0], cuts[2]), (cuts[2], None)):
        part = log if low is None else log.where(col("log_id") >= low)
        (part if high is None else part.where(col("log_id") < high)).write.mode("append").parquet(source)
        S.follow(log_stream(spark, source, log.schema, 500), path, checkpoint)
    return VersionedTable(path).all(spark).select("log_id", "event_id")


@query("ingest_exact", "SELECT log_id, event_id, event_type FROM chain_log", ["chain_log"])
def ingest_exact(spark, sf):
    stream = as_stream(spark, _log(spark, sf), "log_id", _cuts(spark, sf), repeat_first=True, dealt=True)
    path = scratch(spark, "log")
    S.ingest_exact(stream, path, scratch(spark, "checkpoint"), limit=500)
    return VersionedTable(path).all(spark).select("log_id", "event_id", "event_type")


@query("dead_letters_stream", BROKEN + "SELECT log_id, reason FROM broken WHERE reason IS NOT NULL", ["chain_log"])
def dead_letters_stream(spark, sf):
    stream = as_stream(spark, broken_log(spark, sf, spark.sparkContext.defaultParallelism), "log_id", _cuts(spark, sf), dealt=True)
    return _sink(spark, S.split_dead_letters(stream)).select("log_id", "reason")


def _projected(spark, sf):
    path = scratch(spark, "model")
    stream = as_stream(spark, _log(spark, sf), "log_id", _cuts(spark, sf), dealt=True)
    checkpoint = scratch(spark, "checkpoint")
    S.project_stream(stream, path, checkpoint, limit=20)
    # a restart with nothing new stands at the same version
    version = S.project_stream(stream, path, checkpoint, limit=20)
    return S.projected(spark, path, version)


@query("project_stream_tokens", TOKEN_UPDATES + TOKENS + "SELECT * FROM tokens", ["chain_log"])
def project_stream_tokens(spark, sf):
    return _projected(spark, sf)["tokens"]


@query("project_stream_markets", MARKETS + "SELECT * FROM markets", ["chain_log"])
def project_stream_markets(spark, sf):
    return _projected(spark, sf)["markets"]


@query("candle_stream", _bars("ev_trades", 3600), ["ev_trades"])
def candle_stream(spark, sf):
    stream = as_stream(spark, B.ev_trades(spark, sf), "insert_seq", _cuts(spark, sf))
    path = scratch(spark, "bars")
    upsert_stream(S.candle_stream(stream, 3600, "2 days"), path, scratch(spark, "checkpoint"))
    return latest_rows(spark, path, ["asset_id", "bucket"])


@query(
    "late_trades",
    """
    , edge AS (SELECT max(event_id) // 4 AS cut FROM events),
    opened AS (SELECT asset_id, max(event_unix_ts - event_unix_ts % 3600) AS open_bucket FROM ev_trades, edge WHERE insert_seq >= cut GROUP BY 1)
    SELECT DISTINCT asset_id, event_unix_ts - event_unix_ts % 3600 AS bucket FROM ev_trades JOIN opened USING (asset_id), edge
    WHERE insert_seq < cut AND event_unix_ts - event_unix_ts % 3600 < open_bucket
    """,
    ["ev_trades"],
)
def late_trades(spark, sf):
    """The oldest file comes last; all its buckets must be marked."""
    stream = as_stream(spark, B.ev_trades(spark, sf), "insert_seq", _cuts(spark, sf), first_last=True)
    path = scratch(spark, "late")
    S.late_trades(stream, path, scratch(spark, "checkpoint"), 3600)
    return VersionedTable(f"{path}/dirty").all(spark).select("asset_id", "bucket").distinct()


SIZES, BAR_DELAY = (60, 300, 3600), 3600


def _closed_bars() -> str:
    """Bars of every size that end before the newest event less the delay."""
    parts = []
    for size in SIZES:
        parts.append(f"SELECT {size} AS size, * FROM ({_bars('ev_trades', size)}) WHERE make_timestamp((bucket + {size}) * 1000000) <= (SELECT max(event_time) FROM ev_trades WHERE token_amount_raw <> 0) - INTERVAL {BAR_DELAY} SECOND")
    return " UNION ALL BY NAME ".join(parts)


@query("candle_stream_rollups", ", closed AS (" + _closed_bars() + ") SELECT * FROM closed", ["ev_trades"])
def candle_stream_rollups(spark, sf):
    """Three sizes from one stream, stopped after half of the files and started again."""
    trades, cuts = B.ev_trades(spark, sf), _cuts(spark, sf)
    source, path, checkpoint = scratch(spark, "source"), scratch(spark, "bars"), scratch(spark, "checkpoint")
    table = VersionedTable(path)
    files = spark.sparkContext.defaultParallelism
    for low, high in ((None, cuts[1]), (cuts[1], None)):
        part = trades if low is None else trades.where(col("insert_seq") >= low)
        (part if high is None else part.where(col("insert_seq") < high)).repartition(files).write.mode("append").parquet(source)
        stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", files).parquet(source)
        rolled = S.rollup_stream(stream, SIZES, f"{BAR_DELAY} seconds")
        drain(rolled.writeStream.outputMode("append").foreachBatch(lambda df, i: table.write(df, i)), checkpoint)
    return table.all(spark).drop("v")


@query("late_trades_reloaded", _bars("ev_trades", 3600), ["ev_trades"])
def late_trades_reloaded(spark, sf):
    """Stored bars without the late trades; after the reload they equal bars of all trades, a second reload is idle."""
    trades, cut = B.ev_trades(spark, sf), _cuts(spark, sf)[0]
    opened = trades.where(col("insert_seq") >= cut).groupBy("asset_id").agg(F.max(bucket_start(col("event_unix_ts"), 3600)).alias("open_bucket"))
    on_time = trades.where(col("insert_seq") >= cut).unionByName(S.split_late(trades.where(col("insert_seq") < cut), opened, 3600)[0].drop("bucket"))
    table, path = T.BarTable(scratch(spark, "bars"), 3600), scratch(spark, "late")
    table.create(C.candles(on_time, 3600))
    stream = as_stream(spark, trades, "insert_seq", _cuts(spark, sf), first_last=True)
    S.late_trades(stream, path, scratch(spark, "checkpoint"), 3600)
    T.reload_late(spark, table, trades, path)
    T.reload_late(spark, table, trades, path)
    return table.read(spark).drop("day")


ROLL = {"6h": 21600, "2d": 2 * 86400}


def _roll_sql(windows) -> str:
    cols = ["asset_id", "n AS as_of", "arg_max(close_price, second) AS latest_price"]
    for n, w in windows.items():
        inside = f"second > n - {w} AND close_price <> 0"
        cols.append(f"arg_min(open_price, second) FILTER ({inside}) AS anchor_price_{n}")
        cols += [f"CAST(coalesce(sum({c}) FILTER ({inside}), 0) AS BIGINT) AS {c}_{n}" for c in ("buys", "sells")]
        cols += [f"round(coalesce(sum({c}) FILTER ({inside}), 0), 9) AS {c}_{n}" for c in M.VOLUMES]
    return f"""
    , seconds AS (SELECT asset_id, event_unix_ts AS second,
        coalesce(arg_min(price, insert_seq) FILTER (price <> 0), 0) AS open_price, arg_max(price, insert_seq) AS close_price,
        count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side <> 'buy') AS sells, sum(volume) AS volume,
        coalesce(sum(volume) FILTER (side = 'buy'), 0) AS buy_volume, coalesce(sum(volume) FILTER (side <> 'buy'), 0) AS sell_volume
      FROM points WHERE price IS NOT NULL GROUP BY ALL),
    newest AS (SELECT asset_id, max(second) AS n FROM seconds GROUP BY 1)
    SELECT {', '.join(cols)} FROM seconds JOIN newest USING (asset_id) GROUP BY asset_id, n
    """


def _points(spark, sf) -> DataFrame:
    """The priced points, stored: a stream cut from them reads them once for every part."""
    path = scratch(spark, "points")
    M.priced_points(B.ev_trades(spark, sf), B.ev_meta(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def _rolled(spark, stream, history=None) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = metrics_stream(stream, ROLL, history, delay="2 days")
    path = scratch(spark, "rolled")
    upsert_stream(out, path, scratch(spark, "checkpoint"))
    rows = latest_rows(spark, path, ["asset_id"])
    return rounded(rows, *(f"{c}_{n}" for c in M.VOLUMES for n in ROLL))


@query("metrics_stream", POINTS + _roll_sql(ROLL), ["ev_trades", "ev_meta"])
def rolling(spark, sf):
    points = _points(spark, sf)
    return _rolled(spark, as_stream(spark, points, "insert_seq", _cuts(spark, sf)))


@query("seeded_state", POINTS + _roll_sql(ROLL), ["ev_trades", "ev_meta"])
def seeded(spark, sf):
    """The first three quarters are history, the rest is live."""
    points = _points(spark, sf)
    cut = _cuts(spark, sf)[-1]
    live = as_stream(spark, points.where(col("insert_seq") >= cut), "insert_seq", [cut + 200])
    return _rolled(spark, live, points.where(col("insert_seq") < cut))


AGE, AGE_DELAY = {"1h": 3600, "6h": 21600}, 86400


def _aged_sql(windows: dict[str, int], delay: int) -> str:
    cols = ["t.asset_id", "t.as_of", "arg_max(close_price, second) AS latest_price"]
    for n, w in windows.items():
        inside = f"second > as_of - {w} AND close_price <> 0"
        cols.append(f"arg_min(open_price, second) FILTER ({inside}) AS anchor_price_{n}")
        cols += [f"CAST(coalesce(sum({c}) FILTER ({inside}), 0) AS BIGINT) AS {c}_{n}" for c in ("buys", "sells")]
        cols += [f"round(coalesce(sum({c}) FILTER ({inside}), 0), 9) AS {c}_{n}" for c in M.VOLUMES]
    spans = ", ".join(f"({w})" for w in windows.values())
    return _roll_sql(windows).split("newest AS")[0] + f"""
    ticks AS (SELECT DISTINCT asset_id, second + w AS as_of FROM seconds, (VALUES {spans}) AS spans(w), (SELECT max(second) AS top FROM seconds)
      WHERE close_price <> 0 AND second + w < top - {delay})
    SELECT {', '.join(cols)} FROM ticks t JOIN seconds s ON s.asset_id = t.asset_id AND s.second <= t.as_of GROUP BY ALL
    """


@query("metrics_stream_ageing", POINTS + _aged_sql(AGE, AGE_DELAY), ["ev_trades", "ev_meta"])
def ageing(spark, sf):
    """Every time at which a trade leaves a window, between batches and while an asset is idle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = _points(spark, sf)
    out = metrics_stream(as_stream(spark, points, "insert_seq", _cuts(spark, sf)), AGE, delay=f"{AGE_DELAY} seconds", ageing=True)
    path = scratch(spark, "aged")
    upsert_stream(out, path, scratch(spark, "checkpoint"))
    rows = VersionedTable(path).all(spark).where("final").drop("final", "v")
    return rounded(rows, *(f"{c}_{n}" for c in M.VOLUMES for n in AGE))


@query("replay_then_live", "SELECT log_id, event_id FROM chain_log, (SELECT max(event_id) AS top FROM events) WHERE log_id > 500", ["chain_log"])
def replay_then_live(spark, sf):
    """The stored log and the live files overlap; each row after the cursor comes once."""
    log, cuts = _log(spark, sf), _cuts(spark, sf)
    live = as_stream(spark, log.where(col("log_id") >= cuts[0]), "log_id", cuts[1:], dealt=True)
    path = scratch(spark, "feed")
    S.replay_then_live(log.where(col("log_id") < cuts[1] + 100), live, 500, path, scratch(spark, "checkpoint"))
    return VersionedTable(path).all(spark).select("log_id", "event_id")


@query(
    "topic_fanout",
    """SELECT log_id, 'token:' || asset_id AS topic FROM chain_log UNION ALL SELECT log_id, 'global' FROM chain_log""",
    ["chain_log"],
)
def topic_fanout(spark, sf):
    stream = as_stream(spark, _log(spark, sf), "log_id", _cuts(spark, sf), dealt=True)
    return _sink(spark, S.topic_fanout(stream)).select("log_id", "topic")


@query(
    "tracked_stream",
    """
    , born AS (SELECT ref_mint AS asset_id, min(log_id) AS since FROM chain_log WHERE event_type = 'create' GROUP BY 1),
    known(asset_id, since) AS (VALUES ('A01', -1), ('A02', -1)),
    seen AS (SELECT asset_id, min(since) AS since FROM (SELECT * FROM born UNION ALL SELECT * FROM known) GROUP BY 1)
    SELECT l.log_id, l.asset_id FROM chain_log l JOIN seen USING (asset_id) WHERE l.log_id >= since
    """,
    ["chain_log"],
)
def tracked_stream(spark, sf):
    known = B.ev_meta(spark, sf).where("asset_id IN ('A01', 'A02')").select("asset_id")
    stream = as_stream(spark, _log(spark, sf), "log_id", _cuts(spark, sf), dealt=True)
    path = scratch(spark, "tracked")
    S.tracked_stream(stream, known, path, scratch(spark, "checkpoint"))
    return VersionedTable(f"{path}/events").all(spark).select("log_id", "asset_id")


# --- operational metrics ------------------------------------------------------------

REQUESTS = """
WITH requests AS (SELECT event_type AS route, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 500 ELSE 200 END AS status,
    CASE WHEN event_id % 97 = 0 THEN -1.0 WHEN event_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE value * 10 END AS ms FROM events)
"""


def _requests(spark, sf):
    n = col("event_id")
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ms = F.when(n % 97 == 0, -1.0).when(n % 89 == 0, float("nan")).otherwise(col("value") * 10)
    return e.select(col("event_type").alias("route"), F.when(k % 10 == 0, 500).otherwise(200).alias("status"), ms.alias("latency_ms"))


def _bucket_sql() -> str:
    edges = ["-1", *map(str, LATENCY_BOUNDS)]
    parts = [f"count(*) FILTER (ms > {a} AND ms <= {b})" for a, b in zip(edges, edges[1:])]
    return " || ',' || ".join(f"{p}" for p in [*parts, f"count(*) FILTER (ms > {LATENCY_BOUNDS[-1]})"])


@query(
    "latency_histogram",
    REQUESTS + f"""SELECT route, count(*) AS count, round(sum(ms), 6) AS sum, round(sum(ms) / count(*), 6) AS average,
    {_bucket_sql()} AS buckets FROM requests WHERE ms >= 0 AND NOT isnan(ms) GROUP BY route""",
)
def latency_histogram(spark, sf):
    out = O.latency_histogram(_requests(spark, sf), "latency_ms", ("route",))
    out = out.withColumn("buckets", F.array_join(out.bucket_counts.cast("array<string>"), ",")).drop("bucket_counts")
    return rounded(out, "sum", "average", places=6)


@query(
    "request_rollup",
    REQUESTS + """
    , per AS (SELECT route, status, count(*) AS requests FROM requests GROUP BY ALL),
    total AS (SELECT route, count(*) AS route_requests, round(avg(ms) FILTER (ms >= 0 AND NOT isnan(ms)), 6) AS route_average_ms FROM requests GROUP BY 1)
    SELECT route, status::BIGINT AS status, requests, route_requests, route_average_ms FROM per JOIN total USING (route)""",
)
def request_rollup(spark, sf):
    return rounded(O.request_rollup(_requests(spark, sf)), "route_average_ms", places=6)
