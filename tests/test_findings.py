"""Third round: what grew through the driver, and where queries left their SQL."""

import duckdb
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows_of
from tickloom.constants import NATIVE_MINT as N
from tickloom.operators import metrics as M
from tickloom.operators import project as P
from tickloom.operators import traders as D
from tickloom.plans import bindings as B
from tickloom.session import scratch
from tickloom.streaming.keyed import KeyedTable

SF = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["requested_left", "short_windows_strict", "current_metrics", "metric_points", "liquidity"])
def test_metadata_is_not_sent_through_the_driver(spark, name):
    # the files are small, so that Spark would take the side with a row per key for small
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize("name", ["refresh_targets", "backfill_metrics"])
def test_more_than_a_hundred_assets(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_halves_of_a_price_go_up_as_in_the_sql(spark):
    df = entry.queries()["subscript_price"](spark, SF).where("id IN (1922042439344, 7615711272160)")
    assert sorted(tuple(r) for r in df.collect()) == [(1922042439344, "0.0264"), (7615711272160, "0.0275")]


def test_exact_windows_scale_each_currency_of_a_minute(spark):
    now = 1_700_000_000 - 1_700_000_000 % 60 + 59
    at = now - 1830
    rows = [("A01", at, 1, N, 500, 10), ("A01", at + 1, 2, "USDC", 700, 10), ("A01", now - 1, 3, N, 100, 10)]
    trades = spark.createDataFrame(rows, "asset_id string, event_unix_ts long, insert_seq long, quote_mint string, quote_amount_raw long, token_amount_raw long").select(
        "*", F.timestamp_seconds("event_unix_ts").alias("event_time"), F.col("insert_seq").alias("slot"), F.lit("buy").alias("side"),
        F.col("insert_seq").cast("string").alias("event_id"), F.lit("U").alias("user_address"), F.lit("M").alias("market_id"),
    )
    meta = spark.createDataFrame([("A01", 0, "USDC", 2)], "asset_id string, decimals int, quote_mint string, quote_decimals int")
    got = M.current_metrics(trades, meta, now, exact=True).first()
    assert got.volume_1h == pytest.approx(500 / 1e9 + 700 / 100 + 100 / 1e9, abs=1e-12)
    assert got.buys_1h == 3
    assert got.anchor_price_1h == pytest.approx(50 / 1e9, abs=1e-15)


def test_a_rebuild_takes_position_zero(spark):
    log = B.chain_log(spark, "/root/testdata/sf0.001")
    first = log.where("event_type = 'create'").agg(F.min("log_id")).first()[0]
    moved = log.where(F.col("log_id") >= first).withColumn("log_id", F.col("log_id") - first)
    state, _ = P.replay_from(moved, 0)
    want = sorted(map(repr, P.project_tokens(moved).collect()))
    assert sorted(map(repr, P.read_model(state)["tokens"].select(*P.project_tokens(moved).columns).collect())) == want


def test_small_buckets_share_files(spark):
    table = KeyedTable(scratch(spark, "keyed"), ["k"], limit=5)
    merge = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("x").alias("x"))
    table.upsert(spark.range(4000).selectExpr("concat('key', id) AS k", "1L AS x"), 0, merge)
    table.upsert(spark.range(100).selectExpr("concat('key', id) AS k", "1L AS x"), 1, merge)
    buckets = table.manifest.read(spark, 1)
    assert buckets.count() >= 800
    assert len(table._paths(buckets.collect())) <= 8
    for reader in (table, KeyedTable(table.path, ["k"])):
        assert reader.read(spark, 1).agg(F.sum("x"), F.count("*")).first()[:] == (4100, 4000)


@pytest.mark.parametrize("name", ["build_envelope", "read_tx_views", "pair_events"])
def test_events_are_not_sent_through_the_driver(spark, name):
    # a few bytes of a file become a record, a log line and its decoded fields
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize("name", ["board_labels", "merge_windows", "net_flow", "short_windows_normalized", "short_windows_reference_live", "stat_payload", "stats_from_points", "recent_points"])
def test_metadata_of_the_other_queries_is_not_sent_either(spark, name):
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize(
    "name",
    ["ingest_stream", "ingest_stream_late", "topic_fanout", "tracked_stream", "replay_then_live", "replay_then_live_restarted",
     "log_stream_followed", "paged_events_newest", "paged_events_after", "paged_events_after_asset"],
)
def test_parts_of_the_log_are_built_by_all_tasks(spark, monkeypatch, name):
    # a part is a range of positions, which lies in one or two splits: its rows are dealt before payloads are built
    plans, write = [], DataFrameWriter.parquet

    def spy(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    built = [p for p in plans if "props#" in p]
    assert built and all("Repartition 4, true" in p.split("Generate inline", 1)[1] for p in built)


def test_the_board_of_new_tokens_sends_at_most_its_page(spark):
    # the page of twelve rows may be sent; metadata, markets and numbers have a row per key
    assert plan(entry.queries()["board_new"](spark, "/root/testdata/sf0.01")).split("== Physical Plan ==")[1].count("BroadcastExchange") <= 1


def test_bitmaps_of_a_minute_take_no_more_room_than_its_trades(spark):
    # the third trader of 130 lies in the first word, the last one in the third; a fixed bitmap took 4,096 bytes each
    trades = spark.range(130).selectExpr("'A' AS asset_id", "id AS insert_seq", "60L AS event_unix_ts", "timestamp_seconds(60) AS event_time", "concat('u', id) AS user_address", "IF(id < 70, 'buy', 'sell') AS side")
    minutes = D.trader_minutes(trades, D.trader_codes(trades))
    assert sorted(r.part for r in minutes.collect()) == [0, 1, 2]
    sizes = minutes.selectExpr("octet_length(makers) AS m", "octet_length(buyers) AS b", "octet_length(sellers) AS s").collect()
    assert all(max(r) <= 8 for r in sizes)
    found = D.distinct_traders(D.merge_minutes(minutes, minutes), trades, D.trader_codes(trades), 3600)
    assert found.collect()[0][:] == ("A", 130, 70, 60)


def test_the_parts_of_a_detail_are_not_joined_in_one_stage(spark):
    # a sort holds a page of memory as long as its task runs; eight joins in a row held all of theirs at once
    whole = plan(entry.queries()["token_detail"](spark, "/root/testdata/sf0.01")).split("== Physical Plan ==")[1]
    depth, last = None, []
    for line in whole.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            continue
        depth = at if "Exchange " in line else None
        last.append(line)
    # the snapshot, its metadata and the parts
    assert sum("Sort [" in line for line in last) <= 4


@pytest.mark.parametrize("name", ["metrics_stream", "metrics_stream_ageing", "seeded_state"])
def test_metadata_of_the_rolling_streams_is_not_sent(spark, monkeypatch, name):
    # the points of the stream are priced by the metadata before they are written
    plans, write = [], DataFrameWriter.parquet

    def spy(self, *args, **kwargs):
        plans.append(plan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    joined = [p for p in plans if "p_partkey" in p]
    assert joined and not any("BroadcastExchange" in p for p in joined)


@pytest.mark.parametrize("name", ["metrics_stream", "metrics_stream_ageing"])
def test_points_of_the_rolling_streams_are_priced_once(spark, monkeypatch, name):
    # each part of the stream read the trades and the metadata and joined them again
    plans, write = [], DataFrameWriter.parquet

    def spy(self, *args, **kwargs):
        plans.append(plan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sum("p_partkey" in p for p in plans) == 1
