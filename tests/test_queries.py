"""Registered queries beside their SQL; TICKLOOM_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = os.environ.get("TICKLOOM_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "daily_ohlcv", "candles_1m", "rollup_candles_4h", "candles_any", "refresh_candles", "continuous_candles", "long_windows",
    "short_windows_strict", "current_metrics", "trade_summary", "stats_from_points", "asof_price", "format_amount",
    "orient_swap", "compact_number", "append_log", "dead_letters", "tracked_only", "project_tokens", "project_markets",
    "merge_state_trades", "board_new", "activity_page_next", "feed_merge_prepend", "pair_events", "candle_stream", "late_trades",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("TICKLOOM_ALL") else SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
