"""Paged logs, gram search, trader bitmaps and the log as a stream, against plain versions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import board as G
from tickloom.operators import grams as I
from tickloom.operators import traders as D
from tickloom.session import scratch
from tickloom.sources.logstream import LogReader, log_stream
from tickloom.sources.pages import PagedLog
from tickloom.streaming import pipelines as S
from tickloom.streaming.tables import VersionedTable

LOG = "log_id long, event_id string, asset_id string"


# --- paged log ----------------------------------------------------------------------


def log_rows(n=6000, seed=3):
    rng = random.Random(seed)
    # one asset holds a third of all rows, some hold one
    return [(i, f"e{i}", "hot" if i % 3 == 0 else f"a{rng.randrange(60)}" if i % 97 else f"rare{i}") for i in range(n)]


@pytest.fixture(scope="module")
def paged(spark):
    rows = log_rows()
    store = PagedLog(scratch(spark, "paged"))
    late = [r for r in rows if 2000 <= r[0] < 2500]
    store.append(spark.createDataFrame([r for r in rows if r not in late], LOG), 0, 60)
    store.append(spark.createDataFrame(late, LOG), 1, 40)
    return rows, store


@pytest.mark.parametrize("key", ["hot", "a7", "rare97", "none"])
def test_pages(spark, paged, key):
    rows, store = paged
    mine = [r for r in rows if r[2] == key]
    for cursor in (None, 0, 100, 2400, 2501, 5999, 9999):
        below = [r for r in mine if cursor is None or r[0] < cursor]
        assert [tuple(r) for r in store.newest(spark, key, 30, cursor).select("log_id", "event_id", "asset_id").collect()] == below[::-1][:30]
        position = -1 if cursor is None else cursor
        assert [tuple(r) for r in store.after(spark, position, 30, key).select("log_id", "event_id", "asset_id").collect()] == [r for r in mine if r[0] > position][:30]


def test_a_page_opens_few_files(spark, paged):
    rows, store = paged
    assert len(store.rows.all(spark).inputFiles()) >= 60
    for page in (store.newest(spark, "hot", 20, 3000), store.newest(spark, "a7", 20), store.after(spark, 2100, 20, "hot")):
        assert page.count() == 20
        assert len(page.inputFiles()) <= 8
        node = page._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in node and "EqualTo(asset_id" in node


def test_a_part_written_again_replaces_itself(spark):
    store = PagedLog(scratch(spark, "paged"), None)
    part = spark.createDataFrame(log_rows(50), LOG)
    store.append(part, 0, 3)
    store.append(part, 0, 5)
    assert [r.log_id for r in store.after(spark, 10, 100).collect()] == list(range(11, 50))


# --- gram search --------------------------------------------------------------------


def test_indexed_search_equals_the_scan(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aAbBé-% _") for _ in range(n))
    tokens = spark.createDataFrame([(f"{word(4)}{i}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(50))) for i in range(300)], "asset_id string, first_seen_at timestamp")
    names = [(r.asset_id, rng.choice([None, "", word(9)]), rng.choice([None, word(4)]), None) for r in tokens.collect()[::2]]
    meta = spark.createDataFrame(names, "asset_id string, name string, symbol string, image_uri string")
    metrics = tokens.select("asset_id", F.lit(1.0).alias("latest_price"))
    path = scratch(spark, "grams")
    I.write_index(I.gram_index(tokens, meta), path)
    index = spark.read.parquet(path)
    some = [n[1][2:6] for n in names if n[1]][:4]
    for text in [*some, "ab", " BaB ", "b_a", "aab%b", "é-a", "", "   ", "zzzz", "%%%", "ab%12"]:
        want = G.search(tokens, meta, metrics, text, 15).collect()
        assert I.search_indexed(index, tokens, meta, metrics, text, 15).collect() == want, text
    found = I.candidates(index, some[0].replace("%", "a").replace("_", "a"))
    assert found.count() < 300


# --- distinct traders ---------------------------------------------------------------


def test_distinct_traders(spark):
    rng, t0 = random.Random(1), datetime(2024, 3, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(1500):
        at = t0 + timedelta(microseconds=rng.randrange(3 * 86400 * 10**6))
        user = "bot" if i % 3 == 0 else None if i % 50 == 1 else f"u{rng.randrange(200)}"
        rows.append((rng.choice("AAAB"), at, int(at.timestamp()), i, user, rng.choice(["buy", "sell", "odd"])))
    schema = "asset_id string, event_time timestamp, event_unix_ts long, insert_seq long, user_address string, side string"
    trades = spark.createDataFrame(rows, schema)
    for cuts in ([0, 1500], [0, 10, 700, 1500]):
        codes, minutes = None, []
        for a, b in zip(cuts, cuts[1:]):
            part = spark.createDataFrame(rows[a:b], schema)
            before = codes
            codes = spark.createDataFrame(D.trader_codes(part, codes).collect(), "asset_id string, user_address string, code long")
            if before is not None:
                assert before.exceptAll(codes).count() == 0
            minutes.append(spark.createDataFrame(D.trader_minutes(part, codes).collect(), "asset_id string, bucket long, part long, makers binary, buyers binary, sellers binary"))
        for asset in "AB":
            held = sorted(r.code for r in codes.where(F.col("asset_id") == asset).collect())
            assert held == list(range(len(held)))
        for span in (60, 3600, 86400, 10 * 86400):
            found = {r.asset_id: (r.makers, r.buyers, r.sellers) for r in D.distinct_traders(D.merge_minutes(*minutes, minutes[0]), trades, codes, span).collect()}
            for asset in "AB":
                last = max(r[1] for r in rows if r[0] == asset)
                mine = [r for r in rows if r[0] == asset and r[1] > last - timedelta(seconds=span) and r[4]]
                want = tuple(len({r[4] for r in mine if side in (None, r[5])}) for side in (None, "buy", "sell"))
                assert found.get(asset, (0, 0, 0)) == want


# --- the log as a stream ------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("log_id", T.LongType()), T.StructField("event_id", T.StringType()), T.StructField("asset_id", T.StringType()), T.StructField("refs", T.StructType([T.StructField("mint", T.StringType())]))])


def stored(spark, path, rows):
    spark.createDataFrame([(*r, (r[2],)) for r in rows], SCHEMA).coalesce(2).write.mode("append").parquet(path)


def test_restarts_and_redelivery(spark):
    rows = log_rows(900)
    source, path, checkpoint = scratch(spark, "log"), scratch(spark, "feed"), scratch(spark, "checkpoint")
    for a, b in ((0, 400), (350, 600), (100, 600), (600, 900)):
        stored(spark, source, rows[a:b])
        S.follow(log_stream(spark, source, SCHEMA, 42, 64), path, checkpoint)
        S.follow(log_stream(spark, source, SCHEMA, 42, 64), path, checkpoint)  # idle
        got = sorted(r.log_id for r in VersionedTable(path).all(spark).collect())
        assert got == list(range(43, max(b, 600) if a == 100 else b))


def test_one_asset_of_the_stream(spark):
    rows = log_rows(300)
    source, path = scratch(spark, "log"), scratch(spark, "feed")
    stored(spark, source, rows + rows[:50])
    S.follow(log_stream(spark, source, SCHEMA), path, scratch(spark, "checkpoint"), asset="hot")
    found = VersionedTable(path).all(spark).collect()
    assert sorted(r.log_id for r in found) == [r[0] for r in rows if r[2] == "hot" and r[0] > 0] and {r.refs.mint for r in found} == {"hot"}


def test_batches_are_cut_into_pages(spark):
    source = scratch(spark, "log")
    for a in range(0, 1000, 100):
        stored(spark, source, log_rows(1000)[a : a + 100])
    reader = LogReader(SCHEMA, source, 0, 200)
    assert reader.latestOffset() == {"log_id": 999}
    pages = reader.partitions({"log_id": 150}, {"log_id": 850})
    assert len(pages) >= 3
    seen = [i for p in pages for batch in reader.read(p) for i in batch.column("log_id").to_pylist()]
    assert sorted(seen) == list(range(151, 851))
    assert LogReader(SCHEMA, source + "-none", 7, 10).latestOffset() == {"log_id": 7}
