"""Streams and stored tables: ageing windows, chained bars, reloads, retries."""

import os
import random
import shutil
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.operators import project as P
from tickloom.plans import bindings as B
from tickloom.session import scratch
from tickloom.streaming import pipelines as S
from tickloom.streaming import rolling
from tickloom.streaming.bars import BarTable, reload_late
from tickloom.streaming.keyed import KeyedTable
from tickloom.streaming.rolling import metrics_stream
from tickloom.streaming.tables import VersionedTable, drain

POINT = "asset_id string, event_unix_ts long, insert_seq long, side string, price double, volume double"
TRADE = "asset_id string, event_unix_ts long, event_time timestamp, insert_seq long, quote_mint string, token_amount_raw long, quote_amount_raw long"
T0 = 1_700_000_000
SF = "/root/testdata/sf0.001"


def fed(spark, rows, schema, cuts):
    """The rows as a stream, a part per batch, in the order given."""
    path, edges = scratch(spark, "source"), [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- windows that age out -----------------------------------------------------------


def points(seed=1):
    rng = random.Random(seed)
    rows, t = [], T0
    for k in range(120):
        t += rng.choice([0, 1, 5, 20, 200])
        # A goes idle half way while B trades on
        rows.append((rng.choice("AB") if k < 60 else "B", t, k, rng.choice(["buy", "sell", "odd"]), rng.choice([0.0, 1.0, 2.5, None]), float(rng.randint(1, 9))))
    return rows


def expected(rows, windows, delay):
    rows = [r for r in rows if r[4] is not None]
    top = max(r[1] for r in rows)
    out = {}
    for asset in "AB":
        mine = [r for r in rows if r[0] == asset]
        seconds = {}
        for r in mine:
            seconds.setdefault(r[1], []).append(r)
        live = {s: x for s, x in seconds.items() if x[-1][4] != 0}
        for t in {s + w for s in live for w in windows.values() if s + w < top - delay}:
            row = {"latest_price": max((s, x[-1][4]) for s, x in seconds.items() if s <= t)[1]}
            for n, w in windows.items():
                part = [x for s, x in sorted(live.items()) if t - w < s <= t]
                flat = [r for x in part for r in x]
                row |= {f"buys_{n}": sum(r[3] == "buy" for r in flat), f"sells_{n}": sum(r[3] != "buy" for r in flat), f"volume_{n}": sum(r[5] for r in flat)}
                row[f"anchor_price_{n}"] = next((r[4] for r in part[0] if r[4] != 0), 0.0) if part else None
            out[asset, t] = row
    return out


def aged(spark, rows, cuts, windows, delay, checkpoint=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = VersionedTable(scratch(spark, "aged"))
    out = metrics_stream(fed(spark, rows, POINT, cuts), windows, delay=f"{delay} seconds", ageing=True)
    drain(out.writeStream.outputMode("update").foreachBatch(lambda df, i: table.write(df, i)), scratch(spark, "checkpoint"))
    return table.all(spark).where("final").collect()


@pytest.mark.parametrize("cuts", [[], [40, 60, 61, 100]])
def test_windows_age_out(spark, cuts):
    rows, windows = points(), {"1m": 60, "5m": 300}
    found = aged(spark, rows, cuts, windows, 30)
    want = expected(rows, windows, 30)
    assert len(found) == len(want) and {(r.asset_id, r.as_of) for r in found} == set(want)
    for r in found:
        row = r.asDict()
        for name, value in want[r.asset_id, r.as_of].items():
            assert row[name] == value or row[name] is None and value is None or value is None and row[name] != row[name], (r, name, value)
    # the idle asset's windows end empty
    last = max((r for r in found if r.asset_id == "A"), key=lambda r: r.as_of)
    assert last.buys_5m == last.sells_5m == 0 and last.volume_5m == 0


# --- bars ---------------------------------------------------------------------------


def trades(seed=2, n=400, days=4):
    rng = random.Random(seed)
    out, t = [], T0
    for k in range(n):
        t += rng.randint(0, 2 * days * 86400 // n)
        out.append((rng.choice("AB"), t, datetime.fromtimestamp(t, timezone.utc), k, rng.choice("QR"), rng.choice([0, 3, 10]), rng.randint(1, 99)))
    return out


def bars_of(rows, size):
    out = {}
    for r in sorted((r for r in rows if r[5]), key=lambda r: r[3]):
        out.setdefault((r[0], r[1] - r[1] % size), []).append(r)
    return {k: (x[0][6] / x[0][5], max(r[6] / r[5] for r in x), min(r[6] / r[5] for r in x), x[-1][6] / x[-1][5], min(r[4] for r in x), sum(r[6] for r in x)) for k, x in out.items()}


def shown(df):
    return {(r.asset_id, r.bucket): (r.open_raw_price, r.high_raw_price, r.low_raw_price, r.close_raw_price, r.quote_mint_sample, r.volume_quote_raw) for r in df.collect()}


def test_rollups_drop_what_is_later_than_the_delay(spark):
    rows = trades(n=200, days=1)
    late = ("A", T0 - 5 * 86400, datetime.fromtimestamp(T0 - 5 * 86400, timezone.utc), 900, "Q", 1, 77)
    table = VersionedTable(scratch(spark, "bars"))
    out = S.rollup_stream(fed(spark, [*rows[:150], *rows[150:], late], TRADE, [150, 200]), (60, 300, 3600), "600 seconds")
    drain(out.writeStream.outputMode("append").foreachBatch(lambda df, i: table.write(df, i)), scratch(spark, "checkpoint"))
    top = max(r[1] for r in rows if r[5])
    for size in (60, 300, 3600):
        want = {k: v for k, v in bars_of(rows, size).items() if k[1] + size <= top - 600}
        assert shown(table.all(spark).where(F.col("size") == size)) == want and want


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_days_are_written(spark):
    rows = trades()
    late = [r for r in rows if r[1] // 86400 == T0 // 86400 + 1][::3]
    table = BarTable(scratch(spark, "bars"), 3600)
    table.create(C.candles(spark.createDataFrame([r for r in rows if r not in late], TRADE), 3600))
    before = files(table.path)
    every = spark.createDataFrame(rows, TRADE)
    dirty = spark.createDataFrame(late, TRADE).select("asset_id", (F.col("event_unix_ts") - F.col("event_unix_ts") % 3600).alias("bucket")).distinct()
    assert table.reload(every, dirty, 0) == [T0 // 86400 + 1]
    after, day = files(table.path), f"day={T0 // 86400 + 1}"
    assert {f for f in before if day not in f} == {f for f in after if day not in f} and not {f for f in before if day in f} & set(after)
    assert all(after[f] == before[f] for f in before if day not in f)
    assert shown(table.read(spark)) == bars_of(rows, 3600)
    assert table.reload(every, dirty, 0) == [] and files(table.path) == after


def test_a_reload_that_broke_off_is_replayed(spark, monkeypatch):
    rows = trades()
    table = BarTable(scratch(spark, "bars"), 3600)
    table.create(C.candles(spark.createDataFrame(rows[:300], TRADE), 3600))
    every = spark.createDataFrame(rows, TRADE)
    keys = spark.createDataFrame(rows[300:], TRADE).select("asset_id", (F.col("event_unix_ts") - F.col("event_unix_ts") % 3600).alias("bucket")).distinct()

    def lost(frame):
        # a day is deleted and its new files never come
        shutil.rmtree(f"{table.path}/day={rows[300][1] // 86400}")
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_replace", lost)
    with pytest.raises(RuntimeError):
        table.reload(every, keys, 4)
    monkeypatch.undo()
    assert shown(table.read(spark)) != bars_of(rows, 3600)
    assert table.reload(every.limit(0), keys.limit(0), 4)
    assert shown(table.read(spark)) == bars_of(rows, 3600)


def test_dirty_buckets_are_consumed_once(spark):
    rows = trades()
    marks = VersionedTable(f"{scratch(spark, 'late')}/dirty")
    table = BarTable(scratch(spark, "bars"), 3600)
    table.create(C.candles(spark.createDataFrame(rows[:100], TRADE), 3600))
    for v, (a, b) in enumerate([(100, 250), (250, 400)]):
        part = spark.createDataFrame(rows[a:b], TRADE)
        marks.write(part.select("asset_id", (F.col("event_unix_ts") - F.col("event_unix_ts") % 3600).alias("bucket")).distinct(), v)
        assert reload_late(spark, table, spark.createDataFrame(rows[:b], TRADE), marks.path[: -len("/dirty")])
        assert shown(table.read(spark)) == bars_of(rows[:b], 3600)
    assert reload_late(spark, table, spark.createDataFrame(rows[:1], TRADE), marks.path[: -len("/dirty")]) == []
    assert shown(table.read(spark)) == bars_of(rows, 3600)


def test_refresh_leaves_open_and_old_buckets(spark):
    rows = trades()
    now = rows[-1][1]
    table = BarTable(scratch(spark, "bars"), 3600)
    table.create(C.candles(spark.createDataFrame(rows[::2], TRADE), 3600))
    every = spark.createDataFrame(rows, TRADE)
    table.refresh(every, spark.createDataFrame(rows[1::2], TRADE), now, 0, lookback=2 * 86400)
    want = C.refresh_candles(C.candles(spark.createDataFrame(rows[::2], TRADE), 3600), every, spark.createDataFrame(rows[1::2], TRADE), now, 3600, 2 * 86400)
    assert shown(table.read(spark)) == shown(want)


# --- tables in hash buckets ---------------------------------------------------------


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("x").alias("x"))


def test_keyed_table_against_a_dict(spark):
    rng, want = random.Random(4), {}
    table = KeyedTable(scratch(spark, "keyed"), ["k"], limit=30)
    for v, n in enumerate([40, 0, 150, 1]):
        part = [(rng.choice([None, *(f"k{i}" for i in range(60 * (v + 1)))]), rng.randint(1, 9)) for _ in range(n)]
        part = list({k: (k, x) for k, x in part}.values())
        table.upsert(spark.createDataFrame(part, "k string, x long"), v, add)
        for k, x in part:
            want[k] = want.get(k, 0) + x
        buckets = table.manifest.read(spark, v).collect()
        assert sum(b.n for b in buckets) == len(want) and max(b.n for b in buckets) <= 60
        # the buckets cover every hash once
        assert sum(2.0**-b.depth for b in buckets) == 1
        if want:
            assert dict(map(tuple, table.read(spark, v).select("k", "x").collect())) == want
    assert max(b.depth for b in buckets) > 1


def test_a_batch_touches_its_own_buckets(spark):
    table = KeyedTable(scratch(spark, "keyed"), ["k"], limit=500)
    table.upsert(spark.range(40_000).selectExpr("concat('key', id) AS k", "id AS x"), 0, add)
    whole = size_of(table.data.at(0))
    read = []
    for v in range(1, 4):
        delta = spark.range(5).selectExpr(f"concat('key', id * 131 + {v}) AS k", "1L AS x")
        read.append(len(table.touched(delta, v)[1]))
        table.upsert(delta, v, add)
        assert size_of(table.data.at(v)) < whole / 8
    assert max(read) <= 5
    assert table.read(spark, 3).agg(F.sum("x")).first()[0] == 39_999 * 20_000 + 15


def test_a_killed_version_is_written_again(spark, monkeypatch):
    table = KeyedTable(scratch(spark, "keyed"), ["k"], limit=20)
    table.upsert(spark.range(100).selectExpr("concat('key', id) AS k", "id AS x"), 0, add)
    delta = spark.range(30).selectExpr("concat('key', id) AS k", "1L AS x")
    monkeypatch.setattr(table.manifest, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.upsert(delta, 1, add)
    monkeypatch.undo()
    assert table.read(spark, 0).agg(F.sum("x")).first()[0] == 4950
    for _ in range(2):  # a version that is there may come again, too
        table.upsert(delta, 1, add)
        assert table.read(spark, 1).agg(F.sum("x"), F.count("*")).first()[:] == (4980, 100)


def chain_log(spark):
    return B.chain_log(spark, SF)


def test_ids_read_per_batch_stay_flat(spark, monkeypatch):
    log = chain_log(spark).orderBy("log_id").limit(300).cache()
    ids = sorted(r[0] for r in log.select("log_id").collect())
    source = scratch(spark, "source")
    for a in range(0, 300, 60):
        part = log.where(F.col("log_id").between(ids[a], ids[a + 59]))
        (part.unionByName(log.where(F.col("log_id").between(ids[max(a - 30, 0)], ids[a])))).coalesce(1).write.mode("append").parquet(source)
    path, read = scratch(spark, "log"), []
    touched = KeyedTable.touched

    def seen(self, delta, version):
        out = touched(self, delta, version)
        read.append((version, max(sum(b.n for b in out[1]), 0)))
        return out

    monkeypatch.setattr(KeyedTable, "touched", seen)
    S.ingest_exact(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source), path, scratch(spark, "checkpoint"), limit=1)
    # a bucket holds one id or two, so a batch of 91 ids reads about as many however long the log is
    assert max(n for _, n in read) <= 2 * 91
    rows = VersionedTable(path).all(spark)
    assert rows.count() == 300 == rows.select("event_id").distinct().count()


def test_projection_survives_a_kill(spark, monkeypatch):
    log = chain_log(spark)
    top = log.agg(F.max("log_id")).first()[0]
    source, path, checkpoint = scratch(spark, "source"), scratch(spark, "model"), scratch(spark, "checkpoint")
    for low, high in ((0, top // 2), (top // 2, top + 1)):
        log.where((F.col("log_id") >= low) & (F.col("log_id") < high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write, killed = VersionedTable.write, []

    def fails(self, df, version):
        if version == 1 and self.path.endswith("markets/manifest") and not killed:
            killed.append(1)
            raise RuntimeError("killed")
        write(self, df, version)

    monkeypatch.setattr(VersionedTable, "write", fails)
    with pytest.raises(Exception, match="killed"):
        S.project_stream(stream, path, checkpoint, limit=8)
    assert killed and VersionedTable(f"{path}/mark").newest(spark) == 0
    version = S.project_stream(stream, path, checkpoint, limit=8)
    want = P.read_model(P.project_batch(log))
    for name, table in S.projected(spark, path, version).items():
        assert table.exceptAll(want[name].select(table.columns)).count() == 0 and table.count() == want[name].count(), name


# --- calls to the state store -------------------------------------------------------


class CountedState:
    """A map or value state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def get(self):
        self.calls.append("get")
        return self.held.get(())

    def update(self, value):
        self.calls.append("update")
        self.held[()] = value

    def getValue(self, key):
        self.calls.append("getValue")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.held[key] = value

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self.held


class CountedHandle:
    def __init__(self):
        self.calls = []

    def getMapState(self, *args):
        return CountedState(self.calls)

    def getValueState(self, *args):
        return CountedState(self.calls)

    def registerTimer(self, at):
        self.calls.append("registerTimer")

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")


def test_calls_to_the_store_follow_the_assets_and_not_their_seconds():
    handle, processor = CountedHandle(), rolling.RollingMetrics({"1m": 60, "1h": 3600}, ageing=True)
    processor.init(handle)
    rows = pd.DataFrame([
        {"asset_id": a, "second": T0 + s, "open_price": 1.0 + s, "open_seq": s, "close_price": 2.0 + s, "close_seq": s, "buys": 1, "sells": 0, "volume": 0.5, "buy_volume": 0.5, "sell_volume": 0.0}
        for s in range(200) for a in "ABC"
    ])
    for part in (rows[rows.second < T0 + 100], rows[rows.second >= T0 + 100]):
        handle.calls.clear()
        (out,) = processor.handleInputRows((7,), iter([part]), None)
        assert sorted(out.asset_id) == ["A", "B", "C"] and (out.as_of == part.second.max()).all()
        assert len(handle.calls) <= 2 + 2 * 3 + 2
    assert (out.buys_1m == 60).all() and (out.buys_1h == 200).all() and (out.anchor_price_1m == 1.0 + 140).all()


def test_packed_seconds_are_summed_as_frames_are():
    rng = np.random.default_rng(9)
    n = 300
    rows = pd.DataFrame({"asset_id": "A", "second": T0 + rng.integers(0, 60, n), "open_price": rng.choice([0.0, 1.5, 2.5], n), "open_seq": rng.permutation(n), "close_price": rng.random(n), "close_seq": rng.permutation(n)})
    rows = rows.assign(buys=rng.integers(0, 3, n), sells=1, volume=rng.integers(0, 9, n) / 8, buy_volume=0.25, sell_volume=0.5)
    want = rolling.packed(rolling.combine(rows).sort_values("second"))
    assert rolling.merged(rolling.packed(rows)).tolist() == want.tolist()
    assert len(rolling.merged(rolling.packed(rows[:0]))) == 0
