"""Hand-made tables for what the given data does not reach."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.constants import NATIVE_MINT as N
from tickloom.functions import display as D
from tickloom.functions import scalars as S
from tickloom.operators import board as G
from tickloom.operators import candles as C
from tickloom.operators import metrics as M
from tickloom.operators import project as P
from tickloom.operators import asof
from tickloom.operators.asof import asof_price
from tickloom.plans import bindings as B

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "side, amounts, out",
    [
        ("sell", ("100", None, None, "250"), ("buy", "250", "100")),
        ("buy_exact_quote_in", (None, "90", "200", None), ("sell", "200", "90")),
    ],
)
def test_swap_with_the_asset_on_the_quote_side(spark, side, amounts, out):
    lit = [F.lit(a).cast("string") for a in amounts]
    s = one(spark, S.orient_swap(F.lit("T"), F.lit(side), F.lit(N), F.lit("T"), *lit))
    assert (s.side, s.token_amount_raw, s.quote_amount_raw, s.counter_mint, s.error) == (*out, N, None)


@pytest.mark.parametrize(
    "raw, dec, out",
    [("123450000", 6, "123.45"), ("5", 3, "0.005"), ("-1500", 3, "-1.5"), ("0", 4, "0"), ("-0", 2, "0"), ("007", 1, "0.7"),
     ("abc", 3, "abc"), ("", 3, ""), ("100", 0, "100"), ("100", None, "100"), ("18446744073709551615", 9, "18446744073.709551615")],
)
def test_format_amount(spark, raw, dec, out):
    assert one(spark, S.format_amount(F.lit(raw), F.lit(dec).cast("int"))) == out


@pytest.mark.parametrize(
    "x, out",
    [(1.005, "1.00"), (2.675, "2.67"), (0.125, "0.1250"), (1.125, "1.13"), (999.995, "1000.00"), (1234.5, "1.23K"), (-2500000.0, "-2.50M"),
     (None, "--"), (float("nan"), "--"), (float("inf"), "--"), (31235.0, "31.23K"), (0.0, "0.0000")],
)
def test_compact_number(spark, x, out):
    assert one(spark, D.compact_number(F.lit(x).cast("double"))) == out


@pytest.mark.parametrize("x, out", [(0.0, "0.00"), (0.5, "0.5000"), (0.00123, "0.0₂1230"), (-3.4567e-7, "-0.0₆3456"), (1e-12, "0.0₁₁1000")])
def test_subscript_price(spark, x, out):
    assert one(spark, D.subscript_price(F.lit(x))) == out


def test_zero_amounts_do_not_raise(spark):
    assert one(spark, S.trade_price(F.lit(5), F.lit(0), F.lit(2), F.lit(2))) is None
    assert one(spark, S.exact_price(F.lit("0"), F.lit("5"), F.lit(2), F.lit(2))) is None
    assert one(spark, S.pct_change(F.lit(1.0), F.lit(0.0))) is None


POINT = "asset_id string, event_unix_ts long, slot long, insert_seq long, side string, price double, volume double"


def test_young_asset_takes_its_oldest_price_as_anchor(spark):
    now = 1700300000
    points = spark.createDataFrame([("a", now - 2400, 1, 1, "buy", 3e-7, 0.1), ("a", now - 10, 2, 2, "buy", 1e-5, 0.2)], POINT)
    row = M.stats_from_points(points, now).first()
    assert [row[f"anchor_price_{n}"] for n in ("1h", "4h", "24h")] == [3e-7] * 3
    assert row.buys_1m == 1 and row.anchor_price_1m == 3e-7


def test_seconds_that_close_at_zero_are_skipped(spark):
    points = spark.createDataFrame(
        [("a", 100, 1, 1, "buy", 2.0, 1.0), ("a", 110, 1, 2, "buy", 5.0, 1.0), ("a", 110, 1, 3, "sell", 0.0, 1.0)], POINT
    )
    row = M.short_windows(points, 120).first()
    assert (row.buys_1m, row.sells_1m, row.volume_1m, row.anchor_price_1m) == (1, 0, 1.0, 2.0)


def test_window_cutoff_is_exclusive(spark):
    points = spark.createDataFrame([("a", 100, 1, 1, "buy", 2.0, 1.0), ("a", 160, 1, 2, "x", 3.0, 1.0)], POINT)
    row = M.short_windows(points, 160, side_mode="normalized").first()
    assert (row.buys_1m, row.sells_1m, row.buys_5m) == (0, 1, 1)


def test_asof_over_one_hot_asset_matches_brute_force(spark):
    rng = random.Random(7)
    trades = [("hot", rng.randrange(0, 200000), i % 5, i, float(i)) for i in range(1500)]
    probes = [("hot", rng.randrange(-1000, 210000), i) for i in range(300)] + [("none", 5, 999)]
    t = spark.createDataFrame(trades, "asset_id string, event_unix_ts long, slot long, insert_seq long, price double").withColumn(
        "event_time", F.timestamp_seconds("event_unix_ts")
    )
    p = spark.createDataFrame(probes, "asset_id string, ts long, id long").select("asset_id", "id", F.timestamp_seconds("ts").alias("probe_time"))
    got = {r.id: r.price for r in asof_price(t, p, bucket_seconds=900).collect()}
    order = sorted(trades, key=lambda r: (r[1], r[2], r[3]))
    for asset, ts, i in probes:
        before = [r for r in order if r[1] <= ts and r[0] == asset]
        after = [r for r in order if r[1] >= ts and r[0] == asset]
        want = before[-1][4] if before else after[0][4] if after else None
        assert got[i] == want


@pytest.mark.parametrize("span", [60_000_000, 3])
def test_asof_within_one_crowded_minute(spark, span, monkeypatch):
    """All rows in one asset and minute, or even in three microseconds."""
    rng, start = random.Random(2), 1_700_000_040_000_000
    trades = [("hot", start + rng.randrange(span), i % 4, i, float(i) if i % 9 else None) for i in range(3000)]
    probes = [("hot", start + rng.randrange(-1, span + 1), i) for i in range(600)] + [("cold", start, 999)]
    t = spark.createDataFrame(trades, "asset_id string, us long, slot long, insert_seq long, price double")
    t = t.select("asset_id", F.timestamp_micros("us").alias("event_time"), F.floor(F.col("us") / 1_000_000).alias("event_unix_ts"), "slot", "insert_seq", "price")
    p = spark.createDataFrame(probes, "asset_id string, us long, id long").select("asset_id", "id", F.timestamp_micros("us").alias("probe_time"))
    sizes = []
    split = asof.split_crowded

    def seen(rows):
        parts = split(rows)
        sizes.extend(r[0] for r in parts.groupBy("_part").count().select("count").collect())
        return parts

    monkeypatch.setattr(asof, "split_crowded", seen)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.id: r.price for r in asof.asof_price(t, p, 3600, crowd=200).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted((r for r in trades if r[4] is not None), key=lambda r: r[1:4])
    for asset, us, i in probes:
        before = [r for r in order if r[1] <= us and r[0] == asset]
        after = [r for r in order if r[1] >= us and r[0] == asset]
        assert got[i] == (before[-1][4] if before else after[0][4] if after else None)
    # the largest part is a small multiple of an even share
    assert len(sizes) > 8 and max(sizes) <= 3 * sum(sizes) / 16


def test_state_does_not_depend_on_the_cut(spark):
    log = B.chain_log(spark, SF).where("log_id < 300").cache()
    whole = P.read_model(P.project_batch(log))
    cuts = sorted(random.Random(3).sample(range(1, 299), 2))
    parts = [log.where((F.col("log_id") >= a) & (F.col("log_id") < b)) for a, b in zip([0, *cuts], [*cuts, 300])]
    random.Random(5).shuffle(parts)
    state = P.project_batch(parts[0])
    for part in [*parts[1:], parts[1]]:
        state = P.merge_state(state, P.project_batch(part))
    for name, table in P.read_model(state).items():
        cols = sorted(table.columns)
        got, want = (sorted(map(str, t.select(*cols).collect())) for t in (table, whole[name]))
        assert got == want, name


def _event(log_id, event_type, payload):
    return (log_id, f"e{log_id}", "pumpfun", event_type, 1000 + log_id, 1, 0, "t", "logs", payload)


def test_a_close_before_the_market_opens_is_lost(spark):
    rows = [
        _event(1, "migrate", '{"mint":"m","bonding_curve":"c","pool":"p"}'),
        _event(2, "create", '{"mint":"m","bonding_curve":"c"}'),
        _event(3, "create", '{"mint":"n","bonding_curve":"d"}'),
        _event(4, "migrate", '{"mint":"n","bonding_curve":"d","pool":"q"}'),
    ]
    log = spark.createDataFrame(
        rows, "log_id long, event_id string, protocol string, event_type string, event_unix_ts long, slot long, tx_index long, tx_signature string, event_source string, payload string"
    ).withColumn("refs", F.expr("named_struct('mint', cast(null as string), 'creator', cast(null as string))"))
    ended = {r.market_id: r.ended_at for r in P.project_markets(log).collect()}
    assert ended == {"c": None, "p": None, "d": 1004, "q": None}
    stage = {r.asset_id: r.current_stage for r in P.project_tokens(log).collect()}
    assert stage == {"m": "bonding_curve", "n": "pool"}


def test_realtime_union_covers_every_bucket_once(spark):
    trades = B.ev_trades(spark, SF)
    whole = C.candles(trades, 900)
    union = C.realtime_union(whole, trades, 1705000000, 900)
    assert union.count() == whole.count() == union.select("asset_id", "bucket").distinct().count()


def test_search_blank_text_finds_nothing(spark):
    tokens = spark.createDataFrame([("a", 1)], "asset_id string, first_seen_at long")
    meta = spark.createDataFrame([("a", "x", "y", None)], "asset_id string, name string, symbol string, image_uri string")
    metrics = spark.createDataFrame([("a", 1.0)], "asset_id string, latest_price double")
    assert G.search(tokens, meta, metrics, "   ").count() == 0
    assert G.search(tokens, meta, metrics, "X").first().rank == 2


def test_board_window_names():
    assert G.window_name(" 1D ") == "24h" and G.view_name("x") == "hot"
    with pytest.raises(ValueError):
        G.window_name("2h")
