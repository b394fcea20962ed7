"""Streaming forms of ingest, projection, candles and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import bucket_start
from ..functions.scalars import empty_to_null, raw_price, strict_other_side, topic_asset
from ..operators import project as P
from ..operators.common import first_per_key, spread_join
from ..sources.log import append_log, classify, parse_payload, payload_error
from .keyed import LIMIT, KeyedTable
from .tables import VersionedTable, drain


def with_event_time(log: DataFrame) -> DataFrame:
    return log.withColumn("event_time", F.timestamp_seconds("event_unix_ts"))


# --- ingest -------------------------------------------------------------------------


def ingest_stream(source: DataFrame, delay: str | None = None) -> DataFrame:
    """Known kinds only, each event id once, events of any age included.

    The state then holds every id. With a ``delay`` it is dropped behind the watermark, and so
    is every event that arrives later than that: use it where the source bounds lateness, or
    ``ingest_exact``, which keeps the ids in the log itself.
    """
    known = parse_payload(source, []).where(payload_error().isNull()).drop("doc")
    if delay is None:
        return with_event_time(known).dropDuplicates(["event_id"])
    return with_event_time(known).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def ingest_exact(source: DataFrame, path: str, checkpoint: str, limit: int = LIMIT) -> int:
    """Insert-once with no time limit: every batch is checked against the ids of the log written so far.

    The ids are kept beside the log, in hash buckets of at most ``limit``. A batch reads and writes the buckets
    its own ids fall in, so its cost stays flat as the log grows. The ids are written after the
    rows; a batch that broke off in between is checked against the ids before it, as if it were new.
    """
    table, ids = VersionedTable(path), KeyedTable(f"{path.rstrip('/')}-ids", ["event_id"], limit)

    def step(batch: DataFrame, batch_id: int) -> None:
        known = parse_payload(batch, []).where(payload_error().isNull()).drop("doc")
        fresh = first_per_key(known, ["event_id"], F.col("log_id"))
        seen = ids.touched(fresh.select("event_id"), batch_id)[2]
        table.write(append_log(fresh, seen), batch_id)
        ids.upsert(table.read(batch.sparkSession, batch_id).select("event_id"), batch_id, lambda old, new: old.unionByName(new))

    return drain(source.writeStream.foreachBatch(step), checkpoint)


def split_dead_letters(source: DataFrame) -> DataFrame:
    """Events that cannot be projected, with the reason, as a stream for a second sink."""
    return classify(source).where("reason IS NOT NULL").select(*source.columns, "reason")


def topic_fanout(source: DataFrame) -> DataFrame:
    """Each event once for its asset's topic, where the asset is known, and once for 'global'."""
    doc = parse_payload(source, ["mint", "base_mint", "quote_mint"])
    asset = empty_to_null(topic_asset(F.col("refs.mint"), F.col("doc.mint"), F.col("doc.base_mint"), F.col("doc.quote_mint")))
    topics = F.array_compact(F.array(F.concat(F.lit("token:"), asset), F.lit("global")))
    return doc.select(*source.columns, F.explode(topics).alias("topic"))


# --- projection ---------------------------------------------------------------------


def state_tables(path: str, limit: int = LIMIT) -> dict[str, KeyedTable]:
    return {name: KeyedTable(f"{path}/{name}", [P.KEYS[name]], limit) for name in P.RULES}


def project_stream(source: DataFrame, path: str, checkpoint: str, limit: int = LIMIT) -> int:
    """Continuous projection; returns the version the state stands at, after an idle run too.

    Each batch merges into the state before it and writes under its own id, of the state tables only
    the hash buckets its keys fall in; the high-water mark is written last, so a reader that starts from the
    mark never sees half a batch. Facts are appended.
    """
    states = state_tables(path, limit)
    facts = {name: VersionedTable(f"{path}/{name}") for name in P.FACTS}
    marks = VersionedTable(f"{path}/mark")

    def step(batch: DataFrame, batch_id: int) -> None:
        delta = P.project_batch(batch)
        for name, table in states.items():
            # projected once, though it is looked at for its keys and for its values
            staged = VersionedTable(f"{path}/{name}/delta")
            staged.write(delta[name], batch_id)
            table.upsert(staged.read(batch.sparkSession, batch_id), batch_id, partial(P.merge_table, name))
        for name, table in facts.items():
            table.write(delta[name], batch_id)
        marks.write(batch.agg(F.max("log_id").alias("last_log_id")), batch_id)

    drain(source.writeStream.foreachBatch(step), checkpoint)
    return marks.newest(source.sparkSession)


def projected(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame]:
    """The read model at a version."""
    state = {name: table.read(spark, version) for name, table in state_tables(path).items()}
    for name in P.FACTS:
        rows = VersionedTable(f"{path}/{name}").all(spark).where(F.col("v") <= version).drop("v")
        state[name] = first_per_key(rows, ["event_time", "event_id"], F.col("insert_seq"))
    return P.read_model(state)


# --- candles ------------------------------------------------------------------------


def candle_stream(trades: DataFrame, size: int = 60, delay: str = "1 hour") -> DataFrame:
    """Live bars; a trade later than the delay is dropped here and left to ``late_trades``."""
    priced = trades.where("token_amount_raw <> 0").withWatermark("event_time", delay)
    price = raw_price(F.col("quote_amount_raw"), F.col("token_amount_raw"))
    return (
        priced.withColumn("price", price)
        .groupBy("asset_id", F.window("event_time", f"{size} seconds").alias("w"))
        .agg(
            F.min_by("price", "insert_seq").alias("open_raw_price"),
            F.max("price").alias("high_raw_price"),
            F.min("price").alias("low_raw_price"),
            F.max_by("price", "insert_seq").alias("close_raw_price"),
            F.min("quote_mint").alias("quote_mint_sample"),
            F.sum("quote_amount_raw").alias("volume_quote_raw"),
        )
        .select("asset_id", F.unix_seconds("w.start").alias("bucket"), "open_raw_price", "high_raw_price", "low_raw_price", "close_raw_price", "quote_mint_sample", "volume_quote_raw")
    )


def rollup_stream(trades: DataFrame, sizes: Sequence[int] = (60, 300, 3600), delay: str = "1 hour") -> DataFrame:
    """Closed bars of several sizes, each size from the next finer one, in one stream with column ``size``.

    A bar of the finest size is closed when the watermark passes its end, and its end is the time by which the
    next size closes, so the watermark is carried up the chain. Bars come out once, in append mode. Each
    size is a chain of its own: a size repeats the state of the finer ones below it, whose rows are bars.
    """
    parts = []
    for top in range(len(sizes)):
        timed = trades.where("token_amount_raw <> 0").withColumn("price", raw_price(F.col("quote_amount_raw"), F.col("token_amount_raw")))
        bars = (
            timed.withWatermark("event_time", delay)
            .groupBy("asset_id", F.window("event_time", f"{sizes[0]} seconds").alias("w"))
            .agg(
                F.min_by("price", "insert_seq").alias("open_raw_price"),
                F.max("price").alias("high_raw_price"),
                F.min("price").alias("low_raw_price"),
                F.max_by("price", "insert_seq").alias("close_raw_price"),
                F.min("quote_mint").alias("quote_mint_sample"),
                F.sum("quote_amount_raw").alias("volume_quote_raw"),
            )
        )
        for size in sizes[1 : top + 1]:
            bars = (
                bars.withColumn("at", F.col("w.start"))
                .groupBy("asset_id", F.window("w", f"{size} seconds").alias("w"))
                .agg(
                    F.min_by("open_raw_price", "at").alias("open_raw_price"),
                    F.max("high_raw_price").alias("high_raw_price"),
                    F.min("low_raw_price").alias("low_raw_price"),
                    F.max_by("close_raw_price", "at").alias("close_raw_price"),
                    F.min("quote_mint_sample").alias("quote_mint_sample"),
                    F.sum("volume_quote_raw").alias("volume_quote_raw"),
                )
            )
        bucket = F.unix_seconds("w.start").alias("bucket")
        parts.append(bars.select("asset_id", F.lit(sizes[top]).alias("size"), bucket, *(c for c in bars.columns if c not in ("asset_id", "w"))))
    return reduce(DataFrame.unionByName, parts)


def split_late(batch: DataFrame, opened: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Trades at or after their asset's open bucket, and the buckets of the late ones.

    ``opened`` has one row per asset: the newest bucket before this batch.
    """
    timed = batch.withColumn("bucket", bucket_start(F.col("event_unix_ts"), size))
    placed = spread_join(timed, opened, ["asset_id"], "left")
    late = F.coalesce(F.col("bucket") < F.col("open_bucket"), F.lit(False))
    return placed.where(~late).drop("open_bucket"), placed.where(late).select("asset_id", "bucket").distinct()


def late_trades(source: DataFrame, path: str, checkpoint: str, size: int = 60) -> int:
    """Mark the buckets of late trades for reload, per batch, in ``path``/dirty.

    ``path``/open holds each asset's newest bucket. The dirty buckets feed ``refresh_candles``.
    """
    opened, dirty = VersionedTable(f"{path}/open"), VersionedTable(f"{path}/dirty")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = bucket_start(F.col("event_unix_ts"), size)
        newest = batch.groupBy("asset_id").agg(F.max(bucket).alias("open_bucket"))
        before = opened.before(spark, batch_id, newest)
        dirty.write(split_late(batch, before, size)[1], batch_id)
        after = before.unionByName(newest).groupBy("asset_id").agg(F.max("open_bucket").alias("open_bucket"))
        opened.write(after, batch_id)

    return drain(source.writeStream.foreachBatch(step), checkpoint)


# --- feeds --------------------------------------------------------------------------


def replay_then_live(log: DataFrame, live: DataFrame, since: int, path: str, checkpoint: str, asset: str | None = None) -> int:
    """History after ``since``, then live rows above what the replay reached, in one table.

    No row is missed or repeated: the replay's last position is the live filter. It is stored
    beside the table, after the history, so a restart goes on from it; a row delivered again is
    looked up among the stored rows of the batch's range of positions.
    """
    spark = log.sparkSession
    table, end = VersionedTable(path), VersionedTable(f"{path.rstrip('/')}-end")

    def mine(df: DataFrame) -> DataFrame:
        return df if asset is None else df.where(F.col("refs.mint") == asset)

    if end.newest(spark) < 0:
        table.write(mine(log).where(F.col("log_id") > since), -1)
        end.write(table.read(spark, -1).agg(F.coalesce(F.max("log_id"), F.lit(since)).alias("reached")), 0)
    # one number, read back from what was written
    reached = end.read(spark, 0).first()[0]
    fresh = mine(live).where(F.col("log_id") > reached)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = first_per_key(batch, ["log_id"], F.col("event_id"))
        low, high = batch.agg(F.min("log_id"), F.max("log_id")).first()
        if batch_id > 0 and low is not None:
            # versions of this and later batches are left over from a failed attempt
            seen = table.all(batch.sparkSession).where(F.col("v").between(0, batch_id - 1) & F.col("log_id").between(low, high))
            rows = rows.join(seen.select("log_id"), "log_id", "left_anti").select(*batch.columns)
        table.write(rows, batch_id)

    return drain(fresh.writeStream.foreachBatch(step), checkpoint)


def follow(log: DataFrame, path: str, checkpoint: str, asset: str | None = None) -> int:
    """Replay and live rows of a ``log_stream`` in one table, each once.

    The stream's offset is the log position, so a restart or a file that comes again brings no row twice; a
    position that stands twice in one batch counts once.
    """
    table = VersionedTable(path)
    mine = log if asset is None else log.where(F.col("refs.mint") == asset)
    return drain(mine.writeStream.foreachBatch(lambda batch, i: table.write(first_per_key(batch, ["log_id"], F.col("event_id")), i)), checkpoint)


def tracked_stream(source: DataFrame, known: DataFrame, path: str, checkpoint: str) -> int:
    """Events of assets whose create event has passed, or that were known at start.

    ``path``/seen holds per asset the position from which it is tracked.
    """
    seen, kept = VersionedTable(f"{path}/seen"), VersionedTable(f"{path}/events")
    seed = known.select("asset_id", F.lit(-1).cast("bigint").alias("since"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asset = F.coalesce("refs.mint", strict_other_side(F.col("refs.base_mint"), F.col("refs.quote_mint")))
        events = batch.withColumn("asset_id", asset)
        created = events.where((F.col("event_type") == "create") & F.col("asset_id").isNotNull()).select("asset_id", F.col("log_id").alias("since"))
        before = seed if batch_id == 0 else seen.read(spark, batch_id - 1)
        after = before.unionByName(created).groupBy("asset_id").agg(F.min("since").alias("since"))
        seen.write(after, batch_id)
        since = seen.read(spark, batch_id)
        passed = spread_join(events, since, ["asset_id"], spread=("log_id",)).where(F.col("log_id") >= F.col("since"))
        kept.write(passed.drop("since"), batch_id)

    return drain(source.writeStream.foreachBatch(step), checkpoint)
