"""Rolling metrics as keyed state: one-second buckets per asset.

Rows are summed to (asset, second) inside each Arrow batch before the shuffle, so a busy
asset sends seconds, not trades, to the task that keeps its state. State holds only the
seconds of the longest window and is cleared a day after the asset's last trade.

Assets are kept in ``GROUPS`` groups by a hash of their id: what a call of the processor, a frame in and a
frame out cost falls on a group and not on every asset. Inside a group an asset has a value of its own, its seconds
packed in order, and a batch reads and writes those of its own assets only; beside them the group lists when each
asset is due.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import SHORT_WINDOWS, STATE_TTL
from ..operators.metrics import side_flags

SECOND = "open_price double, open_seq long, close_price double, close_seq long, buys long, sells long, volume double, buy_volume double, sell_volume double"
FIELDS = ["open_price", "open_seq", "close_price", "close_seq", "buys", "sells", "volume", "buy_volume", "sell_volume"]
SUMS = ["buys", "sells", "volume", "buy_volume", "sell_volume"]
PACKED = np.dtype([("second", "<i8"), *((f, "<i8" if f in ("open_seq", "close_seq", "buys", "sells") else "<f8") for f in FIELDS)])
NEVER, FAR = -(2**62), 2**62
GROUPS = 2048
FLUSH = 10_000  # rows of a frame that is given
PARTIAL = f"asset_id string, second long, event_time timestamp, {SECOND}"


def combine(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial second rows with the same asset and second summed up.

    The open is the first price that is not zero, the close the last price.
    """
    priced = rows.assign(rank=rows.open_seq.where(rows.open_price != 0, rows.open_seq + 2**62))
    keys = ["asset_id", "second"]
    first = priced.sort_values("rank").groupby(keys, sort=False)[["open_price", "open_seq"]].first()
    last = rows.sort_values("close_seq").groupby(keys, sort=False)[["close_price", "close_seq"]].last()
    sums = rows.groupby(keys, sort=False)[["buys", "sells", "volume", "buy_volume", "sell_volume"]].sum()
    return first.join(last).join(sums).reset_index()


def packed(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), PACKED)
    for name in PACKED.names:
        out[name] = rows[name].to_numpy()
    return out


def merged(rows: np.ndarray) -> np.ndarray:
    """As ``combine``, of the packed rows of one asset; a row per second, in order."""
    rows = rows[np.lexsort((np.where(rows["open_price"] != 0, rows["open_seq"], rows["open_seq"] + 2**62), rows["second"]))]
    heads = np.flatnonzero(np.concatenate((rows["second"][:1] == rows["second"][:1], rows["second"][1:] != rows["second"][:-1])))
    if len(heads) == len(rows):
        return rows
    out, last = rows[heads], rows[np.lexsort((rows["close_seq"], rows["second"]))][np.append(heads[1:], len(rows)) - 1]
    for name in ("close_price", "close_seq"):
        out[name] = last[name]
    for name in SUMS:
        out[name] = np.add.reduceat(rows[name], heads)
    return out


def by_asset(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
    """The packed rows of every asset."""
    names, rows = zip(*((f["asset_id"].to_numpy(), packed(f)) for f in frames if len(f)))
    code, found = pd.factorize(np.concatenate(names))
    by = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[by], np.arange(len(found) + 1))
    rows = np.concatenate(rows)[by]
    for asset, a, b in zip(found, cuts[:-1], cuts[1:]):
        yield asset, rows[a:b]


def frame(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = combine(rows)
        out["event_time"] = pd.to_datetime(out.second, unit="s")
        yield out[["asset_id", "second", "event_time", *FIELDS]]


def second_partials(points: DataFrame, side_mode: str = "reference_live") -> DataFrame:
    """Priced points as partial second rows; points without a price are left out."""
    buy, sell = side_flags(F.col("side"), side_mode)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = points.where("price IS NOT NULL").select(
        "asset_id",
        F.col("event_unix_ts").alias("second"),
        F.col("price").alias("open_price"),
        F.col("insert_seq").alias("open_seq"),
        F.col("price").alias("close_price"),
        F.col("insert_seq").alias("close_seq"),
        F.when(buy, one).otherwise(zero).alias("buys"),
        F.when(sell, one).otherwise(zero).alias("sells"),
        "volume",
        F.when(buy, F.col("volume")).otherwise(0.0).alias("buy_volume"),
        F.when(sell, F.col("volume")).otherwise(0.0).alias("sell_volume"),
    )
    return rows.mapInPandas(_partials, PARTIAL)


def output_schema(windows: Mapping[str, int], ageing: bool = False) -> str:
    cols = ["asset_id string", "as_of long", "latest_price double"] + ["final boolean"] * ageing
    for n in windows:
        cols += [f"anchor_price_{n} double", f"buys_{n} long", f"sells_{n} long"]
        cols += [f"{c}_{n} double" for c in ("volume", "buy_volume", "sell_volume")]
    return ", ".join(cols)


class RollingMetrics(StatefulProcessor):
    """Keeps the seconds of the longest window and emits the windows of changed assets.

    Windows of a batch end at the newest second seen for the asset. A second that arrives late is
    added to its own bucket, never over a newer one.

    With ``ageing``, every second that leaves a window emits too, an idle asset's last ones included: a timer
    stands at the next such time, and when the watermark has passed it, one row per time up to the
    watermark is given. No row of that time can come any more, so these rows are final, however the
    input was cut into batches. State then reaches back from the watermark instead of the newest second.
    """

    def __init__(self, windows: Mapping[str, int], ttl: int = STATE_TTL, ageing: bool = False):
        self.windows, self.ttl, self.ageing = dict(windows), ttl, ageing
        self.span = max(self.windows.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # newest second, last time for which windows were given as final, and the packed seconds
        self.assets = handle.getMapState("assets", "asset_id string", "newest long, final long, seconds binary")
        self.due = handle.getValueState("due", "assets array<string>, at array<long>, timer long")

    def _open(self) -> None:
        held = self.due.get()
        names, at, self.timer = held if held is not None else ([], [], NEVER)
        self.times = dict(zip(names, at))

    def _shut(self) -> None:
        """Sets the timer of the group to the time at which the first of its assets is due."""
        first = min(self.times.values(), default=FAR)
        timer = first * 1000 if first != FAR else NEVER
        if timer != self.timer:
            if self.timer != NEVER:
                self.handle.deleteTimer(self.timer)
            if timer != NEVER:
                self.handle.registerTimer(timer)
        if self.times:
            self.due.update((list(self.times), list(self.times.values()), timer))
        else:
            self.due.clear()

    def _load(self, asset: str) -> None:
        # every asset that is held is listed
        self.newest, self.final, seconds = self.assets.getValue((asset,)) if asset in self.times else (-1, NEVER, b"")
        self.table = np.frombuffer(seconds, PACKED)

    def _save(self, asset: str) -> None:
        self.assets.updateValue((asset,), (self.newest, self.final, self.table.tobytes()))

    def _merge(self, fresh: np.ndarray) -> None:
        """Seconds up to an edge are in no window that is still to be given. They go; with ``ageing`` the last
        of them stays, which has the latest price."""
        self.newest = max(self.newest, int(fresh["second"].max()))
        edge = (min(self.newest, self.final) if self.ageing else self.newest) - self.span
        self.table = merged(np.concatenate((self.table, fresh[fresh["second"] > edge])))
        self._drop(edge)

    def _drop(self, edge: int) -> None:
        old = int(np.searchsorted(self.table["second"], edge, "right"))
        self.table = self.table[max(old - 1, 0) if self.ageing else old :]

    def _windows(self, asset: str, times: list[int], final: bool = False) -> dict[str, np.ndarray]:
        """The windows that end at each of some times."""
        times = np.array(times, np.int64)
        last = np.searchsorted(self.table["second"], times, "right")
        price = np.append(np.nan, self.table["close_price"])[last]
        out = {"asset_id": np.full(len(times), asset, object), "as_of": times, "latest_price": price}
        if self.ageing:
            out["final"] = np.full(len(times), final)
        # one row more, for windows that begin after the last second
        live = np.append(self.table[self.table["close_price"] != 0], np.zeros(1, PACKED))
        at = live["second"][:-1]
        stop = np.searchsorted(at, times, "right")
        for name, span in self.windows.items():
            start = np.searchsorted(at, times - span, "right")
            some = start < stop
            out[f"anchor_price_{name}"] = np.where(some, live["open_price"][start], np.nan)
            cuts = np.column_stack((start, stop)).ravel()
            for c in SUMS:
                # every window is summed by itself; running sums would carry the error of all before it
                out[f"{c}_{name}"] = np.where(some, np.add.reduceat(live[c], cuts)[::2], 0)
        return out

    def _changes(self, before: float) -> list[int]:
        """The times not yet given and before another at which a second leaves a window."""
        at = self.table["second"][self.table["close_price"] != 0]
        found = np.unique(np.concatenate([at + span for span in self.windows.values()]))
        return found[(found > self.final) & (found < before)].tolist()

    def _next(self) -> int:
        """When the asset is due again: a second leaves a window, or it is dropped."""
        return min([self.newest + self.ttl] + (self._changes(np.inf)[:1] if self.ageing else []))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Seconds of the history, loaded once before the group's first live row."""
        if not len(initialState):
            return
        self._open()
        for asset, fresh in by_asset([initialState]):
            self._load(asset)
            self._merge(fresh)
            self._save(asset)
            self.times[asset] = FAR
        self._shut()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        out = []
        for asset, fresh in by_asset(rows):
            self._load(asset)
            self._merge(fresh)
            self._save(asset)
            self.times[asset] = self._next()
            out.append(self._windows(asset, [self.newest]))
        self._shut()
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        self.timer, passed = NEVER, timerValues.getCurrentWatermarkInMs() / 1000  # a timer that went off is gone
        out, n = [], 0
        for asset in [a for a, at in self.times.items() if at < passed]:
            self._load(asset)
            if self.ageing:
                times = self._changes(passed)
                if times:
                    out.append(self._windows(asset, times, True))
                    n += len(times)
                self.final = int(np.ceil(passed)) - 1
            if self.newest + self.ttl < passed or not self.ageing:
                self.assets.removeKey((asset,))
                del self.times[asset]
            else:
                self._drop(min(self.newest, self.final) - self.span)
                self._save(asset)
                self.times[asset] = self._next()
            if n >= FLUSH:
                yield frame(out)
                out, n = [], 0
        self._shut()
        if out:
            yield frame(out)

    def close(self) -> None:
        pass


def metrics_stream(
    points: DataFrame,
    windows: Mapping[str, int] = SHORT_WINDOWS,
    history: DataFrame | None = None,
    delay: str = "1 hour",
    side_mode: str = "reference_live",
    ageing: bool = False,
    ttl: int = STATE_TTL,
) -> DataFrame:
    """Windows of every asset that changed, per batch.

    ``history`` (priced points before the stream) seeds the state once. With ``ageing`` there is
    also a row marked ``final`` for each time at which a second leaves a window, once the watermark (the newest
    event less ``delay``) has passed it. An asset without a trade for ``ttl`` seconds is dropped.
    """
    group = F.pmod(F.xxhash64("asset_id"), F.lit(GROUPS)).alias("group")
    partials = second_partials(points, side_mode).withWatermark("event_time", delay)
    seed = None
    if history is not None:
        seed = second_partials(history, side_mode).select(group, "*").groupBy("group")
    return partials.select(group, "*").groupBy("group").transformWithStateInPandas(
        statefulProcessor=RollingMetrics(windows, ttl, ageing),
        outputStructType=output_schema(windows, ageing),
        outputMode="Update",
        timeMode="EventTime",
        initialState=seed,
    )
