"""Which 64-bit keys may occur twice: hits counted per task, merged by segment, saturating at two.

A key is counted by the first ``bits + PRINT`` bits of its hash. A task sends them per segment, once
or twice each; a group merges a segment, and what it counts twice or more is marked in ``ROWS`` hash
rows of ``2**bits`` cells. So only keys that repeat fill the cells, and a corpus of many different
keys passes no more of them. The marks have a fixed size (``ROWS * 2**bits / 8`` bytes, 64 MB at the
largest) whatever the input, so they may be collected and broadcast. Counts never fall below true
ones: a key that occurs twice always passes. Full rows pass more keys and lose none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

ROWS = 2
SEGMENT_BITS = 20  # cells of a segment
PRINT = 12  # bits by which keys of one cell are told apart while they are counted
MAX_BITS = 28
FLUSH = 1 << 22  # keys a task holds before it sends a partial sketch
MULTIPLIER = 0x9E3779B97F4A7C15
ROW_MULTIPLIERS = (1, 0x85EBCA6B)
SCHEMA = pa.schema([("part", pa.int32()), ("cells", pa.binary())])


def bits_for(keys: int) -> int:
    """Cells for an expected number of keys, within the fixed bound."""
    return int(min(MAX_BITS, max(SEGMENT_BITS, np.ceil(np.log2(max(keys, 1) * 6)))))


def _prints(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(MULTIPLIER)) >> np.uint64(64 - bits - PRINT)


def _cells(low: np.ndarray, row: int) -> np.ndarray:
    """Cells of a hash row inside the segment, from what a print has below the segment's number."""
    return (low * np.uint32(ROW_MULTIPLIERS[row])) >> np.uint32(PRINT)


def _partial(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    prints = np.sort(_prints(np.concatenate(held), bits))
    # a third hit says nothing new
    if len(prints) > 2:
        prints = prints[np.concatenate(([True, True], prints[2:] != prints[:-2]))]
    cuts = np.searchsorted(prints, np.arange(1 + (1 << (bits - SEGMENT_BITS)), dtype=np.uint64) << np.uint64(32))
    # the bytes of one place stand together: the first of sorted numbers hardly changes
    low = prints.astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1]
    parts = np.flatnonzero(np.diff(cuts))
    payload = [low[cuts[s] : cuts[s + 1]].T.tobytes() for s in parts]
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(payload, pa.binary())], schema=SCHEMA)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    planes = [np.frombuffer(payload, np.uint8).reshape(4, -1).T for payload in rows.cells]
    low = np.sort(np.ascontiguousarray(np.concatenate(planes)[:, ::-1]).view("<u4").ravel())
    twice = low[1:][low[1:] == low[:-1]]
    marks = np.zeros((ROWS, 1 << SEGMENT_BITS), bool)
    for row in range(ROWS):
        marks[row, _cells(twice, row)] = True
    return pd.DataFrame({"part": [int(rows.part.iloc[0])], "cells": [np.packbits(marks, bitorder="little").tobytes()]})


class Repeated:
    """The merged marks: which keys may occur twice or more."""

    def __init__(self, bits: int, tables: list[np.ndarray]):
        self.bits, self.tables = bits, tables

    def test(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        prints = _prints(keys, self.bits)
        segment, low = (prints >> np.uint64(32)) << np.uint64(SEGMENT_BITS), prints.astype(np.uint32)
        for row, table in enumerate(self.tables):
            cells = segment + _cells(low, row)
            hit &= (table[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit


def repeated_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """Scan ``df``, count every key that ``keys_of`` yields, and broadcast the marks of those that repeat."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                if sum(map(len, held)) >= FLUSH:
                    yield _partial(held, bits)
                    held = []
        if held:
            yield _partial(held, bits)

    spark = df.sparkSession
    merged = df.mapInArrow(build, "part int, cells binary").groupBy("part").applyInPandas(_merge, "part int, cells binary")
    size = 1 << (bits - 3)
    tables = [np.zeros(size, np.uint8) for _ in range(ROWS)]
    segment = 1 << (SEGMENT_BITS - 3)
    for part, cells in merged.collect():
        for row, table in enumerate(tables):
            table[part * segment : (part + 1) * segment] = np.frombuffer(cells, np.uint8, segment, row * segment)
    return spark.sparkContext.broadcast(Repeated(bits, tables))


MARK_BITS = 24


def bitmap(cell: Column, df: DataFrame, bits: int = MARK_BITS) -> Broadcast:
    """A broadcast bitmap with the given cell of every row set; merged on the cluster, ``2**bits / 8`` bytes."""
    cell = F.pmod(cell, F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(cell, F.lit(32)).cast("int"))
    found = df.groupBy(F.shiftright(cell, 5).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return df.sparkSession.sparkContext.broadcast(table)


def wide_bits(rows: int) -> int:
    """Cells for a bitmap of which a sixteenth at most is set, within the fixed bound."""
    return int(min(MAX_BITS, max(MARK_BITS, np.ceil(np.log2(max(rows, 1) * 16)))))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    marks = np.zeros(1 << SEGMENT_BITS, bool)
    marks[rows.low.to_numpy()] = True
    return pd.DataFrame({"part": [int(rows.part.iloc[0])], "cells": [np.packbits(marks, bitorder="little").tobytes()]})


def wide_bitmap(cell: Column, df: DataFrame, bits: int) -> Broadcast:
    """As ``bitmap``, in bytes; its segments are packed on the cluster, so that it may have up to ``2**MAX_BITS`` cells."""
    cell = F.pmod(cell, F.lit(1 << bits))
    keyed = df.select(F.shiftright(cell, SEGMENT_BITS).cast("int").alias("part"), cell.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int").alias("low"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    segment = 1 << (SEGMENT_BITS - 3)
    for part, cells in keyed.groupBy("part").applyInPandas(_pack, "part int, cells binary").collect():
        table[part * segment : (part + 1) * segment] = np.frombuffer(cells, np.uint8)
    return df.sparkSession.sparkContext.broadcast(table)


def split(marks: Broadcast, batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id is marked, or those that are not; a null doc_id is not."""
    table = marks.value
    for batch in batches:
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        hit = (table[(ids >> 5) & ((1 << (MARK_BITS - 5)) - 1)] >> (ids & 31).astype(np.uint32)) & 1 == 1
        hit &= ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(hit if marked else ~hit))


def with_found(rows: DataFrame, found: DataFrame, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """``finish`` over all rows, with column ``found`` joined on doc_id and text_key.

    Rows whose doc_id is not in the bitmap of ``found`` have nothing to join and are not shuffled.
    ``found`` is stored first: it is read twice.
    """
    path = scratch(rows.sparkSession, "found")
    found.write.parquet(path)
    found = rows.sparkSession.read.parquet(path)
    marks = bitmap(F.col("doc_id"), found)
    none = found.limit(0).select("found").toArrow().schema.field("found").type

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return finish(b.append_column("found", pa.nulls(b.num_rows, none)) for b in split(marks, batches, False))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return split(marks, batches, True)

    joined = rows.mapInArrow(hits, rows.schema).join(found, ["doc_id", "text_key"], "left")
    return rows.mapInArrow(plain, kind).unionByName(joined.mapInArrow(finish, kind))
