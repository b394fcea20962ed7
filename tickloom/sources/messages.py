"""Binary messages to struct columns: tags, varints and lengths of a whole Arrow batch at once.

A message type is a list of fields with numbers. Every step reads the next field of all rows that have bytes
left, so a batch takes as many steps as its longest message has fields, not as many as it has
rows. Spans of embedded messages are gathered and read the same way, one level at a time. Only text
with bytes beyond ASCII is looked at row by row, to tell whether it is UTF-8.

As the wire format has it: unknown fields and fields of another wire type are skipped, the last value
of a field counts, repeated embedded messages are merged, of a group of alternatives the last one set
stays. A field that is absent is null where its presence is tracked, else zero, false or ''.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VARINT, FIXED64, SPAN, FIXED32 = 0, 1, 2, 5
MOST = 10  # bytes of a varint
U = np.uint64


@dataclass(frozen=True)
class Field:
    number: int
    name: str
    kind: T.DataType
    tracked: bool = False  # absent is null
    message: Message | None = None
    alternative: bool = False  # one of a group of which only one is set


@dataclass(frozen=True)
class Message:
    fields: Sequence[Field]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.kind) for f in self.fields])


def message(struct: T.StructType, tracked: Sequence[str] | None = (), nested: dict[str, Message] | None = None, numbers: dict[str, int] | None = None, alternatives: Sequence[str] = ()) -> Message:
    """A message whose fields are numbered from 1 in the order of ``struct``, but for ``numbers``.

    ``tracked`` names the scalar fields whose absence is null; None stands for all.
    """
    nested, numbers = nested or {}, numbers or {}
    return Message(
        [
            Field(numbers.get(f.name, k), f.name, f.dataType, f.name in nested or tracked is None or f.name in tracked, nested.get(f.name), f.name in alternatives)
            for k, f in enumerate(struct, 1)
        ]
    )


def wire_type(f: Field) -> int:
    return SPAN if f.message is not None or isinstance(f.kind, T.StringType) else VARINT


@dataclass
class _Store:
    """What has been read of one message type for the rows of a batch."""

    type: Message
    rows: int
    present: np.ndarray = None
    values: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: dict[int, np.ndarray] = field(default_factory=dict)
    inner: dict[int, _Store] = field(default_factory=dict)

    def __post_init__(self):
        self.present = np.zeros(self.rows, bool)
        for f in self.type.fields:
            if f.message is not None:
                self.inner[f.number] = _Store(f.message, self.rows)
            else:
                # of text where it starts; -1 where there is none
                self.values[f.number] = np.full(self.rows, -1, np.int64) if wire_type(f) == SPAN else np.zeros(self.rows, U)
                self.sizes[f.number] = np.full(self.rows, -1, np.int64)


class _Reader:
    def __init__(self, data: np.ndarray, rows: int):
        self.data = np.concatenate((data, np.zeros(MOST, np.uint8)))
        self.bad = np.zeros(rows, bool)

    def varint(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, the place after it, and whether it is whole."""
        raw = self.data[np.minimum(at, len(self.data) - MOST)[:, None] + np.arange(MOST)]
        more = raw >= 128
        size = np.where(more.all(axis=1), MOST + 1, (~more).argmax(axis=1) + 1)
        part = (raw & 127).astype(U) << (U(7) * np.arange(MOST, dtype=U))
        value = np.where(np.arange(MOST) < size[:, None], part, U(0)).sum(axis=1, dtype=U)
        return value, at + size, (size <= MOST) & (at + size <= end)

    def read(self, store: _Store, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        """Messages of distinct rows, between ``at`` and ``end``, into a store."""
        known = {f.number: f for f in store.type.fields}
        store.present[rows] = True
        held: list[tuple[np.ndarray, ...]] = []
        chosen, age = np.zeros(len(self.bad), np.int64), np.zeros(len(self.bad), np.int64)
        while len(rows):
            live = (at < end) & ~self.bad[rows]
            rows, at, end = rows[live], at[live], end[live]
            if not len(rows):
                break
            tag, at, good = self.varint(at, end)
            number, kind = (tag >> U(3)).astype(np.int64), (tag & U(7)).astype(np.int64)
            good &= (number > 0) & (number < 1 << 29) & np.isin(kind, (VARINT, FIXED64, SPAN, FIXED32))
            lead, after, whole = self.varint(at, end)
            long = kind == SPAN
            length = np.where(long, np.minimum(lead, U(1 << 40)), U(0)).astype(np.int64)
            begin = np.where(long, after, at)
            ahead = np.select([kind == VARINT, long, kind == FIXED64], [after, after + length, at + 8], at + 4)
            good &= (ahead <= end) & (whole | ((kind != VARINT) & ~long))
            self.bad[rows[~good]] = True
            for n in np.unique(number[good]).tolist():
                f = known.get(n)
                if f is None:
                    continue
                hit = np.flatnonzero(good & (number == n) & (kind == wire_type(f)))
                own = rows[hit]
                if f.message is not None:
                    if f.alternative:
                        age[own] += chosen[own] != n
                        chosen[own] = n
                    held.append((np.full(len(hit), n), own, begin[hit], ahead[hit], age[own]))
                elif wire_type(f) == SPAN:
                    if (store.sizes[n][own] > 0).any():  # what is replaced must be text, too
                        self.text(store.values[n], store.sizes[n], True)
                    store.values[n][own], store.sizes[n][own] = begin[hit], length[hit]
                else:
                    store.values[n][own], store.sizes[n][own] = lead[hit], 1
            rows, at, end = rows[good], ahead[good], end[good]
        if held:
            number, rows, at, end, then = (np.concatenate(c) for c in zip(*held))
            for n in np.unique(number).tolist():
                mine = number == n
                gone = mine & (then != age[rows]) if known[n].alternative else np.zeros_like(mine)
                self.merge(store.inner[n], rows[mine & ~gone], at[mine & ~gone], end[mine & ~gone])
                if gone.any():  # set before the last change: only looked at for faults
                    lost = _Store(known[n].message, len(self.bad))
                    self.merge(lost, rows[gone], at[gone], end[gone])
                    self.arrow(lost)

    def merge(self, store: _Store, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        """Messages of rows that may repeat, in order."""
        by = np.argsort(rows, kind="stable")
        rows, at, end = rows[by], at[by], end[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        for k in range(int(place.max(initial=-1)) + 1):
            self.read(store, rows[place == k], at[place == k], end[place == k])

    def text(self, start: np.ndarray, size: np.ndarray, tracked: bool) -> pa.Array:
        """Spans as text; a row whose span is not UTF-8 is bad."""
        there = size >= 0
        size = np.where(there & ~self.bad, size, 0)
        edge = np.concatenate(([0], np.cumsum(size)))
        flat = self.data[np.arange(edge[-1]) + np.repeat(start - edge[:-1], size)]
        rich = np.unique(np.repeat(np.arange(len(size)), size)[flat >= 128])
        for r in rich.tolist():
            try:
                flat[edge[r] : edge[r + 1]].tobytes().decode()
            except UnicodeDecodeError:
                self.bad[r] = True
                flat[edge[r] : edge[r + 1]] = 63
        mask = np.packbits(there, bitorder="little") if tracked else None
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat.tobytes()), mask if mask is None else pa.py_buffer(mask.tobytes()))

    def arrow(self, store: _Store) -> pa.Array:
        children = []
        for f in store.type.fields:
            if f.message is not None:
                children.append(self.arrow(store.inner[f.number]))
                continue
            value, size = store.values[f.number], store.sizes[f.number]
            if wire_type(f) == SPAN:
                children.append(self.text(value, size, f.tracked))
                continue
            if isinstance(f.kind, T.BooleanType):
                value = value != 0
            elif isinstance(f.kind, T.IntegerType):
                value = value.astype(np.uint32).view(np.int32)
            else:
                value = value.view(np.int64)
            children.append(pa.array(value, to_arrow_type(f.kind), mask=size < 0 if f.tracked else None))
        names = [f.name for f in store.type.fields]
        return pa.StructArray.from_arrays(children, names, mask=pa.array(~store.present | self.bad))


def decode(column: pa.Array, kind: Message) -> tuple[pa.Array, np.ndarray]:
    """The messages of a binary column as structs, and which are malformed; a null is null and sound."""
    rows = len(column)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if not rows:
        return _Reader(np.zeros(0, np.uint8), 0).arrow(_Store(kind, 0)), np.zeros(0, bool)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    filled = column.fill_null(b"")
    edge = np.frombuffer(filled.buffers()[1], wide)[filled.offset : filled.offset + rows + 1].astype(np.int64)
    data = filled.buffers()[2]
    reader = _Reader(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), rows)
    store = _Store(kind, rows)
    own = np.flatnonzero(there)
    reader.read(store, own, edge[:-1][own], edge[1:][own])
    reader.arrow(store)  # finds text that is not UTF-8
    return reader.arrow(store), reader.bad


def read_messages(df: DataFrame, kind: Message, column: str = "value") -> DataFrame:
    """The other columns, ``event`` (the message as a struct) and ``malformed``."""
    others = [f for f in df.schema if f.name != column]
    schema = T.StructType([*others, T.StructField("event", kind.struct), T.StructField("malformed", T.BooleanType())])
    arrow = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in others), ("event", to_arrow_type(kind.struct)), ("malformed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            event, bad = decode(batch.column(column), kind)
            columns = [batch.column(f.name) for f in others] + [event, pa.array(bad)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
