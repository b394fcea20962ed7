"""Binary events and instructions to columns.

Discriminators and account roles are built-in expressions. The fields are read by one Arrow
function: it takes the rows of a batch kind by kind and reads each field for all of them at
once, so its plan stays small however many layouts there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CURVE_PROGRAM, INITIALIZE_MINT_TYPE, TOKEN_2022_PROGRAM, TOKEN_PROGRAM
from ..sources import layouts as L

# fixed value: the alphabet of base58 text
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
SIZES = {"key": 32, "u8": 1, "u16": 2, "u64": 8, "i64": 8, "bool": 1, "flag": 1, "flag?": 1}
TYPES = {
    "key": T.StringType(), "str": T.StringType(), "u8": T.IntegerType(), "u16": T.IntegerType(), "u64": T.DecimalType(20, 0),
    "i64": T.LongType(), "bool": T.BooleanType(), "flag": T.BooleanType(), "flag?": T.BooleanType(),
}
ARROW = {
    "key": pa.string(), "str": pa.string(), "u8": pa.int32(), "u16": pa.int32(), "u64": pa.decimal128(20, 0),
    "i64": pa.int64(), "bool": pa.bool_(), "flag": pa.bool_(), "flag?": pa.bool_(),
}
DIGITS = 45  # base58 digits of 32 bytes, rounded up to whole steps of five

Layout = list[tuple[str, str]]


def base58(raw: bytes) -> str:
    number, text = int.from_bytes(raw, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = ALPHABET[digit] + text
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + text


def base58_keys(keys: np.ndarray) -> pa.Array:
    """Text of each row of an (n, 32) byte matrix, by long division of all rows at once."""
    limbs = np.ascontiguousarray(keys).view(">u4").astype(np.uint64)
    digits = np.empty((len(keys), DIGITS), np.uint8)
    for last in range(DIGITS - 1, 0, -5):
        rest = np.zeros(len(keys), np.uint64)
        for i in range(limbs.shape[1]):
            limbs[:, i], rest = np.divmod((rest << np.uint64(32)) | limbs[:, i], np.uint64(58**5))
        for place in range(last, last - 5, -1):
            rest, digits[:, place] = np.divmod(rest, np.uint64(58))

    def leading_zeros(matrix: np.ndarray) -> np.ndarray:
        return np.where((matrix != 0).any(axis=1), (matrix != 0).argmax(axis=1), matrix.shape[1])

    # a leading zero byte is a one, as a zero digit is
    start = leading_zeros(digits) - leading_zeros(keys)
    chars = np.frombuffer(ALPHABET.encode(), np.uint8)[digits][np.arange(DIGITS) >= start[:, None]]
    ends = np.zeros(len(keys) + 1, np.int32)
    np.cumsum(DIGITS - start, out=ends[1:])
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(chars.tobytes()))


def layout(text: str) -> Layout:
    return [tuple(field.split(":")) for field in text.split()]


def _hex(disc: Sequence[int]) -> str:
    return bytes(disc).hex().upper()


class _Rows:
    """The bytes of the rows of one kind, and where the next field of each starts."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.flat, self.start, self.size = flat, start, size
        self.at = np.full(len(start), 8, np.int64)
        self.ok = size >= 8

    def take(self, width: int) -> np.ndarray:
        """The next bytes of every row, zeros beyond its end."""
        place = self.at[:, None] + np.arange(width)
        inside = place < self.size[:, None]
        found = np.where(inside, self.flat[np.where(inside, self.start[:, None] + place, 0)], 0)
        self.at = self.at + width
        return found.astype(np.uint8)

    def number(self, type_: str) -> np.ndarray:
        width = SIZES[type_]
        raw = self.take(width).view({1: "u1", 2: "<u2", 8: "<u8"}[width])[:, 0]
        return raw.view(np.int64) if type_ == "i64" else raw

    def text(self) -> pa.Array:
        """The next string: four bytes of length, then UTF-8; a row without a sound one fails."""
        length = self.take(4).view("<u4")[:, 0].astype(np.int64)
        end = self.at + length
        self.ok &= end <= self.size
        found: list[str | None] = [None] * len(end)
        for i in np.flatnonzero(self.ok).tolist():
            try:
                found[i] = self.flat[self.start[i] + self.at[i] : self.start[i] + end[i]].tobytes().decode()
            except UnicodeDecodeError:
                self.ok[i] = False
        self.at = np.where(self.ok, end, self.size + 1)
        return pa.array(found, pa.string())

    def read(self, type_: str) -> pa.Array:
        if type_ == "str":
            return self.text()
        if type_ == "key":
            return base58_keys(self.take(SIZES[type_]))
        if type_ == "flag?":
            # the last field, if it is there at all
            there, byte = self.at < self.size, self.take(1)[:, 0]
            self.at = self.at - 1
            return pa.array(byte == 1, mask=~there | (byte > 1))
        number = self.number(type_)
        if type_ == "flag":
            self.ok &= number <= 1
        return pa.array(number != 0) if type_ in ("flag", "bool") else pa.array(number).cast(ARROW[type_])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat byte array (never empty), and start and size of every row."""
    column = column.cast(pa.large_binary())
    _, offsets, flat = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(flat, np.uint8) if flat is not None and flat.size else np.zeros(1, np.uint8)
    return data, ends[:-1], np.diff(ends)


def _reader(layouts: Mapping[str, Layout], exact: Sequence[str]):
    """A function of (kind, data) that gives one struct with the fields of all kinds."""
    names: dict[str, str] = {}
    for fields in layouts.values():
        names.update({f: t for f, t in fields})

    def read(kind: pa.Array, data: pa.Array) -> pa.Array:
        flat, start, size = _bytes_of(data)
        kinds = kind.to_numpy(zero_copy_only=False)
        known = ~np.asarray(data.is_null().to_numpy(zero_copy_only=False), bool)
        # where the value of each row stands in the pieces read kind by kind; -1 is null
        pieces: dict[str, list[pa.Array]] = {n: [] for n in names}
        place = {n: np.full(len(kinds), -1, np.int64) for n in names}
        whole = np.zeros(len(kinds), bool)
        for name, fields in layouts.items():
            index = np.flatnonzero((kinds == name) & known)
            if not len(index):
                continue
            rows = _Rows(flat, start[index], size[index])
            found = [(f, rows.read(t)) for f, t in fields]
            rows.ok &= rows.at == rows.size if name in exact else rows.at <= rows.size
            whole[index] = rows.ok
            for field, values in found:
                before = sum(map(len, pieces[field]))
                place[field][index] = np.where(rows.ok, before + np.arange(len(index)), -1)
                pieces[field].append(values)
        columns = []
        for name, type_ in names.items():
            if not pieces[name]:
                columns.append(pa.nulls(len(kinds), ARROW[type_]))
                continue
            values = pa.concat_arrays(pieces[name])
            columns.append(values.take(pa.array(place[name], mask=place[name] < 0)))
        return pa.StructArray.from_arrays(columns, names=list(names), mask=pa.array(~whole))

    fields = [T.StructField(n, TYPES[t]) for n, t in names.items()]
    # called nondeterministic so that a later filter or field access is not turned into a second call
    return F.arrow_udf(read, T.StructType(fields)).asNondeterministic()


def decode(df: DataFrame, layouts: Mapping[str, Layout], exact: Sequence[str], out: str) -> DataFrame:
    """Read ``data`` by the layout of ``kind``; ``out`` is one struct with the fields of all kinds.

    The struct is null where the bytes are too short, too long for an exact layout, hold
    a bad flag or a string that is not UTF-8.
    """
    return df.withColumn(out, _reader(layouts, exact)("kind", "data"))


EVENT_LAYOUTS = {k: layout(v) for k, v in L.EVENT_LAYOUTS.items()}
INSTRUCTION_LAYOUTS = {k: layout(v) for k, v in L.INSTRUCTION_LAYOUTS.items()}


def event_kind(data: Column) -> Column:
    head, chain = F.hex(F.substring(data, 1, 8)), None
    for kind, discs in L.EVENT_DISCRIMINATORS.items():
        hit = head.isin(*(_hex(d) for d in discs))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def instruction_kind(program: Column, data: Column) -> Column:
    head, chain = F.hex(F.substring(data, 1, 8)), None
    for kind, (owner, disc) in L.INSTRUCTION_DISCRIMINATORS.items():
        hit = (program == owner) & (head == _hex(disc))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def decode_events(df: DataFrame) -> DataFrame:
    """Add ``kind`` and ``event``; rows of no known kind are dropped before anything is read.

    ``event`` is null where the bytes do not fit the layout.
    """
    known = df.withColumn("kind", event_kind(F.col("data"))).where("kind IS NOT NULL")
    return decode(known, EVENT_LAYOUTS, L.EXACT_EVENTS, "event")


def decode_instructions(df: DataFrame) -> DataFrame:
    """Add ``kind``, ``args`` and ``accounts`` (role -> key); void where an account is missing."""
    known = df.withColumn("kind", instruction_kind(F.col("program_id"), F.col("data"))).where("kind IS NOT NULL")
    out = decode(known, INSTRUCTION_LAYOUTS, [], "args")
    kind, given = F.col("kind"), F.col("account_pubkeys")
    roles, needed = None, None
    for name, text in L.INSTRUCTION_ACCOUNTS.items():
        names = text.split()
        cut = F.slice(F.concat(given, F.array_repeat(F.lit(None).cast("string"), len(names))), 1, len(names))
        made = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), cut)
        enough = F.size(given) >= L.ACCOUNTS_NEEDED.get(name, len(names))
        roles = F.when(kind == name, made) if roles is None else roles.when(kind == name, made)
        needed = F.when(kind == name, enough) if needed is None else needed.when(kind == name, enough)
    whole = F.coalesce(needed, F.lit(False)) & F.col("args").isNotNull()
    return out.withColumn("accounts", F.when(whole, roles)).withColumn("args", F.when(whole, F.col("args")))


def extract_decimals(instructions: DataFrame) -> DataFrame:
    """Decimals per transaction and mint, from its first initialise-mint call."""
    head = F.hex(F.substring("data", 1, 1))
    calls = instructions.where(
        F.col("program_id").isin(TOKEN_PROGRAM, TOKEN_2022_PROGRAM)
        & (F.col("source") == "inner")
        & (head == f"{INITIALIZE_MINT_TYPE:02X}")
        & (F.length("data") >= 2)
    )
    value = F.conv(F.hex(F.substring("data", 2, 1)), 16, 10).cast("int")
    return calls.groupBy("signature", F.get("account_pubkeys", F.lit(0)).alias("mint")).agg(
        F.min_by(value, F.struct("outer_index", "inner_index")).alias("mint_decimals")
    )


def instruction_census(instructions: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counts: curve instructions by kind, and how many creates can be read."""
    kinds = ["curve_buy", "curve_sell", "curve_buy_exact_sol_in", "curve_create", "curve_create_v2", "curve_migrate"]
    mine = instructions.where(F.col("program_id") == CURVE_PROGRAM).withColumn(
        "_k", F.coalesce(instruction_kind(F.col("program_id"), F.col("data")), F.lit("other"))
    )
    read = decode_instructions(mine.where("_k = 'curve_create_v2'").drop("_k"))
    seen = mine.agg(
        *(F.count_if(F.col("_k") == k).alias(f"{k}_ix") for k in kinds), F.count_if(F.col("_k") == "other").alias("curve_other_ix")
    )
    v2 = read.agg(F.count_if(F.col("args").isNotNull()).alias("curve_create_v2_parseable_ix"))
    made = decode_events(events.where(event_kind(F.col("data")) == "curve_create")).agg(
        F.count("*").alias("curve_create_event_bytes"),
        F.count_if(F.col("event").isNotNull()).alias("curve_create_event_parseable"),
    )
    # three one-row sides
    one = F.lit(1).alias("_one")
    parts = [p.select("*", one) for p in (seen, v2, made)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")
