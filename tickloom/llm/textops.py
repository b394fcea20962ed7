"""Words, hashes and minimizers over Arrow text columns, as numpy on whole pieces of a batch.

A piece is a run of rows with about ``PIECE`` bytes of text, or one longer row, so memory
follows the longest text and not the batch. Hash tables come from a fixed seed: every task of
every job computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
FACTORS2 = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE if n <= 2 * PIECE else n)
        for k, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes and offsets."""
    data, offsets = raw(column)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), rows)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words do not cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = False
    after[offsets[filled + 1] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns two of them into the hash of a span."""
    up, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def gram_hashes(values: np.ndarray, k: int, factors: np.ndarray = FACTORS) -> np.ndarray:
    """Hash of every ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += values[j : j + n] * factors[j]
    return mix(total)


def window_minimum(ranks: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive ranks, by doubling."""
    n, span, low = len(ranks) - width + 1, 1, ranks
    if n <= 0:
        return ranks[:0]
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive grams the position of the smallest, the leftmost on ties.

    Equal windows choose the same offset wherever they stand.
    """
    ranks = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    return (window_minimum(ranks, width) & U(0xFFFFFFFF)).astype(np.int64)
