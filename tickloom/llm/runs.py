"""Periodic runs of words, by uniting suffix classes in the order of falling common prefixes.

A run is a stretch of consecutive words with smallest period q, at least ``max(LENGTH, EXPONENT * q)``
words long, that no neighbouring word extends. Words q apart agree over a run but for its last q
words, so its first two periods start suffixes with a common prefix of at least ``least()`` words.

The suffixes of a text are ordered by doubling, which goes on only among those not yet told apart.
Common prefixes of neighbours come in text order: where the words before a suffix and before its
neighbour agree, the prefix is one shorter than that of the suffix before, and only the others are
compared. Neighbours are then united by falling prefix, Kruskal's way. A class is an interval of the
order, named at both of its ends, and keeps its positions sorted; the smaller set goes into the larger.
Two positions that become neighbours in a set when it is united at prefix l, at a distance d of at
most l, are d apart in a stretch of period d and length d + l, and d is its smallest period: a smaller
one would have put a position of the class between them earlier. The pair at the start of the stretch
gives the run, every later pair of it is told by the equal words before the two.

Texts without a word sequence of ``least()`` words that occurs twice (by hash, so none is missed) hold
no run and are not ordered. Texts never meet, so nothing is shuffled and a task holds one piece of a
batch (``textops.pieces``): memory follows the longest text.

Defined results: a null or empty text has no words and no run, and its collapsed text is empty; a row
without doc_id is read as it is; repeated rows and rows that share a doc_id are judged one by one;
columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

LENGTH = 24
EXPONENT = 3
BLOCK = 1 << 22  # words compared at once


def least(length: int = LENGTH, exponent: int = EXPONENT) -> int:
    """The common prefix that the first two periods of any run have at least."""
    return min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1))


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and the rank of every start; a prefix sorts first."""
    n = len(codes)
    at = np.arange(n)
    order = np.argsort(codes, kind="stable")
    new = np.ones(n, bool)
    new[1:] = codes[order][1:] != codes[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    live, step = order[~(new & np.append(new[1:], True))], 1
    while len(live):
        ahead = live + step
        key = rank[live] * (n + 1)
        inside = ahead < n
        key[inside] += rank[ahead[inside]] + 1
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        group = rank[live]
        head, new = np.ones(len(live), bool), np.ones(len(live), bool)
        head[1:], new[1:] = group[1:] != group[:-1], key[1:] != key[:-1]
        place = group + at[: len(live)] - np.maximum.accumulate(np.where(head, at[: len(live)], 0))
        rank[live] = np.maximum.accumulate(np.where(new, place, 0))
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = at
    return order, rank


def _agree(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes agree from ``a`` and from ``b`` on; ``a`` and ``b`` differ."""
    padded = np.append(codes, -1)
    got, live, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(live):
        still = []
        for part in np.array_split(live, -(-len(live) * width // BLOCK)):
            ahead = got[part][:, None] + np.arange(width)
            same = padded[np.minimum(a[part][:, None] + ahead, len(codes))] == padded[np.minimum(b[part][:, None] + ahead, len(codes))]
            all_same = same.all(axis=1)
            got[part] += np.where(all_same, width, (~same).argmax(axis=1))
            still.append(part[all_same])
        live, width = np.concatenate(still), min(2 * width, 1 << 16)
    return got


def common_prefixes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """In text order, how many codes a suffix shares with the one before it in the order."""
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    told = np.ones(n, bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    told[inner] = codes[inner - 1] != codes[before[inner] - 1]
    reach = np.arange(n)
    compared = np.flatnonzero(told & (before >= 0))
    reach[compared] += _agree(codes, compared, before[compared])
    return reach[np.maximum.accumulate(np.where(told, np.arange(n), 0))] - np.arange(n)


def runs_of(codes: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start, then period; equal words have equal codes."""
    n = len(codes)
    if n < max(length, exponent):
        return []
    order, _ = suffix_order(codes)
    prefix = common_prefixes(codes, order)[order]
    edges = np.flatnonzero(prefix >= least(length, exponent))
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    word = codes.tolist()
    found: list[tuple[int, int, int]] = []

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if period <= shared and period + shared >= max(length, exponent * period) and (i == 0 or word[i - 1] != word[j - 1]):
            found.append((i, period + shared, period))

    start = {}  # of the class that ends there
    end = {}  # of the class that starts there
    members: dict[int, list[int]] = {}  # of the class that starts there
    for k, shared in zip(edges.tolist(), prefix[edges].tolist()):
        left, right = start.pop(k - 1, k - 1), end.pop(k, k)
        one = members.pop(left, None) or [int(order[left])]
        two = members.pop(k, None) or [int(order[k])]
        small, large = (one, two) if len(one) <= len(two) else (two, one)
        last = -1
        for t, x in enumerate(small):
            i = bisect_left(large, x)
            if i and large[i - 1] != last:
                seed(large[i - 1], x, shared)
            if i < len(large) and not (t + 1 < len(small) and small[t + 1] < large[i]):
                seed(x, large[i], shared)
            large.insert(i, x)
            last = x
        members[left], start[right], end[left] = large, left, right
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; of equal ones the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The word numbers that the query reads in place of 0 to n-1: a tenth of all texts becomes periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _work(length: int, exponent: int, reading: Callable[[int, int], np.ndarray | None] | None, texts: bool):
    numbers = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli"]
    fields = [(c, pa.int64()) for c in numbers] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", _RUNS)]
    schema = pa.schema(fields + [("collapsed_text", pa.string())] * texts)
    gram = min(least(length, exponent), len(tx.FACTORS))

    def suspects(values: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows in which a gram occurs twice."""
        grams = tx.gram_hashes(values, gram)
        whole = np.flatnonzero(row[: len(grams)] == row[gram - 1 : gram - 1 + len(grams)])
        key = tx.mix(grams[whole] ^ (row[whole].astype(np.uint64) * tx.FACTORS2[0]))
        by = np.argsort(key)
        return np.unique(row[whole[by[1:][key[by][1:] == key[by][:-1]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in tx.pieces(batch.column("text")):
                starts, ends, row = tx.words(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                source = np.arange(len(starts))
                for k in range(j - i) if reading else ():
                    lo, hi = int(first[k]), int(first[k + 1])
                    read = None if ids[i + k] is None else reading(ids[i + k], hi - lo)
                    if read is not None:
                        source[lo:hi] = lo + read
                stays = np.ones(len(source), bool)
                found: dict[int, list[tuple[int, int, int]]] = {}
                text = data.tobytes()
                for k in suspects(tx.word_hashes(data, starts, ends)[source], row).tolist() if len(source) else ():
                    lo, hi = int(first[k]), int(first[k + 1])
                    codes: dict[bytes, int] = {}
                    own = [codes.setdefault(text[a:b], len(codes)) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    found[k] = runs_of(np.array(own)[source[lo:hi] - lo], length, exponent)
                    for s, n, q in found[k]:
                        stays[lo + s + q : lo + s + n] = False
                # the words that stay, each with a space after it
                kept = source[stays]
                sizes = ends[kept] - starts[kept] + 1
                edge = np.concatenate(([0], np.cumsum(sizes)))
                at = np.arange(edge[-1]) + np.repeat(starts[kept] - edge[:-1], sizes)
                out = np.append(data, np.uint8(32))[at]
                out[edge[1:] - 1] = 32
                out, cut = out.tobytes(), edge[np.concatenate(([0], np.cumsum(stays)))[first]]
                columns: list[list] = [[] for _ in schema]
                for k in range(j - i):
                    runs = found.get(k, [])
                    best = strongest(runs)
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    left = out[cut[k] : max(cut[k], cut[k + 1] - 1)]
                    row_out = [ids[i + k], int(first[k + 1] - first[k]), len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2]]
                    row_out += [hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs]]
                    row_out += [left.decode("utf-8", "replace")] * texts
                    for column, value in zip(columns, row_out):
                        column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = ", ".join(f"{c} bigint" for c in numbers) + ", runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return run, kinds + ", collapsed_text string" * texts


def word_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT, reading: Callable[[int, int], np.ndarray | None] | None = None, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the strongest run, digests, all runs, and the collapsed text.

    The collapsed text keeps of every run its first period only. ``reading(doc_id, n_words)`` may name
    the word numbers to read in place of the text's own order; ``texts`` leaves the texts out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(*_work(length, exponent, reading, texts))
