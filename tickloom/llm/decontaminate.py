"""Benchmark passages in documents, up to a share of edits.

The CGK walk turns a string into a longer one: at every step the current character is written
and a random bit of (step, character) decides whether to move on. Strings at a small edit distance
get walks that differ in few places, so sampled places of several independent walks serve as
locality-sensitive keys. Item-sized windows of every document that hold too few 8-grams of the
items of their size class are passed over first, by the q-gram bound, which loses no match. In the
others a walk starts at every word, and at every character of a word too long to be one (text without
spaces), and so it does in the items: an edit spoils the walks before it and not those after it. Windows that share a key
with an item are confirmed by the exact edit distance (bit-parallel, anywhere around the place).

The number of walks and keys gives a recall above ``RECALL`` at the largest number of edits, as
measured by the tests from ``SHORT`` bytes on; a walk reads at most ``STEPS`` bytes, which every item has, so an exact copy has
the keys of the item. Items below ``SHORT`` bytes are too short for several walks: cut into one piece more than
edits are allowed, one piece stands unchanged, so every place with the first bytes of a piece is a candidate. It must
hold enough trigrams of the item, and is confirmed in the same way. None of these is lost.

An item is found where at most ``floor(EDITS * length)`` edits turn it into a part of the text. Case
of A-Z and the kind of white space do not count. Documents never meet each other here. The items are read in
blocks bounded in number and bytes; each block is a pass of its own over the documents that gives the texts with hits only,
so no task holds more than one block.

Defined results: null and empty texts are clean; null or empty items are never found; repeated
items are all named; with no items every document is clean; equal texts have equal results, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import sketch
from . import textops as tx

EDITS = 0.1
BLOCK = 5_000  # items a task holds at once
BLOCK_BYTES = 4 << 20  # and their bytes; one longer item is a block of its own
RECALL = 0.95
SHORT = 64  # items of fewer bytes are found by pieces
LONG_WORD = 16  # in words of more bytes a walk starts at every character
WALKS, KEYS_PER_WALK, SAMPLES = 4, 5, 10
STEPS = 56
TAIL = 32  # bytes that must follow the start of a walk in an item
CLASS_GROWTH = 1.25
TABLE_BITS = 22
PIECE = 1 << 23
GRAM_MULTIPLIER = tx.U(0x9E3779B97F4A7C15)

FOLD = tx.LOWER.copy()
FOLD[tx.SPACE] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    return FOLD[data]


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    """Smallest edit distance of the pattern to any part of the text, one machine word per column."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | (~(diagonal | up) & ones)
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise = (rise << 1) & ones
        fall = (fall << 1) & ones
        up = fall | (~((eq | down) | rise) & ones)
        down = rise & (eq | down)
    return best


def _tables(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The random bits of every walk, and the sampled steps of every key."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = rng.integers(0, 2, (WALKS, STEPS, 256), dtype=np.uint8)
    steps = np.stack([np.stack([np.sort(rng.choice(STEPS, SAMPLES, replace=False)) for _ in range(KEYS_PER_WALK)]) for _ in range(WALKS)])
    return bits, steps


BITS, SAMPLED = _tables()


def walk_keys(data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Keys of the windows, one column per key; past its limit a window reads zeros."""
    keys = np.empty((len(starts), WALKS * KEYS_PER_WALK), np.uint64)
    last = len(data) - 1
    for w in range(WALKS):
        at = starts.astype(np.int64).copy()
        wanted: dict[int, list[int]] = {}
        for k in range(KEYS_PER_WALK):
            for s in SAMPLED[w, k]:
                wanted.setdefault(int(s), []).append(k)
        sums = np.zeros((KEYS_PER_WALK, len(starts)), np.uint64)
        seen = [0] * KEYS_PER_WALK
        for step in range(max(wanted) + 1):
            c = np.where(at < limits, data[np.minimum(at, last)], 0)
            for k in wanted.get(step, ()):
                sums[k] += (c.astype(np.uint64) + tx.U(1)) * tx.FACTORS[seen[k]]
                seen[k] += 1
            at += BITS[w, step][c]
        for k in range(KEYS_PER_WALK):
            column = w * KEYS_PER_WALK + k
            keys[:, column] = tx.mix(sums[k] + tx.FACTORS2[column % 64])
    return keys


class Items:
    """A block of items with their keys, and a gram table with a bound per size class."""

    def __init__(self, ids: list[int], texts: list[str]):
        folded = [fold(np.frombuffer(t.strip().encode(), np.uint8)) for t in texts]
        keep = [i for i, f in enumerate(folded) if len(f)]
        self.ids = [ids[i] for i in keep]
        self.texts = [folded[i].tobytes() for i in keep]
        self.edits = [int(EDITS * len(t)) for t in self.texts]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum(sizes)
        edges = np.concatenate(([0], ends)).astype(np.int64)
        #: item and offset of every walk that starts in an item
        self.keys: dict[int, list[tuple[int, int]]] = {}
        if len(sizes):
            starts, owner = walk_starts(data, edges)
            owned = sizes[owner] >= SHORT
            starts, owner = starts[owned], owner[owned]
            use = (ends[owner] - starts >= TAIL) | (starts == edges[owner])
            starts, owner = starts[use], owner[use]
            place = list(zip(owner.tolist(), (starts - edges[owner]).tolist()))
            for column in walk_keys(data, starts, ends[owner]).T:
                for where, key in zip(place, column.tolist()):
                    self.keys.setdefault(key, []).append(where)
        self.key_list = np.array(sorted(self.keys), np.uint64)
        #: the q-gram bound of each item alone
        self.grams = [frozenset(grams(np.frombuffer(t, np.uint8), 8).tolist()) for t in self.texts]
        self.least = [len(t) - 7 - 8 * e for t, e in zip(self.texts, self.edits)]
        #: by their length, the first bytes of the pieces of short items: values, and item and offset of each
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.trigrams: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(sizes < SHORT).tolist():
            piece = int(sizes[i]) // (self.edits[i] + 1)
            text = np.frombuffer(self.texts[i], np.uint8)
            values = exact_grams(text, min(piece, 8))
            for k in range(self.edits[i] + 1):
                self.seeds.setdefault(min(piece, 8), {}).setdefault(int(values[k * piece]), []).append((i, k * piece))
            self.trigrams[i] = np.unique(exact_grams(text, 3))
        self.seed_lists = {q: np.array(sorted(held), np.uint64) for q, held in self.seeds.items()}
        self.classes = []
        size_class = np.floor(np.log(np.maximum(sizes, 2)) / np.log(CLASS_GROWTH))
        for c in np.unique(size_class[sizes >= SHORT]):
            inside = np.flatnonzero((size_class == c) & (sizes >= SHORT)).tolist()
            for q in (8, 4, 2, 1):
                least = min(len(self.texts[i]) - q + 1 - q * self.edits[i] for i in inside)
                if least >= 4 or q == 1:
                    break
            table = np.zeros(1 << TABLE_BITS, bool)
            for i in inside:
                table[grams(np.frombuffer(self.texts[i], np.uint8), q)] = True
            longest = max(len(self.texts[i]) + self.edits[i] for i in inside)
            self.classes.append((q, table, max(least, 1), longest))


def walk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and of characters in very long words, with their rows."""
    starts, ends, row = tx.words(data, offsets)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(long):
        return starts, row
    sizes = ends[long] - starts[long]
    at = np.arange(int(sizes.sum())) + np.repeat(starts[long] - (np.cumsum(sizes) - sizes), sizes)
    owner = np.repeat(row[long], sizes)
    first = (data[at] & 0xC0) != 0x80
    both = np.concatenate((starts, at[first]))
    both, index = np.unique(both, return_index=True)
    return both, np.concatenate((row, owner[first]))[index]


def exact_grams(data: np.ndarray, q: int) -> np.ndarray:
    """Every ``q`` consecutive bytes, at most eight, as one number."""
    n = max(len(data) - q + 1, 0)
    value = np.zeros(n, np.uint64)
    for j in range(q):
        value = (value << tx.U(8)) | data[j : j + n]
    return value


def find_short(low: np.ndarray, offsets: np.ndarray, items: Items, out: list[dict[int, tuple[int, int]]]) -> None:
    """Short items by their pieces, into ``out``."""
    text, three = low.tobytes(), None
    for q, values in items.seed_lists.items():
        cells = exact_grams(low, q)
        if not len(cells):
            continue
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(values * GRAM_MULTIPLIER) >> tx.U(64 - TABLE_BITS)] = True
        place = np.flatnonzero(table[(cells * GRAM_MULTIPLIER) >> tx.U(64 - TABLE_BITS)])
        at = np.minimum(np.searchsorted(values, cells[place]), len(values) - 1)
        hit = values[at] == cells[place]
        place, at = place[hit], at[hit]
        row = np.searchsorted(offsets, place, "right") - 1
        whole = place + q <= offsets[row + 1]
        place, at, row = place[whole], at[whole], row[whole]
        by = np.argsort(at, kind="stable")
        place, at, row = place[by], at[by], row[by]
        cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i, shift in items.seeds[q][int(values[at[a]])]:
                pattern, edits = items.texts[i], items.edits[i]
                start, own = place[a:b] - shift, row[a:b]
                begin = np.maximum(start - edits, offsets[own])
                end = np.minimum(start + len(pattern) + edits, offsets[own + 1])
                least = len(pattern) - 2 - 3 * edits
                if least > 0:
                    three = exact_grams(low, 3) if three is None else three
                    wide = begin[:, None] + np.arange(len(pattern) + 2 * edits)
                    held = np.isin(three[np.minimum(wide, max(len(three) - 1, 0))], items.trigrams[i]) & (wide + 3 <= end[:, None]) if len(three) else np.zeros((len(begin), 1), bool)
                    enough = held.sum(axis=1) >= least
                    begin, end, own = begin[enough], end[enough], own[enough]
                for x, y, r in zip(begin.tolist(), end.tolist(), own.tolist()):
                    if i not in out[r]:
                        part = text[x:y]
                        if pattern in part or edits and edit_distance_within(pattern, part) <= edits:
                            out[r][i] = (x - int(offsets[r]), y - int(offsets[r]))


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Cells of every ``q`` consecutive bytes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        value = np.empty(n, np.uint64)
        for shift in range(min(8, n)):
            part = data[shift : shift + (n - shift + 7) // 8 * 8]
            value[shift::8] = np.frombuffer(part.tobytes(), "<u8")
    else:
        value = np.zeros(n, np.uint64)
        for j in range(q):
            value = (value << tx.U(8)) | data[j : j + n]
    return (value * GRAM_MULTIPLIER) >> tx.U(64 - TABLE_BITS)


def find(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[dict[int, tuple[int, int]]]:
    """Per row the items found, by number, with the byte window they were found in."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(offsets) - 1)]
    low = fold(data)
    if items.seeds:
        find_short(low, offsets, items, out)
    if not items.classes:
        return out
    starts, row = walk_starts(low, offsets)
    if not len(starts):
        return out
    # words inside a window that may hold an item
    change = np.zeros(len(starts) + 1, np.int64)
    cells: dict[int, np.ndarray] = {}
    for q, table, least, longest in items.classes:
        if q not in cells:
            cells[q] = grams(low, q)
        count = np.zeros(len(low) + 2, np.int32)
        np.cumsum(table[cells[q]], out=count[1 : len(cells[q]) + 1], dtype=np.int32)
        count[len(cells[q]) + 1 :] = count[len(cells[q])]
        stop = np.minimum(starts + longest, offsets[row + 1])
        enough = np.flatnonzero(count[np.maximum(stop - q + 1, starts)] - count[starts] >= least)
        change[enough] += 1
        np.add.at(change, np.searchsorted(starts, stop[enough]), -1)
    inside = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(inside):
        return out
    begin, owner = starts[inside], row[inside]
    keys = walk_keys(low, begin, offsets[owner + 1])
    at = np.minimum(np.searchsorted(items.key_list, keys), len(items.key_list) - 1)
    places = set()
    for w, k in zip(*np.nonzero(items.key_list[at] == keys)):
        places.update((int(owner[w]), i, int(begin[w]) - shift) for i, shift in items.keys[int(keys[w, k])])
    text, eights = low.tobytes(), cells[8] if 8 in cells else grams(low, 8)
    last = (-1, -1, 0)
    for r, i, start in sorted(places):
        # a place next to one that failed was covered by it
        if i in out[r] or (last[:2] == (r, i) and start - last[2] <= items.edits[i]):
            continue
        last = (r, i, start)
        slack = 3 * items.edits[i] + 1
        a = max(start - slack, int(offsets[r]))
        b = min(start + len(items.texts[i]) + slack, int(offsets[r + 1]))
        part = text[a:b]
        if items.least[i] > 0 and sum(map(items.grams[i].__contains__, eights[a : max(b - 7, a)].tolist())) < items.least[i]:
            continue
        if items.texts[i] in part or edit_distance_within(items.texts[i], part) <= items.edits[i]:
            out[r][i] = (a - int(offsets[r]), b - int(offsets[r]))
    return out


def _blocks(benchmark: DataFrame, count: int, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks bounded in number and bytes, read one partition at a time."""
    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    held, size = [], 0
    for item_id, text in known.toLocalIterator():
        more = len(text.encode())
        if held and (len(held) >= count or size + more > limit):
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += more
    if held:
        yield held


def _hits(held: Broadcast):
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([i for i, _ in held.value], [t for _, t in held.value])
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, j, data, offsets in tx.pieces(batch.column("text"), PIECE):
                found = find(data, offsets, items)
                rows = [k for k in range(j - i) if found[k]]
                if rows:
                    names = [sorted({items.ids[x] for x in found[k]}) for k in rows]
                    yield pa.record_batch([keys[i:j][rows], pa.array(names, pa.list_(pa.int64()))], schema=schema)

    return run, "key bigint, items array<bigint>"


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with the sorted ids of the items found in each, as column ``items``.

    An input column of that name is replaced.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("text"))
    texts = docs.where("length(text) > 0").select(key.alias("key"), "text")
    passes = [texts.mapInArrow(*_hits(spark.sparkContext.broadcast(held))) for held in _blocks(benchmark, block, block_bytes)]
    none = F.array().cast("array<bigint>")
    if not passes:
        return docs.withColumn("items", none)
    path = scratch(spark, "contaminated")
    found = reduce(DataFrame.unionByName, passes).groupBy(F.col("key").alias("_text_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_found"))
    found.write.parquet(path)
    found = spark.read.parquet(path)
    # only rows whose key is marked are shuffled
    marks = sketch.bitmap(F.col("_text_key"), found)
    rows = docs.withColumns({"items": none, "_text_key": F.when(F.col("text").isNull(), F.lit(0)).otherwise(key)})

    def split(marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("_text_key").to_numpy() & ((1 << sketch.MARK_BITS) - 1)
                hit = (marks.value[cell >> 5] >> (cell & 31).astype(np.uint32)) & 1 == 1
                yield batch.filter(pa.array(hit if marked else ~hit))

        return run

    clean = rows.mapInArrow(split(False), rows.schema)
    named = rows.mapInArrow(split(True), rows.schema).join(found, "_text_key", "left").withColumn("items", F.coalesce("_found", "items"))
    return clean.unionByName(named.select(rows.columns)).drop("_text_key")
