"""Removal of byte strings of 100 that already start earlier in the corpus, by suffix arrays.

Every 100-byte window has an anchor: its smallest 50-byte gram. Counts of anchors
(``sketch``) tell which may occur twice; only their windows go on. Neighbouring windows with one
anchor form a context, known by a hash of its bytes. Contexts are collapsed to distinct ones with
their earliest place, so a passage that a third of all documents share is one row per task and not
one per document. Anchors with one distinct context are settled by that. Of the others the bytes of
every distinct context are fetched once, and groups that hold all equal windows are packed into
shards: whole anchors, and of an anchor with more than ``CROWD`` contexts its parts. A shard's suffix
array is built by induced sorting: suffixes are classified, the leftmost-smaller substrings sorted
and named, their order found on the names, and all others induced, bucket by bucket in numpy. The
permuted common prefixes, found in one pass in text order (``runs``), give neighbours that agree in 100 bytes, and each such run its earliest
place. The string of names has an alphabet as large as itself; it is ordered by doubling ranks
instead of another round of buckets, and only among names not yet told apart.

Equal windows have equal anchors at equal offsets, so they always meet in one shard. The windows of a
crowded anchor are cut by their offset to it, into halves of the range of offsets; all windows of a
half hold the same bytes around the anchor, and a hash of those names the group. Groups still crowded
are halved again, at last to single offsets, where a group is one distinct window. Distinct pieces
stand once in a group. So a group has at most ``CROWD`` pieces, and a shard is closed at ``SHARD`` bytes.

Defined results: a null or empty text has no bytes; shorter texts keep all; rows with one doc_id
are one document whose texts are compared by start; a row without doc_id keeps all its bytes and
removes none of others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import sketch
from . import textops as tx
from .runs import common_prefixes, suffix_order
from .substrings import keyed

LENGTH = 100
GRAM = 50
SHARD = 1 << 20
CROWD = 4096
LEVELS = 6  # halvings of the offsets 0 to LENGTH - GRAM down to single ones


# --- suffix arrays ------------------------------------------------------------------


def _place(order: np.ndarray, found: np.ndarray, symbols: np.ndarray, edge: np.ndarray, filled: np.ndarray, way: int) -> None:
    """Append ``found`` to the buckets of their symbols, in order, forwards or backwards."""
    by = np.argsort(symbols, kind="stable")
    symbols = symbols[by]
    count = np.bincount(symbols, minlength=len(filled))
    rank = np.arange(len(by)) - np.repeat((np.cumsum(count) - count)[count > 0], count[count > 0])
    order[edge[symbols] + way * (filled[symbols] + rank)] = found[by]
    filled += count


def _induce(text: np.ndarray, smaller: np.ndarray, alphabet: int, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order of the leftmost-smaller ones induces."""
    n = len(text)
    count = np.bincount(text, minlength=alphabet)
    tail = np.cumsum(count) - 1
    head = tail + 1 - count
    order = np.full(n, -1, np.int64)
    larger, lesser = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    cuts = np.searchsorted(text[seeds], np.arange(alphabet + 1))

    def forward(now: np.ndarray) -> None:
        back = now[now > 0] - 1
        back = back[~smaller[back]]
        if len(back):
            _place(order, back, text[back], head, larger, 1)

    # the last suffix is larger-type and comes first in its bucket
    _place(order, np.array([n - 1]), text[-1:], head, larger, 1)
    for c in range(alphabet):
        done = 0
        while done < larger[c]:
            done, start = int(larger[c]), done
            forward(order[head[c] + start : head[c] + done])
        forward(seeds[cuts[c] : cuts[c + 1]])

    def backward(now: np.ndarray) -> None:
        back = now[now > 0] - 1
        back = back[smaller[back]]
        if len(back):
            _place(order, back, text[back], tail, lesser, -1)

    for c in range(alphabet - 1, -1, -1):
        done = 0
        while done < lesser[c]:
            done, start = int(lesser[c]), done
            backward(order[tail[c] - done + 1 : tail[c] - start + 1][::-1])
        backward(order[head[c] : head[c] + larger[c]][::-1])
    return order


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes in order; symbols are 0..alphabet-1 below 256, a prefix sorts first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    # a suffix is smaller than the next one by the first place where symbols differ
    change = np.sign(np.diff(text))
    last = np.where(change != 0, np.arange(n - 1), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    smaller = np.zeros(n, bool)
    known = last < n
    smaller[:-1][known] = change[last[known]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, smaller, alphabet, lms)
    order = _induce(text, smaller, alphabet, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sequence = order[is_lms[order]]
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    sums = tx.prefix_hash(text.astype(np.uint8))
    mark = tx.span_hash(sums, sequence, stop[sequence])
    new = np.ones(len(sequence), bool)
    new[1:] = (mark[1:] != mark[:-1]) | ((stop[sequence] - sequence)[1:] != (stop[sequence] - sequence)[:-1])
    name = np.empty(n, np.int64)
    name[sequence] = np.cumsum(new) - 1
    if new.all():
        return _induce(text, smaller, alphabet, sequence)
    return _induce(text, smaller, alphabet, lms[suffix_order(name[lms])[0]])


def earliest(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per context the windows that another context has earlier: their numbers, documents, starts."""
    sizes = np.array([len(c) for c in contexts])
    data = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
    heads = np.cumsum(sizes + 1) - sizes - 1
    symbol = np.zeros(len(data), np.int64)
    inside = np.ones(len(data), bool)
    inside[heads + sizes] = False
    data[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    symbol[inside] = data[inside].astype(np.int64) + 1
    # only symbols that occur need a bucket; utf-8 never uses them all, so one byte holds them
    present, dense = np.unique(symbol, return_inverse=True)
    order = suffix_array(dense, len(present))
    agree = common_prefixes(dense.astype(np.int16), order)[order] >= length
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(~agree)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    place = np.arange(len(data)) - heads[owner]
    window = np.flatnonzero(place + length <= sizes[owner])
    key = group[window]
    doc, start = docs[owner[window]], starts[owner[window]] + place[window]
    by = np.lexsort((start, doc, key))
    first = by[np.concatenate(([True], key[by][1:] != key[by][:-1]))]
    best = np.empty(int(key.max()) + 1, np.int64)
    best[key[first]] = first
    at = best[key]
    other = (doc[at] != doc) | (start[at] != start)
    out = []
    cuts = np.searchsorted(owner[window], np.arange(len(contexts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        keep = a + np.flatnonzero(other[a:b])
        out.append((place[window[keep]], doc[at[keep]], start[at[keep]]))
    return out


# --- windows of documents -----------------------------------------------------------


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """Gram hashes, valid window starts, and the anchor position of each."""
    if len(data) < LENGTH:
        return None
    sums = tx.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = tx.span_hash(sums, at, at + GRAM)
    anchor = tx.minimizers(grams, LENGTH - GRAM + 1)
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    whole = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= room)
    return grams, whole, anchor[whole], sums


def _keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, data, offsets in tx.pieces(batch.column("text")):
        found = _anchors(data, offsets)
        if found is not None and len(found[1]):
            yield found[0][np.unique(found[2])]


_FOUND = "anchor int, context bigint, doc_id bigint, text_key int, start bigint, span int"


def _contexts(repeated, wanted=None):
    with_bytes = wanted is not None
    fields = [("anchor", pa.int32()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int64()), ("span", pa.int32())]
    schema = pa.schema(fields + [("bytes", pa.binary())] * with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = repeated.value.test
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = batch.column("text_key").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tx.pieces(batch.column("text")):
                found = _anchors(data, offsets)
                if found is None or not len(found[1]):
                    continue
                grams, whole, anchor, sums = found
                row = np.searchsorted(offsets, whole, "right") - 1
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
                maybe = test(grams[anchor[cut]])
                if not maybe.any():
                    continue
                last = np.concatenate((cut[1:], [len(whole)])) - 1
                lo, hi, mid, owner = whole[cut][maybe], whole[last][maybe], anchor[cut][maybe], row[cut][maybe]
                mark = tx.span_hash(sums, lo, hi + LENGTH) + (mid - lo).astype(np.uint64) * tx.FACTORS[0]
                mark = tx.mix(mark).view(np.int64)
                columns = [(grams[mid] >> tx.U(32)).astype(np.uint32).view(np.int32), mark, ids[i:j][owner], texts[i:j][owner].astype(np.int32), lo - offsets[owner], (hi - lo).astype(np.int32)]
                if with_bytes:
                    cell = (mark ^ columns[2] ^ (columns[2] << 9) ^ columns[4]) & (8 * len(wanted.value) - 1)
                    use = (wanted.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                    columns, lo, hi = [c[use] for c in columns], lo[use], hi[use]
                    text = data.tobytes()
                    columns.append(pa.array([text[a:b] for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())], pa.binary()))
                yield pa.record_batch([pa.array(c) for c in columns], schema=schema)

    return run, _FOUND + (", bytes binary" if with_bytes else "")


_PART = "anchor int, origin bigint, at int, span int, shard bigint, piece bigint, n bigint, first_doc bigint, first_start bigint, bytes binary"


def _halve(level: int):
    """The windows of every row, cut by their offset to the anchor into cells of ``2**(LEVELS - level)``."""
    shift = LEVELS - level
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    schema = pa.schema([*zip(("anchor", "origin", "at", "span", "shard", "piece", "n", "first_doc", "first_start"), kinds), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(c).to_numpy() for c in ("anchor", "origin", "at", "n", "first_doc", "first_start")}
            for i, j, data, offsets in tx.pieces(batch.column("bytes")):
                _, whole, anchor, sums = _anchors(data, offsets)
                row = np.searchsorted(offsets, whole, "right") - 1
                cell = (anchor - whole) >> shift
                cut = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1]))))
                last = np.concatenate((cut[1:], [len(whole)])) - 1
                lo, hi, mid, cell, row = whole[cut], whole[last], anchor[cut], cell[cut], row[cut]
                # the bytes that all windows of the cell have
                least = cell << shift
                most = np.minimum(least + (1 << shift) - 1, LENGTH - GRAM)
                shard = tx.span_hash(sums, mid - least, mid - most + LENGTH) + (cell + (level << 8)).astype(np.uint64) * tx.FACTORS[1]
                piece = tx.span_hash(sums, lo, hi + LENGTH) + (mid - lo).astype(np.uint64) * tx.FACTORS[0]
                own = {c: v[i:j][row] for c, v in given.items()}
                ahead = lo - offsets[row]
                text = data.tobytes()
                columns = [own["anchor"], own["origin"], (own["at"] + ahead).astype(np.int32), (hi - lo).astype(np.int32), tx.mix(shard).view(np.int64), tx.mix(piece).view(np.int64), own["n"], own["first_doc"], own["first_start"] + ahead]
                columns = [pa.array(c, f.type) for c, f in zip(columns, schema)]
                columns.append(pa.array([text[a:b] for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())], pa.binary()))
                yield pa.record_batch(columns, schema=schema)

    return run


def parted(contexts: DataFrame, crowd: int) -> DataFrame:
    """Pieces of the contexts of crowded anchors; equal windows share ``shard``, which has at most ``crowd`` distinct pieces."""
    spark, done = contexts.sparkSession, []
    parts = contexts.select("anchor", F.col("context").alias("origin"), F.lit(0).alias("at"), "n", "first_doc", "first_start", "bytes")
    for level in range(1, LEVELS + 1):
        path = scratch(spark, "parts")
        parts.mapInArrow(_halve(level), _PART).write.parquet(path)
        parts = spark.read.parquet(path)
        path = scratch(spark, "crowded")
        pieces = parts.select("shard", "piece").distinct().groupBy("shard").agg(F.count("*").alias("kinds"))
        pieces.where(F.col("kinds") > crowd).select("shard").write.parquet(path)
        crowded = spark.read.parquet(path)
        if level == LEVELS or crowded.isEmpty():
            break
        done.append(parts.join(crowded, "shard", "left_anti"))
        parts = parts.join(crowded, "shard", "left_semi")
    for other in done:
        parts = parts.unionByName(other)
    return parts


_KIND = "shard bigint, context bigint, first_doc bigint, first_start bigint, windows array<int>, docs array<bigint>, starts array<bigint>"
_SETTLED = pa.schema(
    [("shard", pa.int64()), ("context", pa.int64()), ("first_doc", pa.int64()), ("first_start", pa.int64()), ("windows", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
)


def _solved(shard: pa.Table) -> pa.RecordBatch:
    number = {c: shard.column(c).to_numpy() for c in ("shard", "context", "n", "first_doc", "first_start")}
    found = earliest(shard.column("bytes").to_pylist(), number["first_doc"], number["first_start"])
    # a context that stands once and has nothing earlier says nothing
    use = np.array([n > 1 or len(w) > 0 for n, (w, _, _) in zip(number["n"].tolist(), found)], bool)
    lists = [[f[k].tolist() for f, u in zip(found, use) if u] for k in range(3)]
    columns = [number[c][use] for c in ("shard", "context", "first_doc", "first_start")] + lists
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SETTLED)], schema=_SETTLED)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest place of every window of every context; rows arrive sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("shard").to_numpy()
        sizes = np.cumsum(np.diff(tx.raw(batch.column("bytes"))[1]))
        begin = 0
        # cut where a shard is full and a group ends
        for edge in (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist():
            full = sum(b.nbytes for b in held) + int(sizes[edge - 1] - (sizes[begin - 1] if begin else 0)) >= SHARD
            if held and begin == 0 and full or not held and full:
                yield _solved(pa.Table.from_batches([*held, batch.slice(begin, edge - begin)]))
                held, begin = [], edge
        rest = batch.slice(begin)
        if held and begin == 0 and held[-1].column("shard")[-1].as_py() != group[0] and sum(b.nbytes for b in held) >= SHARD:
            yield _solved(pa.Table.from_batches(held))
            held = []
        held.append(rest)
    if held:
        yield _solved(pa.Table.from_batches(held))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges covered by windows that start earlier elsewhere."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("at", pa.int64()), ("to", pa.int64())])
    for batch in batches:
        doc, key, first_doc, first_start = (batch.column(c).to_numpy() for c in ("doc_id", "text_key", "first_doc", "first_start"))
        start = batch.column("start").to_numpy() + batch.column("at").to_numpy()
        part = batch.column("part")
        span = np.where(part.is_valid().to_numpy(zero_copy_only=False), part.fill_null(0).to_numpy(), batch.column("span").to_numpy()).astype(np.int64)
        later = (first_doc < doc) | ((first_doc == doc) & (first_start < start))
        lists = [batch.column(c) for c in ("windows", "docs", "starts")]
        sizes = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # one verdict for all windows of the context
        whole = np.flatnonzero(later & (sizes == 0))
        rows, low, high = [whole], [start[whole]], [start[whole] + span[whole]]
        mixed = np.flatnonzero(sizes > 0)
        if len(mixed):
            window, other, place = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
            count = span[mixed] + 1
            edge = np.cumsum(count) - count
            gone = np.repeat(later[mixed], count)
            owner = np.repeat(mixed, sizes[mixed])
            gone[np.repeat(edge, sizes[mixed]) + window] = (other < doc[owner]) | ((other == doc[owner]) & (place < start[owner] + window))
            # runs of windows that go, cut where a row ends
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1]
            closes[:-1] &= ~gone[1:]
            opens[edge] = gone[edge]
            last = edge + count - 1
            closes[last] = gone[last]
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            row = np.searchsorted(edge, opens, "right") - 1
            rows.append(mixed[row])
            low.append(start[mixed[row]] + opens - edge[row])
            high.append(start[mixed[row]] + closes - edge[row])
        row, low, high = np.concatenate(rows), np.concatenate(low), np.concatenate(high)
        if len(row):
            yield pa.record_batch([doc[row], key[row], low, high + LENGTH], schema=schema)


def _sorted_out(shards: DataFrame) -> DataFrame:
    # shards hold whole groups
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_settle, _KIND)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def repeated_spans(docs: DataFrame, bits: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, at, to: byte ranges to remove; ranges may overlap."""
    rows = keyed(docs).where("doc_id IS NOT NULL")
    if bits is None:
        bits = sketch.bits_for(rows.count() * 150)
    repeated = sketch.repeated_keys(rows, _keys_of, bits)
    found = rows.mapInArrow(*_contexts(repeated))
    distinct = found.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    distinct = _stored(distinct.select("anchor", "context", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start")), "contexts")
    kinds = _stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    # a context that stands once and has no other beside it says nothing
    judged = _stored(distinct.join(kinds, "anchor", "left").where("kinds IS NOT NULL OR n > 1"), "judged")
    mixed, alone = judged.where("kinds IS NOT NULL"), judged.where("kinds IS NULL")
    # the bytes of every distinct context, from its first place
    cell = F.col("context").bitwiseXOR(F.col("first_doc")).bitwiseXOR(F.shiftleft("first_doc", 9)).bitwiseXOR(F.col("first_start"))
    wanted = sketch.wide_bitmap(cell, mixed, sketch.wide_bits(mixed.count()))
    first = rows.mapInArrow(*_contexts(repeated, wanted)).select("anchor", "context", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"), "bytes")
    first = first.dropDuplicates(["anchor", "context", "first_doc", "first_start"])
    shards = mixed.join(first, ["anchor", "context", "first_doc", "first_start"]).select("anchor", "context", "kinds", "n", "first_doc", "first_start", "bytes")
    settled = ["anchor", "context", "at", "part", "first_doc", "first_start", "windows", "docs", "starts"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("windows", "array<int>"), ("docs", "array<bigint>"), ("starts", "array<bigint>"))]
    known = alone.select("anchor", "context", "first_doc", "first_start", *none).withColumns({"at": F.lit(0), "part": F.lit(None).cast("int")}).select(settled)
    crowded = F.col("kinds") > crowd
    if not kinds.where(crowded).isEmpty():
        shards = _stored(shards, "shards")
        parts = parted(shards.where(crowded), crowd)
        # a piece that many contexts have stands once
        pieces = parts.groupBy("shard", "piece").agg(F.min(F.struct("first_doc", "first_start")).alias("first"), F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
        pieces = pieces.select("shard", F.col("piece").alias("context"), "n", F.col("first.first_doc").alias("first_doc"), F.col("first.first_start").alias("first_start"), "bytes")
        found = parts.select("shard", F.col("piece").alias("context"), "anchor", "origin", "at", F.col("span").alias("part")).join(_sorted_out(pieces), ["shard", "context"])
        known = known.unionByName(found.drop("context").withColumnRenamed("origin", "context").select(settled))
        shards = shards.where(~crowded)
    solved = _sorted_out(shards.drop("kinds").withColumn("shard", F.col("anchor").cast("bigint")))
    solved = solved.withColumns({"anchor": F.col("shard").cast("int"), "at": F.lit(0), "part": F.lit(None).cast("int")}).select(settled)
    settled = solved.unionByName(known)
    places = rows.mapInArrow(*_contexts(repeated))
    return places.join(settled, ["anchor", "context"]).mapInArrow(_spans, "doc_id bigint, text_key int, at bigint, to bigint")


_RANGES = "doc_id bigint, text_key int, found array<struct<at: bigint, to: bigint>>"


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of every row in order; those that overlap or touch are one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("found")
        ranges = found.flatten()
        at, to = (ranges.field(c).to_numpy() for c in ("at", "to"))
        row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        by = np.lexsort((at, row))
        at, to, row = at[by], to[by], row[by]
        # ends are below 2**32, so a row's never reach the next one's
        reach = np.maximum.accumulate((row << 32) + to)
        opens = np.flatnonzero(np.concatenate(([True], (row << 32)[1:] + at[1:] > reach[:-1])))
        to = reach[np.append(opens[1:], len(row)) - 1] & 0xFFFFFFFF
        heads = np.searchsorted(row[opens], np.arange(len(found) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(heads), pa.StructArray.from_arrays([pa.array(at[opens]), pa.array(to)], ["at", "to"]))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), lists], names=["doc_id", "text_key", "found"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        found = batch.column("found")
        for i, j, data, offsets in tx.pieces(batch.column("text")):
            total, gone, spans, digest, left = [], [], [], [], []
            for k in range(j - i):
                own = data[offsets[k] : offsets[k + 1]]
                kept, runs = own, 0
                if found[i + k].is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    ranges = found[i + k].values
                    np.add.at(edge, ranges.field("at").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, ranges.field("to").to_numpy(zero_copy_only=False), -1)
                    out = np.cumsum(edge[:-1]) > 0
                    kept = own[~out]
                    runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                total.append(len(own))
                gone.append(len(own) - len(kept))
                spans.append(runs)
                left.append(kept.tobytes())
                digest.append(hashlib.sha256(left[-1]).hexdigest())
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), *(pa.array(c, pa.int64()) for c in (total, gone, spans)), pa.array(digest), pa.array(left, pa.binary())], schema=schema)


def dedup_bytes(docs: DataFrame, bits: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    # spans are dealt as they are: lists begun in every task would be several times as wide
    found = repeated_spans(docs, bits, crowd).repartition("doc_id", "text_key").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "to")).alias("found"))
    found = found.mapInArrow(_united, _RANGES)
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return sketch.with_found(keyed(docs), found, _cut, kind)
