"""Ranked lexical search: every document scored for every item, by masks of matched terms.

Terms are the maximal stretches of ASCII letters and digits and of all characters past ASCII; only
A-Z are lower-cased. The items are read in blocks of ``ITEM_BYTES``, and each block's terms are
its vocabulary. A first pass turns documents into segments: up to ``DOCS`` documents with the occurrences of
vocabulary terms in them, sorted by term. Words are looked up by hash and compared byte by byte, so no
other word counts. Segments are written once; counts over them give the corpus figures of the weights.

The second pass reads segments. Each term of a segment is a bitmap over its documents. For an item the
bitmaps of its terms are turned round into one mask per document, equal masks are one group, and a
group's maximum score adds, over the terms of its mask, what the term can give at most in the segment:
its largest occurrence count in a document as short as the shortest. Groups are scored by falling maximum until it is
below the item's k-th best score so far; equal ones go on, since ties are settled by doc_id. Each task
keeps k documents per item and hands them on once; the ranks are cut by a rank filter.

Nothing of the corpus goes to the driver but two sums and one count per term of a block. A block is
bounded by ``ITEM_BYTES`` (one longer item is a block of its own), and so is what is broadcast.

Defined results: a null or empty text has no terms; such a document counts nowhere and such an item
returns nothing. Repeated item rows count once; texts that share an item_id are items of their own under that id.
Every document row is a document, repeated or not; rows of one score and doc_id follow each other, and rows without
doc_id come after all others of their score. Other columns are not read. No documents or items: no
rows. Scores are exact while 50 * terms of a document * documents stays in 128 bits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from . import textops as tx

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_BYTES = 4 << 20
DOCS = 4096
POSTINGS = 1 << 21  # a segment is closed at so many entries
LAST = np.iinfo(np.int64).max  # the place of rows without doc_id among equal scores

# a term's bytes with A-Z lower-cased, a space for all other bytes
FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    FOLD[_low:_high] = tx.LOWER[_low:_high]


class Items:
    """A block of items: their terms as numbers into a vocabulary that is looked up by hash."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        terms = [sorted({x.encode() for x in re.findall(TERM, (text or "").translate(lower))}) for _, text in rows]
        words = sorted({x for own in terms for x in own})
        self.ids = [item_id for item_id, _ in rows]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = tx.word_hashes(self.data, self.starts, self.starts + self.sizes) if words else np.zeros(0, np.uint64)
        self.by = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by]
        number = {w: k for k, w in enumerate(words)}
        self.terms = [np.array([number[x] for x in own], np.int64) for own in terms]

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms of the block, and their numbers."""
        hashes = tx.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.by[at[word]]
        sizes = ends[word] - starts[word]
        equal = sizes == self.sizes[term]
        word, term, sizes = word[equal], term[equal], sizes[equal]
        if len(word):
            edge = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(edge, sizes)
            same = data[step + np.repeat(starts[word], sizes)] == self.data[step + np.repeat(self.starts[term], sizes)]
            equal = np.logical_and.reduceat(same, edge)
            word, term = word[equal], term[equal]
        return word, term


_SEGMENT = "n_docs bigint, n_terms bigint, ids binary, lengths binary, terms binary, docs binary, counts binary"
_NUMBERS = {"ids": np.int64, "lengths": np.int64, "terms": np.int32, "docs": np.int32, "counts": np.int32}


def _segments(items):
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in _NUMBERS)])

    def close(held: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids, lengths, terms, docs, counts = (np.concatenate([h[k] for h in held]) for k in range(5))
        by = np.argsort(terms, kind="stable")
        parts = dict(ids=ids, lengths=lengths, terms=terms[by], docs=docs[by], counts=counts[by])
        return pa.record_batch([[n_docs], [n_terms], *(pa.array([parts[c].astype(t).tobytes()], pa.binary()) for c, t in _NUMBERS.items())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        held, n_docs, n_terms, n_ids, n_held = [], 0, 0, 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tx.pieces(batch.column("text")):
                folded = FOLD[data]
                starts, ends, row = tx.words(folded, offsets)
                lengths = np.bincount(row, minlength=j - i)
                n_docs += int((lengths > 0).sum())
                n_terms += len(row)
                word, term = block.find(folded, starts, ends) if len(block) else (row[:0], row[:0])
                key, counts = np.unique(row[word] * max(len(block), 1) + term, return_counts=True)
                doc, term = np.divmod(key, max(len(block), 1))
                mine, local = np.unique(doc, return_inverse=True)
                held.append((ids[i:j][mine], lengths[mine], term, n_ids + local, counts))
                n_ids, n_held = n_ids + len(mine), n_held + len(term)
                if n_ids >= DOCS or n_held >= POSTINGS:
                    yield close(held, n_docs, n_terms)
                    held, n_docs, n_terms, n_ids, n_held = [], 0, 0, 0, 0
        if held:
            yield close(held, n_docs, n_terms)

    return run, _SEGMENT


def _holders(size: int):
    """Documents of a task that hold each term."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("terms"):
                total += np.bincount(np.frombuffer(blob.as_buffer(), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.record_batch([held.astype(np.int32), total[held]], schema=schema)

    return run, "term int, df bigint"


def _shares(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * norms)


class Segment:
    """Bitmaps over the documents of a segment, one per term that occurs in it."""

    def __init__(self, row: dict[str, np.ndarray], weights: np.ndarray, n: int, total: int):
        self.ids, self.docs, self.counts = row["ids"], row["docs"], row["counts"].astype(np.int64)
        lengths = row["lengths"]
        wide = lengths.astype(object) if len(lengths) and 50 * int(lengths.max()) * n > LAST else lengths
        self.norms = (50 + (50 * wide * n) // max(total, 1)).astype(np.int64)
        self.present, self.first = np.unique(row["terms"], return_index=True)
        self.stop = np.append(self.first[1:], len(row["terms"]))
        self.bitmaps = np.zeros((len(self.present), -(-len(self.ids) // 8)), np.uint8)
        at = np.repeat(np.arange(len(self.present)), self.stop - self.first)
        np.bitwise_or.at(self.bitmaps, (at, self.docs >> 3), (128 >> (self.docs & 7)).astype(np.uint8))
        if len(self.present):
            most = np.maximum.reduceat(self.counts, self.first)
            self.weights = weights[self.present]
            self.most = self.weights * _shares(most, self.norms.min())

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms that occur their places; documents sorted by group; group starts; maximum scores."""
        at = np.searchsorted(self.present, terms)
        inside = at < len(self.present)
        own = at[inside][self.present[at[inside]] == terms[inside]]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bitmaps[own], axis=0), count=len(self.ids))) if len(own) else own
        if not len(docs):
            return own, docs, docs, docs
        bits = np.unpackbits(self.bitmaps[own], axis=1, count=len(self.ids))[:, docs]
        packed = np.packbits(bits, axis=0)
        words = -(-len(packed) // 8)
        mask = np.zeros((len(docs), 8 * words), np.uint8)
        mask[:, : len(packed)] = packed.T
        mask = mask.view(np.uint64)
        by = np.argsort(mask[:, 0], kind="stable") if words == 1 else np.lexsort(mask.T)
        new = np.ones(len(docs), bool)
        new[1:] = (mask[by][1:] != mask[by][:-1]).any(axis=1)
        start = np.flatnonzero(new)
        return own, docs[by], start, self.most[own] @ bits[:, by[start]].astype(np.int64)

    def scores(self, own: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for the terms at places ``own``."""
        place = np.full(len(self.ids), -1, np.int64)
        place[docs] = np.arange(len(docs))
        out = np.zeros(len(docs), np.int64)
        for t in own:
            span = slice(self.first[t], self.stop[t])
            at = place[self.docs[span]]
            hit = np.flatnonzero(at >= 0)
            at, counts = at[hit], self.counts[span][hit]
            out[at] += self.weights[t] * _shares(counts, self.norms[docs[at]])
        return out


class Best:
    """The k best documents so far: falling scores, equal ones by rising id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores >= self.floor()
        scores, ids = np.concatenate((self.scores, scores[use])), np.concatenate((self.ids, ids[use]))
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[by], ids[by]


def search_segment(segment: Segment, terms: np.ndarray, best: Best) -> int:
    """Score groups by falling maximum until it is below the k-th best; how many documents were scored."""
    own, docs, start, most = segment.groups(terms)
    if not len(docs):
        return 0
    order = np.argsort(-most, kind="stable")
    size = np.diff(np.append(start, len(docs)))[order]
    done = np.cumsum(size)
    k, seen = 0, 0
    while k < len(order) and most[order[k]] >= best.floor():
        # as many groups as it takes for k documents, of those whose maximum may do
        stop = min(int(np.searchsorted(done, seen + best.k)) + 1, len(order))
        stop = k + int((most[order[k:stop]] >= best.floor()).sum())
        index = np.repeat(start[order[k:stop]], size[k:stop])
        index += np.arange(len(index)) - np.repeat(np.cumsum(size[k:stop]) - size[k:stop], size[k:stop])
        part = docs[index]
        best.add(segment.scores(own, part), segment.ids[part])
        k, seen = stop, seen + len(part)
    return seen


def _search(items, weights: np.ndarray, n: int, total: int, k: int):
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        best = [Best(k) for _ in block.ids]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment({c: np.frombuffer(row[c], t) for c, t in _NUMBERS.items()}, weights, n, total)
                if not len(segment.present):
                    continue
                for terms, own in zip(block.terms, best):
                    search_segment(segment, terms, own)
        for number, (item_id, own) in enumerate(zip(block.ids, best)):
            if len(own.ids):
                ids = pa.array(own.ids, pa.int64(), mask=own.ids == LAST)
                yield pa.record_batch([pa.array([number] * len(ids), pa.int32()), pa.array([item_id] * len(ids), pa.int64()), ids, own.scores], schema=schema)

    return run, "item int, item_id bigint, doc_id bigint, score bigint"


def _blocks(items: DataFrame, limit: int) -> Iterator[Items]:
    """Distinct items in blocks of ``limit`` bytes of text, read one partition at a time."""
    rows, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").distinct().where("length(text) > 0").toLocalIterator():
        more = len(row[1].encode())
        if rows and size + more > limit:
            yield Items(rows)
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += more
    if rows:
        yield Items(rows)


_RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def _ranked(spark: SparkSession, rows: DataFrame, block: Items, k: int) -> DataFrame:
    items = spark.sparkContext.broadcast(block)
    path = scratch(spark, "segments")
    rows.mapInArrow(*_segments(items)).write.parquet(path)
    segments = spark.read.parquet(path)
    n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    holders = segments.select("terms").mapInArrow(*_holders(len(block))).groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = dict(map(tuple, holders))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block))], np.int64)
    found = segments.mapInArrow(*_search(items, weights, n, total, k))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, limit: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = [_ranked(spark, rows, block, k) for block in _blocks(items, limit)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _RESULT)
