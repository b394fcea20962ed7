"""Removal of word windows that already stand in an earlier document.

A first pass sketches window keys (``sketch``): the key of a window is its smallest gram, so a
window's count is never above the count of its key and neighbouring windows share one. A second
pass groups exactly the windows whose key may be repeated, on 80 bits of their words' hash.
Windows are judged on the input.

Defined results: a null or empty text has no words; a text shorter than a window keeps all its
words; rows with the same doc_id never remove each other's words; a row without doc_id keeps
all its words and removes none of others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from . import textops as tx

WINDOW = 13
GRAM = 8


def _keys(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Word hashes, word rows, valid window starts and the gram position each is keyed by."""
    starts, ends, row = tx.words(data, offsets)
    hashes = tx.word_hashes(data, starts, ends)
    if len(hashes) < window:
        return hashes, row, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = tx.gram_hashes(hashes, gram)
    at = tx.minimizers(grams, window - gram + 1)
    whole = np.flatnonzero(row[: len(at)] == row[window - 1 : window - 1 + len(at)])
    return hashes, row, whole, at[whole], grams


def _anchors(window: int, gram: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in tx.pieces(batch.column("text")):
            _, _, whole, at, grams = _keys(data, offsets, window, gram)
            if len(whole):
                yield grams[np.unique(at)]

    return keys_of


def _row_keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("text_key").to_numpy(zero_copy_only=False).astype(np.int64)


def _suspects(repeated, window: int, gram: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int16()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = repeated.value.test
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = _row_keys(batch)
            for i, j, data, offsets in tx.pieces(batch.column("text")):
                hashes, row, whole, at, grams = _keys(data, offsets, window, gram)
                if not len(whole):
                    continue
                maybe = test(grams[at])
                if not maybe.any():
                    continue
                start = whole[maybe]
                h1 = tx.gram_hashes(hashes, window)[start]
                h2 = tx.gram_hashes(hashes, window, tx.FACTORS2)[start]
                first = np.searchsorted(row, np.arange(j - i))
                owner = row[start]
                place = (texts[i:j][owner] << 32) | (start - first[owner])
                yield pa.record_batch(
                    [h1.view(np.int64), (h2 >> tx.U(48)).astype(np.uint16).view(np.int16), ids[i:j][owner], place], schema=schema
                )

    return run, "h1 bigint, h2 smallint, doc_id bigint, at bigint"


def _keep(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            for i, j, data, offsets in tx.pieces(batch.column("text")):
                starts, ends, row = tx.words(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                text = data.tobytes()
                total, gone, digest, kept = [], [], [], []
                for k in range(j - i):
                    lo, hi = int(first[k]), int(first[k + 1])
                    stays = np.ones(hi - lo, bool)
                    hits = found[i + k]
                    if hits.is_valid:
                        edge = np.zeros(hi - lo + 1, np.int64)
                        at = hits.values.to_numpy(zero_copy_only=False).astype(np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                    index = lo + np.flatnonzero(stays)
                    left = b" ".join([text[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())])
                    total.append(hi - lo)
                    gone.append(hi - lo - len(index))
                    digest.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "replace"))
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.record_batch([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), digest, pa.array(kept, pa.string())], schema=schema)

    return run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """doc_id, text_key and the start words of windows that start in a smaller doc_id too.

    ``docs`` needs doc_id and text. ``bits`` sets the sketch; by default it follows the row count.
    """
    rows = keyed(docs).where("doc_id IS NOT NULL")
    if bits is None:
        bits = sketch.bits_for(rows.count() * 200)
    repeated = sketch.repeated_keys(rows, _anchors(window, gram), bits)
    found = rows.mapInArrow(*_suspects(repeated, window, gram))
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    later = found.join(first, ["h1", "h2"]).where("doc_id > first")
    return later.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("text_key")).agg(
        F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("found")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a key that tells texts under one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.shiftright(F.xxhash64(text), 33).cast("int").alias("text_key"))


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (words joined by a space)."""
    found = repeated_windows(docs, window, gram, bits)
    return sketch.with_found(keyed(docs), found, *_keep(window))
