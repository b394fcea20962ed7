"""Document quality by a convolution over bytes, trained and run in numpy.

Filters of ``WIDTH`` bytes slide over the whole text. Their rectified outputs are max-pooled in
chunks of two blocks that overlap by one, so every byte is in a chunk and no chunk edge hides a
pattern; the mean and the maximum of the chunk features over the document give one probability.

Training reads whole texts: the first labelled ones outside the held-out fold in hash order, at
most ``SAMPLE`` and as many as fit into ``SAMPLE_BYTES``, but one of each class at least. Features
are taken over the same chunks as in scoring. Scoring reads every byte.

Defined results: a null or empty text has zero features and gets the probability of the constant
term; without labels, or with one class only, every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import textops as tx
from .toxicity import training_rows

SAMPLE = 4_000
SAMPLE_BYTES = 1 << 26
WIDTH, FILTERS = 5, 12
BLOCK = 128
EPOCHS, RATE, BATCH = 8, 0.01, 64
PIECE = 1 << 18


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 256 x FILTERS: what a byte adds at a place of a filter
    bias: np.ndarray
    out: np.ndarray  # mean and maximum features, and the constant


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows set apart by zero bytes so that no filter reads two of them."""
    gap = WIDTH - 1
    moved = offsets + gap * np.arange(len(offsets))
    wide = np.zeros(int(moved[-1]), np.uint8)
    sizes = np.diff(offsets)
    wide[np.arange(len(data)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = data
    return wide, moved


def convolve(wide: np.ndarray, model: Model) -> np.ndarray:
    """Rectified filter outputs at every byte."""
    full = np.concatenate([wide, np.zeros(WIDTH - 1, np.uint8)])
    n = len(wide)
    total = model.table[0].take(full[:n], axis=0)
    for k in range(1, WIDTH):
        total += model.table[k].take(full[k : k + n], axis=0)
    total += model.bias
    return np.maximum(total, 0, out=total)


def _blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks and the row each belongs to; every filled row has at least one."""
    sizes = np.diff(offsets)
    count = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[row] + inside * BLOCK, row


def features(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Mean and maximum over overlapping chunks of each filter, per row."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 2 * FILTERS), np.float32)
    if not len(data):
        return out
    wide, moved = _padded(data, offsets)
    starts, row = _blocks(moved - (WIDTH - 1) * np.arange(len(moved)))
    # block starts in the padded text; a row's last block takes its padding along
    starts = starts + (WIDTH - 1) * row
    peak = np.maximum.reduceat(convolve(wide, model), starts, axis=0)
    # a chunk is a block and the next one of the same row
    chunk = peak.copy()
    joined = np.flatnonzero(row[1:] == row[:-1])
    chunk[joined] = np.maximum(peak[joined], peak[joined + 1])
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    owner = row[first]
    number = np.diff(np.concatenate((first, [len(row)])))[:, None]
    out[owner, :FILTERS] = np.add.reduceat(chunk, first, axis=0) / number
    out[owner, FILTERS:] = np.maximum.reduceat(chunk, first, axis=0)
    return out


def _peaks(full: np.ndarray, size: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter the place of the largest output and its value, over a text of ``size`` bytes with its padding."""
    places, peaks, step = [], [], PIECE // BLOCK * BLOCK
    last = (size - 1) // BLOCK * BLOCK
    for begin in range(0, last + 1, step):
        # the last block takes the padding along
        end = begin + step if begin + step <= last else size + WIDTH - 1
        values = convolve(full[begin : end + WIDTH - 1], model)[: end - begin]
        whole = min(begin + step, last) - begin
        if whole:
            blocks = values[:whole].reshape(-1, BLOCK, FILTERS)
            places.append(blocks.argmax(axis=1) + (begin + np.arange(0, whole, BLOCK))[:, None])
            peaks.append(blocks.max(axis=1))
        if end > last + BLOCK or end > size:
            places.append(values[whole:].argmax(axis=0)[None, :] + begin + whole)
            peaks.append(values[whole:].max(axis=0)[None, :])
    place, peak = np.concatenate(places), np.concatenate(peaks)
    after = peak[1:] > peak[:-1]
    joined_place, joined_peak = place.copy(), peak.copy()
    joined_place[:-1] = np.where(after, place[1:], place[:-1])
    joined_peak[:-1] = np.where(after, peak[1:], peak[:-1])
    return joined_place, joined_peak


def _train_step(texts: list[np.ndarray], y: np.ndarray, model: Model) -> tuple[list[np.ndarray], float]:
    """Gradients of the log loss on a batch; pooling passes them to one byte per chunk and filter."""
    grads = [np.zeros_like(model.table), np.zeros_like(model.bias), np.zeros_like(model.out)]
    loss = 0.0
    for text, label in zip(texts, y):
        if not len(text):
            continue
        # as in scoring, the padding behind a text counts
        full = np.concatenate([text, np.zeros(2 * (WIDTH - 1), np.uint8)])
        best, chunk = _peaks(full, len(text), model)
        top = chunk.argmax(axis=0)
        feat = np.concatenate([chunk.mean(axis=0), chunk.max(axis=0), [1.0]])
        p = 1 / (1 + np.exp(-np.clip(feat @ model.out, -30, 30)))
        loss -= np.log(max(p if label else 1 - p, 1e-9))
        err = p - label
        grads[2] += err * feat
        back = np.repeat((err * model.out[:FILTERS] / len(best))[None, :], len(best), axis=0)
        back[top, np.arange(FILTERS)] += err * model.out[FILTERS : 2 * FILTERS]
        back *= chunk > 0
        filters = np.broadcast_to(np.arange(FILTERS), best.shape)
        for k in range(WIDTH):
            np.add.at(grads[0][k], (full[best + k], filters), back)
        grads[1] += back.sum(axis=0)
    return [g / max(len(texts), 1) for g in grads], loss


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Adam over shuffled batches; the same rows in the same order give the same model."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    out = np.concatenate([rng.normal(0, 0.1, 2 * FILTERS), [np.log(rate / (1 - rate))]])
    model = Model(rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), out.astype(np.float32))
    params = [model.table, model.bias, model.out]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            grads, _ = _train_step([texts[j] for j in order[i : i + BATCH]], y[order[i : i + BATCH]], model)
            t += 1
            pace = RATE * (1 - epoch / epochs) + RATE * 0.1
            for p, g, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
    return model


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, limit_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model, or None where the labels have one class only.

    What reaches the driver is bounded by ``limit`` texts and ``limit_bytes``: a text beyond what is left of them is
    passed over, not cut, and the next ones are looked at. A class of which no text fits gives its first.
    """
    path = scratch(docs.sparkSession, "training")
    training_rows(docs, labels, "quality", limit).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    sizes = rows.select("mark", F.col("label").cast("int").alias("label"), F.octet_length("text").alias("size")).orderBy("mark").toArrow()
    mark, label, size = (sizes.column(c).to_numpy() for c in ("mark", "label", "size"))
    if not len(label) or label.min() == label.max():
        return None
    use, held = np.zeros(len(size), bool), 0
    for i, n in enumerate(size.tolist()):
        # a text that doesn't fit is left out, and only that one
        if held + n <= limit_bytes:
            use[i], held = True, held + n
    for c in np.unique(label):
        if not use[label == c].any():
            use[np.flatnonzero(label == c)[0]] = True
    wanted = mark[use].tolist()
    rows = rows.where(F.col("mark").isin(wanted)) if len(wanted) < len(mark) else rows
    rows = rows.orderBy("mark").select(F.col("label").cast("int").alias("label"), F.encode("text", "UTF-8").alias("bytes")).toArrow()
    texts = [np.frombuffer(t.as_buffer(), np.uint8) for t in rows.column("bytes")]
    return train(texts, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id and the probability that the text is of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tx.pieces(batch.column("text"), PIECE):
                if model is None:
                    p = np.full(j - i, 0.5)
                else:
                    z = features(data, offsets, model) @ model.out[:-1] + model.out[-1]
                    p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
