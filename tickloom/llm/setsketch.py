"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct 5-word shingles. Every register keeps the
smallest of exponential variables drawn from the elements, stored as its floor on an
exponentially spaced scale and truncated to 16 bits: registers of a union are the maximum of
registers, and two registers agree with a probability close to the Jaccard similarity. Bands
of registers give candidate pairs, a joint likelihood of both cardinalities and the registers
drops the hopeless ones, and the rest is confirmed on the full sets.

Hot groups: equal sets are one class before any pair is formed. A bucket links its classes to
three leaders only. What stays unconnected in it after that is compared across components inside
the task that holds the bucket, in blocks of bounded size; only links leave the task, so a group
of copies never becomes rows for all its pairs. Components are found by repeated joins on tables
written to the shared folder; nothing of the size of the corpus reaches the driver.

Recall of the bands: a pair at the threshold of 0.85 meets in at least one of 20 bands of 5
registers with probability 1 - (1 - 0.85**5)**20, above 0.99999. The likelihood filter on all 200
registers lies five standard deviations below the threshold.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and is kept; a text shorter than a shingle is one shingle. A row without doc_id is
linked with nothing and kept, with a null component. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import textops as tx

SHINGLE = 5
BANDS, BAND_ROWS = 20, 5
REGISTERS = 200  # the first BANDS * BAND_ROWS of them make the bands
BLOCK = 2048  # classes of a bucket that are compared at once
LOG_BASE = np.log(1.01)
RATE = 20.0
TOP = 2**16 - 1
LINK = (85, 100)  # 100 * intersection >= 85 * union
SLACK = 0.125  # how far below the threshold an estimate may lie and still be confirmed


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row, A-Z in lower case."""
    low = tx.LOWER[data]
    starts, ends, row = tx.words(low, offsets)
    hashes = tx.word_hashes(low, starts, ends)
    first = np.searchsorted(row, np.arange(len(offsets)))
    grams = tx.gram_hashes(hashes, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            out.append(tx.gram_hashes(hashes[lo:hi], hi - lo) ^ tx.U(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers per set; empty sets get zeros.

    An element's points form a Poisson process over time and registers, so each register's
    first point is exponential. Points come in ascending order; an element stops once its
    next point lies above the largest minimum of its set.
    """
    sizes = np.array([len(s) for s in sets])
    low = np.full((len(sets), m), np.inf)
    flat = low.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        draw = tx.mix(element + tx.U((turn * 0xD1342543DE82EF95) % 2**64))
        time = time - np.log(((draw >> tx.U(24)) + tx.U(1)).astype(np.float64) * 2.0**-40) / m
        place = ((draw & tx.U(0xFFFFFF)) * tx.U(m)) >> tx.U(24)
        np.minimum.at(flat, owner * m + place.astype(np.int64), time)
        if turn <= 8 or turn % 8 == 0:
            stays = time < low.max(axis=1)[owner]
            if not stays.all():
                element, owner, time = element[stays], owner[stays], time[stays]
    low[sizes == 0] = np.inf
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(low / RATE) / LOG_BASE)
    return np.clip(level, 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of many pairs: the largest joint likelihood given both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    base = np.exp(LOG_BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (base - 1) / base) / LOG_BASE, 1e-12, 1.0)

    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    above, below = p(u - v * grid), p(v - u * grid)
    chance = more * np.log(above) + less * np.log(below) + same * np.log(np.clip(1 - above - below, 1e-12, 1))
    return grid[np.arange(len(grid)), chance.argmax(1)]


SKETCH = "doc_id bigint, text_key int, n_shingles bigint, set_key binary, bands array<bigint>, registers binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * tx.U(0x9E3779B97F4A7C15)
    for batch in batches:
        for i, j, data, offsets in tx.pieces(batch.column("text"), 2 * tx.PIECE):
            sets = shingle_sets(data, offsets)
            regs = registers(sets)
            keys = np.tile(seeds, (len(sets), 1))
            for r in range(BAND_ROWS):
                keys = tx.mix(keys + regs[:, r : BANDS * BAND_ROWS : BAND_ROWS].astype(np.uint64) * tx.FACTORS[r])
            # two independent sums over the set stand for it
            marks = [np.array([s.sum(dtype=np.uint64), tx.mix(s ^ tx.FACTORS[0]).sum(dtype=np.uint64), len(s)], np.uint64).tobytes() for s in sets]
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("text_key").slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                schema=_SKETCH,
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1).astype(np.int32) for c in ("registers_a", "registers_b"))
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
        yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b, n_a, n_b) >= LINK[0] / LINK[1] - SLACK))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) * LINK[1] < len(large) * LINK[0]:
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return shared * LINK[1] >= (len(a) + len(b) - shared) * LINK[0]


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [s for _, _, data, offsets in tx.pieces(column) for s in shingle_sets(data, offsets)]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [_similar(a, b) for a, b in zip(_sets_of(batch.column("text_a")), _sets_of(batch.column("text_b")))]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by band, low and high block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[:, i])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs of a group that may be linked and are not connected yet, likeliest first.

    A pair that shares several bands is taken in the first of them.
    """
    regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), "<u2").reshape(group.num_rows, -1)
    size, label, block, number = (group.column(c).to_numpy() for c in ("n_shingles", "component", "block", "band_no"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    band = int(number[0])
    found = []
    for x in range(len(regs) - 1):
        y = np.arange(x + 1, len(regs)) if lo == hi else np.flatnonzero(block == hi) if block[x] == lo else np.zeros(0, int)
        close = np.minimum(size[y], size[x]) * LINK[1] >= np.maximum(size[y], size[x]) * LINK[0]
        y = y[close & (label[y] != label[x])]
        if not len(y):
            continue
        equal = regs[y] == regs[x]
        # two sets of a link share ten deviations more registers than this
        near = equal.mean(axis=1) >= 0.6
        if band:
            near &= ~equal[:, : band * BAND_ROWS].reshape(len(y), band, BAND_ROWS).all(axis=2).any(axis=1)
        y = y[near]
        if len(y):
            rank = estimate(regs[x : x + 1].astype(np.int32), regs[y].astype(np.int32), np.full(len(y), float(size[x])), size[y].astype(float))
            likely = rank >= LINK[0] / LINK[1] - SLACK
            found.append((np.full(int(likely.sum()), x), y[likely], rank[likely]))
    if not found:
        none = np.zeros(0, int)
        return none, none, label, none
    a, b, rank = (np.concatenate(v) for v in zip(*found))
    order = np.argsort(-rank, kind="stable")
    return a[order], b[order], label, rank[order]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group that are in at least one open pair."""
    for group in _groups(batches):
        a, b, _, _ = _open_pairs(group)
        if len(a):
            yield from group.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed pairs of a group, as many as connect what can be connected in it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for group in _groups(batches):
        first, second, label, _ = _open_pairs(group)
        ids = group.column("id").to_numpy()
        sets = _sets_of(group.column("text")) if len(first) else []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for x, y in zip(first.tolist(), second.tolist()):
            u, v = top(int(label[x])), top(int(label[y]))
            if u != v and _similar(sets[x], sets[y]):
                root[u] = v
                out.append((int(ids[x]), int(ids[y])))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"registers_{c}")), c)
    # sizes alone rule out a link where the smaller set is too small
    close = F.least("n_a", "n_b") * LINK[1] >= F.greatest("n_a", "n_b") * LINK[0]
    likely = pairs.where(close).mapInArrow(_likely, "a bigint, b bigint")
    for c in ("a", "b"):
        likely = likely.join(texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), c)
    return likely.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a bigint, b bigint")


def connect(crowd: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components that share a bucket.

    A bucket of more than ``BLOCK`` classes is cut into blocks and every pair of blocks is a
    group of its own, so no task holds more than two blocks.
    """
    placed = crowd.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least < most")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    facing = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rows = placed.join(mixed, "band").select("band", "band_no", "id", "component", block.alias("block"), facing)
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    rows = rows.join(classes.select("id", "n_shingles", "registers"), "id")
    kind = "band bigint, band_no int, id bigint, component bigint, block int, lo int, hi int, n_shingles bigint, registers binary"
    order = ["band", "lo", "hi"]
    shape = rows.select(*[c.split()[0] for c in kind.split(", ")])
    needed = shape.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(_needed, kind)
    full = needed.join(texts, "id").select(*shape.columns, "text")
    return full.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id on an edge (a, b).

    Alternates linking every node's larger neighbours, then its smaller ones, to the smallest
    known; the edges become stars in logarithmically many rounds, each stored.
    """
    edges = _stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own minimum keeps no edge here: its neighbours point at it already
        large = _stored(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = _stored(small.where("u <> v").distinct(), "edges")
        # stars: every node has one target, and no target has a target
        if after.agg(F.sum(F.hash("u", "v").cast("bigint")), F.count("*")).first() == edges.agg(F.sum(F.hash("u", "v").cast("bigint")), F.count("*")).first():
            break
        edges = after
    links = edges.groupBy("u").agg(F.min("v").alias("component"))
    return links.select(F.col("u").alias("id"), "component").unionByName(links.select(F.col("component").alias("id"), "component").distinct())


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that tells texts under one doc_id apart."""
    return docs.withColumn("text_key", F.shiftright(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 33).cast("int"))


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and text_key."""
    return keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id of an equal set), text_key and component.

    ``component`` is a number of the component: two components have one component_id where texts that share a doc_id stand in both.
    """
    rows = classes_of(docs)
    sketches = _stored(rows.mapInArrow(_sketches, SKETCH), "sketches")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class is a set of shingles with a number of its own, since one doc_id may stand for several texts
    members = full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    # among rows of the smallest doc_id with an equal set any text will do: the set is the same
    first = full.select("set_key", "doc_id", "text_key", "n_shingles", "bands", "registers").join(members, ["set_key", "doc_id"])
    classes = _stored(first.dropDuplicates(["set_key"]).withColumn("id", F.monotonically_increasing_id()), "classes")
    rows_with_id = rows.where("doc_id IS NOT NULL")
    buckets = classes.select("id", F.posexplode("bands").alias("band_no", "band"))
    shared = buckets.groupBy("band").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.max_by("id", F.xxhash64("id")).alias("other")
    ).where("low < high")
    crowd = _stored(buckets.join(shared, "band"), "buckets")
    stars = crowd.select("id", F.explode(F.array_distinct(F.array("low", "high", "other"))).alias("leader")).where("id <> leader")
    tried = stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    # the texts of classes that share a bucket with another one
    wanted = classes.join(crowd.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key")
    held = rows_with_id.select("doc_id", "text_key", "text").join(wanted, ["doc_id", "text_key"])
    texts = _stored(held.dropDuplicates(["id"]).select("id", "text"), "texts")
    links = _stored(confirm(tried, classes, texts), "links")
    labels = _stored(components(links), "labels")
    more = connect(crowd.select("id", "band_no", "band"), labels, classes, texts)
    final = _stored(components(links.unionByName(more)), "labels")
    named = classes.select("set_key", "doc_id", "id").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    owner = named.join(least, "component").select("set_key", F.col("doc_id").alias("class_id"), "component_id", "component")
    # rows without a set or an id meet no owner
    joined = sketches.select("doc_id", "text_key", "n_shingles", "set_key").join(owner, "set_key", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "text_key",
        F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
    )
