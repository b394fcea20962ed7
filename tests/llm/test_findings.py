"""Third round: memory of op8's tasks. Fourth round: disk of op4 on many texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import sketch, suffixes, textops, toxicity


def test_texts_become_strings_piece_by_piece():
    texts = ["you idiot. " * 9000] * 40 + ["", "x" * (3 * textops.PIECE)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(toxicity.piecewise(batch))
    assert [t for _, strings in parts for t in strings] == texts
    assert [i for part, _ in parts for i in part.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(len(strings) == 1 or sum(map(len, strings)) <= textops.PIECE for _, strings in parts)


def test_marks_follow_the_keys_that_repeat(spark):
    # three times as many different keys as cells, and 20,000 that repeat
    keys = np.random.default_rng(3).integers(0, 2**63, 3 << 20, dtype=np.uint64)
    keys[-20000:] = keys[:20000]
    df = spark.createDataFrame([(i,) for i in range(8)], "part int").repartition(4)
    repeated = sketch.repeated_keys(df, lambda batch: (np.array_split(keys, 8)[i] for i in batch.column("part").to_pylist()), 20).value
    assert repeated.test(keys[:20000]).all()
    assert repeated.test(keys[20000:-20000]).mean() < 0.01


def test_wanted_places_have_cells_enough(spark):
    assert sketch.wide_bits(1000) == sketch.MARK_BITS and sketch.wide_bits(12_700_000) == 28 == sketch.wide_bits(10**9)
    cells = [5, 1 << 20, (1 << 24) + 5, (1 << 26) - 1, -1, 5]
    table = sketch.wide_bitmap(F.col("c"), spark.createDataFrame([(c,) for c in cells], "c long"), 26).value
    assert np.flatnonzero(np.unpackbits(table, bitorder="little")).tolist() == sorted({c % (1 << 26) for c in cells})


def test_ranges_are_united():
    rng = np.random.default_rng(4)
    lists = [[(int(a), int(a + n)) for a, n in zip(rng.integers(0, 400, k), rng.integers(1, 30, k))] for k in rng.integers(1, 40, 50)]
    batch = pa.record_batch({
        "doc_id": pa.array(range(50), pa.int64()), "text_key": pa.array([0] * 50, pa.int32()),
        "found": pa.array([[{"at": a, "to": b} for a, b in own] for own in lists], pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))),
    })
    for part in (batch, batch.slice(7, 20), batch.slice(0, 0)):
        (out,) = [b.column("found").to_pylist() for b in suffixes._united(iter([part]))] or [[]]
        for found, own in zip(out, part.column("found").to_pylist(), strict=True):
            ranges = [(r["at"], r["to"]) for r in found]
            assert {x for a, b in ranges for x in range(a, b)} == {x for r in own for x in range(r["at"], r["to"])}
            assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
