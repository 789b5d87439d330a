"""Sharding: ranges by bounds against a plain search, repeated rows, an overfull range that is cut."""

import random

import pyarrow as pa
import pytest

from docweave.llm import sharding


def test_ranges_equal_a_plain_search():
    r = random.Random(4)
    key = lambda: (r.randrange(5), r.randrange(3), r.randrange(4))
    for n in (0, 1, 12):
        bounds, rows = sorted({key() for _ in range(n)}), [key() for _ in range(200)]
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["h", "id", "row"])
        (out,) = sharding._ranges(bounds)([batch])
        assert out.column("range").to_pylist() == [sum(b <= x for b in bounds) for x in rows]


@pytest.mark.parametrize("ids", [None, 7])
def test_repeated_rows_are_cut_into_ranges(spark, monkeypatch, ids):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    texts = ["the same text"] * 3000 + [f"text {i} " * (i % 20) for i in range(1500)] + ["x" * 20_000]
    docs = spark.createDataFrame([(ids, t, 1) if i < 3000 else (i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    seen = []
    real = sharding._ranges
    monkeypatch.setattr(sharding, "_ranges", lambda bounds: seen.append(bounds) or real(bounds))
    rows = sharding.shard_report(docs).collect()
    assert len({b for b in seen[-1] if b[0] in {x[0] for x in seen[-1] if sum(y[0] == x[0] for y in seen[-1]) > 20}}) > 20  # the one text has many bounds
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24)) and len(rows) == len(texts)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = sorted(sum(r.size for r in x) for x in by.values())
    assert sizes[-1] - sizes[0] <= 2 * 20_008
    group = sorted({r.shard for r in rows if r.text_crc32 == rows[0].text_crc32} if texts[0] == "the same text" else ())
    assert group == list(range(group[0], group[-1] + 1))
