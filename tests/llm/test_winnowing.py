"""Winnowing: repeated words and rows, long texts."""

import time

import numpy as np
import pyarrow as pa

from docweave.llm import winnowing


def test_repeated_words_equal_brute_force(spark):
    items = [(0, "x " * 40), (1, "a b " * 20 + "end"), (2, "x " * 15 + "y " + "x " * 15), (3, "q " * 9), (3, "q " * 9)]
    docs = ["x " * 60, "x " * 9 + "y " + "x " * 30, "b a " * 30, "z " + "a b " * 4 + "a end", "q " * 30, "x " * 9, None, "x y " * 30, "x " * 60]
    frame = spark.createDataFrame([(None if i == 6 else i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    got = {r.doc_id: tuple(r) for r in winnowing.decontamination_report(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = winnowing.report_by_brute_force([(None if i == 6 else i, t) for i, t in enumerate(docs)], items)
    assert list(got.values()) and got == {w[0]: w for w in want}


def test_one_repeated_word_takes_linear_time():
    item = "x " * 20_000
    prints = winnowing.Fingerprints([0], [item], 10, 5)
    (part,) = winnowing._word_hashes(pa.array([item * 5], pa.large_string()))
    t = time.perf_counter()
    found = prints.hits(part[1], part[2])
    assert time.perf_counter() - t < 10  # a quadratic comparison takes minutes
    assert winnowing._merge([(s, e) for _, s, e in found[0]]) == [(0, 100_000)] and np.all(np.diff(part[2]) == 100_000)
