"""Spherical caps: tiles, rounding at the threshold, recall on the given vectors, awkward rows."""

import os

import numpy as np
import pytest

from docweave.llm import spherical_caps

SF = "/root/testdata/sf0.1"


def brute(ids, x, label, threshold=0.93):
    """Links of each row, and its component, by all pairs in double precision."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(ids)).min(1))
        if (new == root).all():
            return link.sum(1), np.array([min(ids[root == r]) for r in root])
        root = new


def test_tiles_of_a_hot_filter(spark, monkeypatch):
    monkeypatch.setattr(spherical_caps, "TILE", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=32) + 0.15 * rng.normal(size=(300, 32)), rng.normal(size=(100, 32))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in spherical_caps.cap_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n, component = brute(np.arange(400), x, np.zeros(400))
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= n).all() and 0.99 * n.sum() <= found.sum() and n.sum() > 20_000
    assert [got[i].component_id for i in range(400)] == component.tolist()


def test_threshold_is_decided_in_double_precision(spark):
    rows = []
    for i, off in enumerate((1e-9, -1e-9, 3e-7, -3e-7, 0.0)):
        a, b = np.zeros(16), np.zeros(16)
        a[i % 16] = 1.0
        b[i % 16], b[(i + 7) % 16] = 0.93 + off, np.sqrt(1 - (0.93 + off) ** 2)
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, b.tolist(), i)]
    got = {r.vec_id: r.n_links for r in spherical_caps.cap_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[2 * i] for i in range(4)] == [got[2 * i + 1] for i in range(4)] == [1, 0, 1, 0]


def test_awkward_rows(spark):
    v = [0.5] * 8
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, [float("inf")] * 8, 0), (3, [float("-inf")] + [1.0] * 7, 0), (4, [], 0), (5, [1.0, None] + v[:6], 0), (6, [x * 1e-300 for x in v], 0), (7, [x * 1e300 for x in v], 0), (None, None, None)]
    got = spherical_caps.cap_near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, dim string, c int")).collect()
    linked = [r for r in got if r.n_links]
    assert len(got) == 10 and len(linked) == 5 and {(r.n_links, r.component_id) for r in linked} == {(4, 1)}
    assert sorted((r.vec_id or 0, r.kept) for r in got if not r.n_links) == [(0, False), (2, True), (3, True), (4, True), (5, True)]


def test_code_grows_with_the_table():
    sizes = [spherical_caps.code_size(10**k) for k in range(3, 11)]
    assert sizes[0] == (3, 16) and all(b[1] ** b[0] >= a[1] ** a[0] for a, b in zip(sizes, sizes[1:]))
    assert all(10**k * spherical_caps.LEAST / w**n <= 2 * spherical_caps.CROWD for k, (n, w) in zip(range(5, 11), sizes[2:]))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * (lambda z: (z - (z * x).sum(1, keepdims=True) * x) / np.linalg.norm(z - (z * x).sum(1, keepdims=True) * x, axis=1, keepdims=True))(rng.normal(size=x.shape))
    for blocks, words in ((3, 16), (3, 32), (4, 32)):
        code = spherical_caps.ProductCode(64, blocks, words)
        sets = []
        for z in (x, y):
            f, n = code.decode(z)
            assert n.min() >= code.least >= spherical_caps.LEAST
            sets.append([set(p.tolist()) for p in np.split(f, np.cumsum(n)[:-1])])
        assert np.mean([bool(a & b) for a, b in zip(*sets)]) > 0.985  # pairs right at the threshold


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_on_the_given_vectors(spark):
    """Queries: ids divisible by 50, against all rows."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None and r.label is not None and any(r.embedding)]
    n, _ = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), np.array([r.label for r in rows]))
    got = {r.vec_id: r.n_links for r in spherical_caps.cap_near_duplicates(table).collect()}
    queries = [(got[r.vec_id], int(k)) for r, k in zip(rows, n) if r.vec_id % 50 == 0]
    assert sum(g for g, _ in queries) >= 0.99 * sum(k for _, k in queries) and all(g <= k for g, k in queries)
