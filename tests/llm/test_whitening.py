"""Whitening against numpy's own decomposition."""

import numpy as np
import pytest

from siteweave.llm import whitening
from tests.llm.conftest import SF


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, c, v, e[::-1], q.T[::-1], deviation


def test_against_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r.vec_id: r.embedding for r in df.collect()}
    n, c, v, e, q, deviation = plain(list(data.values()))
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 * n
    row_of = {i: k for k, i in enumerate(data)}
    by = {(r.vec_id, r.component): r for r in rows}
    white = np.array([[by[i, k + 1].whitened for k in range(8)] for i in data])
    want = c @ q[:8].T / np.sqrt(e[:8])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9
    for r in rows:
        assert r.n == n and r.deviation == deviation[row_of[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)


@pytest.mark.parametrize(("n", "d", "rank"), [(50, 9, 9), (40, 7, 3), (30, 1, 1), (5, 12, 4)])
def test_factor_and_rotations(n, d, rank):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) * np.logspace(0, 5, d)
    a = x.T @ x
    l, order = whitening.pivoted_cholesky(a)
    assert np.allclose(l @ l.T, a[order][:, order], rtol=1e-9, atol=1e-9 * a.max())
    values, rows = whitening.components(a, n)
    # singular values of the data: the products' own eigenvalues would lose the small ones
    want = np.linalg.svd(x, compute_uv=False) ** 2 / n
    assert len(values) >= rank and np.allclose(values[:rank], want[:rank], rtol=1e-6)
    assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-9)


def test_hard_rows(spark):
    rows = [
        (1, [1.0, 2.0], 5, 0.5), (2, [2.0, 1.0], 5, 0.5), (2, [2.0, 1.0], 5, 0.5), (None, [0.5, 9.0], None, 0.1), (4, None, 1, 1.0),
        (5, [1.0, None], 1, 1.0), (6, [float("nan"), 1.0], 1, 1.0), (7, [float("inf"), 1.0], 1, 1.0), (8, [], 1, 1.0),
        (9, [1.0, 2.0, 3.0], 1, 1.0), (10, [3.0, 2.0, 3.5], 1, 1.0), (11, [1e300, 1.0], 1, 1.0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whiten(df).collect()
    count = lambda i: sum(r.vec_id == i for r in got)
    assert [count(i) for i in (1, 2, None, 4, 5, 6, 7, 8, 11)] == [2, 4, 2, 0, 0, 0, 0, 0, 0]
    # two vectors lie on a line: one component
    assert count(9) == count(10) == 1 and {r.n for r in got if r.vec_id in (9, 10)} == {2}
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert whitening.whiten(alike).count() == 0


def test_deviation_beyond_64_bits():
    x = np.array([[2**50, 0], [0, 1]], dtype=np.int64)
    sums = [2**50, 1]
    assert whitening._deviations(x, 2, sums) == [None, None]
    small = np.array([[3, 5], [7, 1]], dtype=np.int64)
    assert whitening._deviations(small, 2, [10, 6]) == [(6 - 10) ** 2 + (10 - 6) ** 2, (14 - 10) ** 2 + (2 - 6) ** 2]
