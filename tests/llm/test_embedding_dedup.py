import numpy as np

from siteweave.llm import embedding_dedup
from tests.llm.test_components import plain


def clustered(seed: int, n: int = 900, dims: int = 16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for g, size in ((0, 200), (200, 40), (240, 3), (243, 2), (245, 2), (300, 2)):
        x[g : g + size] = x[g] + rng.normal(size=(size, dims)) * 0.12
    x[500:510] = x[500]  # equal vectors
    return x.astype(np.float32)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    x = clustered(1)
    order = np.random.default_rng(2).permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], 1) for i in order], "vec_id long, embedding array<float>, n int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum()
    want = plain(list(zip(*np.nonzero(near))))
    same = [got[i].component_id == want.get(i, i) for i in range(len(x))]
    assert np.mean(same) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_unusable_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 2.0, 3.0]), (9, [1.0, 2.0]), (None, v), (None, None), (10, [2.0, 4.0, 6.0]), (11, [3e38, 3e38, 0.0]), (12, [1e-40, 1e-40, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert by_id[1] == [(4, 1)] and by_id[2] == [(4, 1)] * 2 and by_id[10] == [(4, 1)]
    assert sorted(by_id[None], key=repr) == [(0, None), (4, 1)]
    assert all(by_id[i] == [(0, i)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert by_id[11] == [(1, 11)] and by_id[12] == [(1, 11)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_each_length_links_among_its_own(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.1]), (3, [1.0, 2.0]), (4, [1.0, 2.1]), (5, [-1.0, 2.0]), (6, [4.0]), (7, [9.0]), (8, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {
        1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False), 8: (0, 8, True),
    }


def test_multi_sequence_order():
    rng = np.random.default_rng(3)
    grid = embedding_dedup.Grid(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)))
    x = rng.normal(size=(30, 8))
    a, b = grid.halves(x)
    far = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    for n in (1, 4, 17, 35):
        assert (np.sort(np.take_along_axis(far, grid.visits(x, n), 1), axis=1) - np.sort(far, axis=1)[:, :n] < 1e-12).all()
    cell = rng.integers(0, 35, 30)
    assert (grid.rank(x, cell) == (far <= far[np.arange(30), cell][:, None] + 1e-12).sum(axis=1)).all()
    assert (grid.rank(x, grid.cells(x)) == 1).all()
