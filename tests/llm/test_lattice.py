import numpy as np

from quire.llm import lattice
from quire.llm.common import union_find


def planted(seed=1, singles=300, hot=700):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(singles, 64))
    near = x[:200] + rng.normal(size=(200, 64)) * np.linalg.norm(x[:200], axis=1, keepdims=True) / 8 * rng.uniform(0.02, 0.16, (200, 1))
    centre = rng.normal(size=64)
    group = centre + rng.normal(size=(hot, 64)) * 0.07
    return np.concatenate([x, near, group])


def truth(vectors, labels):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    return link, union_find(len(u), np.stack([a, b], axis=1))


def test_nearest_points_against_a_search_of_neighbours():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(200, 8)) * 2
    point, other = lattice.nearest_e8(y)
    for p in (point, other):
        doubled = (2 * p).astype(int)
        assert (doubled % 2 == doubled[:, :1] % 2).all() and (p.sum(axis=1) % 2 == 0).all()
    steps = rng.integers(-1, 2, (4000, 8)) * rng.choice([0.5, 1.0], (4000, 1))
    for k in range(20):
        near = point[k] + steps
        d = (2 * near).astype(int)
        near = near[(d % 2 == d[:, :1] % 2).all(axis=1) & (near.sum(axis=1) % 2 == 0)]
        assert (((near - y[k]) ** 2).sum(axis=1) >= ((point[k] - y[k]) ** 2).sum() - 1e-9).all()


def test_recall_counts_and_components(spark):
    vectors = planted()
    labels = np.where(np.arange(len(vectors)) % 7 == 0, 1, 0)
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(vectors, labels, strict=True))]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().sort_values("vec_id")
    link, root = truth(vectors, labels)
    n = found["n_links"].to_numpy()
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum()
    assert (found["component_id"].to_numpy() == root).mean() > 0.99
    assert (found["kept"] == (found["component_id"] == found["vec_id"])).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (1, [1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(frame).collect())
    expected = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)] + [(k, 0, k, True) for k in range(4, 13)]
    assert found == expected
    assert lattice.near_vectors(frame.limit(0)).collect() == []
