import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import mtree


def brute(ids, vectors, queries, k):
    out = []
    for q in queries:
        order = sorted(((-int(sum(int(a) * int(b) for a, b in zip(vectors[q], v, strict=True))), i) for i, v in zip(ids, vectors, strict=True) if i != ids[q]))[:k]
        out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return out


@pytest.mark.parametrize("spread", [1, 40])
def test_search_is_exact_with_ties(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (20, 6))
    vectors = centres[rng.integers(0, 20, 700)] + rng.integers(-1, 2, (700, 6))
    ids = rng.permutation(700)
    root = mtree.build(ids, vectors)
    for q in range(0, 700, 37):
        found = sorted(mtree.search(root, vectors[q], int(ids[q]), 20, True), key=lambda x: (-x[0], x[1]))
        assert [(s, i) for s, i in found] == [(s, i) for _, _, i, s in brute(ids.tolist(), vectors.tolist(), [q], 20)]


def test_radii_cover_and_distances_are_those_of_the_parent():
    rng = np.random.default_rng(9)
    root = mtree.build(np.arange(3000), rng.integers(-64, 65, (3000, 16)))

    def below(node):
        return node.vectors if node.children is None else np.concatenate([below(c) for c in node.children])

    def visit(node):
        assert (mtree._distances(below(node), node.pivot) <= node.radius + 1e-9).all()
        assert np.allclose(mtree._distances(node.vectors, node.pivot), node.distances)
        for c in node.children or []:
            visit(c)

    visit(root)


def test_pruning_avoids_computations():
    rng = np.random.default_rng(10)
    vectors = np.concatenate([rng.integers(-3, 4, (500, 8)) + c for c in rng.integers(-500, 500, (20, 8))])
    root = mtree.build(np.arange(len(vectors)), vectors)
    counted = []
    real = mtree._products
    try:
        mtree._products = lambda v, q, e: (counted.append(len(v)), real(v, q, e))[1]
        mtree.search(root, vectors[0], 0, 20, True)
    finally:
        mtree._products = real
    assert sum(counted) < len(vectors) / 2


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, -0.01]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (20, [0.0, 0.0]), (40, [1.0]), (60, [2.0**45, 2.0**46]), (None, [1.0, 1.0]), (1, [1.0, 0.5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = [tuple(r) for r in mtree.top_k(frame, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    sound = [(i, [int(np.floor(64 * v)) for v in x]) for i, x in rows if i in (0, 1, 2, 20, 60) and x and len(x) == 2]
    expected = []
    for q, x in sound:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in sound if i != q)[:3]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [f for f in found if f[0] != 60 and f[2] != 60] == [e for e in expected if e[0] != 60 and e[2] != 60]
    assert not any(q == 40 for q, *_ in found)
    assert mtree.top_k(frame.limit(0), F.lit(True)).collect() == []


def test_rows_that_share_an_id_find_each_other(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0]), (40, [-1.0, 0.0]), (3, [0.25, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in mtree.top_k(frame, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank", "vec_id").collect()]
    twin = [(20, 1, 20, 4096), (20, 2, 3, 2048), (20, 3, 3, 1024)]
    assert found == sorted(twin + twin) + [(40, 1, 3, -1024), (40, 2, 3, -2048), (40, 3, 20, -4096)]


@pytest.mark.parametrize(("spread", "copies", "kind"), [(2, 40, np.float32), (40, 1, np.float64)])
def test_blocks_of_queries_find_what_single_ones_do(spread, copies, kind):
    rng = np.random.default_rng(spread)
    vectors = np.repeat(rng.integers(-spread, spread + 1, (1200 // copies, 6)), copies, axis=0)
    vectors = vectors[rng.permutation(1200)]
    ids, rows = rng.permutation(1200) // 2, np.arange(1200)  # two rows share an id
    trees = [mtree.build(ids[t::3], vectors[t::3], rows[t::3]) for t in range(3)]
    asked = np.arange(0, 1200, 7)
    best = mtree.Best(len(asked), 20)
    for root in trees:
        mtree.search_block(root, vectors[asked].astype(kind), rows[asked], best)
    for n, q in enumerate(asked):
        expected = sorted((-int(s), int(i)) for s, i, row in zip(vectors @ vectors[q], ids, rows, strict=True) if row != q)[:20]
        assert [(-int(s), int(i)) for s, i in zip(best.scores[n], best.ids[n], strict=True)] == expected


def test_neither_queries_nor_trees_are_copied_or_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_VECTORS", 16)
    monkeypatch.setattr(mtree, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(3)
    vectors = [rng.integers(-4, 5, 3 + i % 2).tolist() for i in range(300)]
    vectors[40] = [2.0**30, 2.0**25, -1.0]  # too large for real numbers
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = mtree.top_k(frame, F.col("vec_id") % 20 == 0, k=5, scale=1.0)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    expected = []
    for q in range(0, 300, 20):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], v, strict=True)), i) for i, v in enumerate(vectors) if i != q and len(v) == len(vectors[q]))
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == expected
