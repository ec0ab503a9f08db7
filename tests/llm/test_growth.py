"""Chance must not make more candidates than the rows call for."""

import numpy as np
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import sifted


def rows_that_meet(n, least):
    fps = np.random.default_rng(n).integers(0, 256, (n, 64), dtype=np.uint8)
    keys = simhash.ring_keys(fps, 512, 21, 1, False, 5, least)
    _, counts = np.unique(keys, return_counts=True)
    assert keys.shape == (n, 105)
    return counts[counts > 1].sum()


def test_rows_meet_by_chance_in_proportion_to_their_number():
    few, many = (rows_that_meet(n, simhash.key_bits(n)) for n in (10_000, 40_000))
    assert many < 40_000 * 105 / 2**simhash.SPARE * 1.2 and many < 8 * max(few, 100)
    assert rows_that_meet(40_000, 0) > 5 * many  # segments of 24 bits alone


def test_keys_without_a_least_width_are_as_before_and_equal_rows_meet():
    fps = np.random.default_rng(2).integers(0, 256, (50, 64), dtype=np.uint8)
    plain = simhash.ring_keys(fps, 512, 21, 1, False, 5)
    assert np.array_equal(plain, simhash.ring_keys(fps, 512, 21, 1, False, 5, 20))
    assert not (plain == simhash.ring_keys(fps, 512, 21, 1, False, 5, 40)).any()
    assert np.array_equal(simhash.ring_keys(fps, 512, 21, 1, False, 5, 600), simhash.ring_keys(fps.copy(), 512, 21, 1, False, 5, 512))


def test_maps_bound_the_difference_at_any_length():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 3, 2048, 2049, 5000, 9000)]
    sets += [np.unique(np.concatenate([sets[4][100:], sets[3][: 3 * k]])) for k in range(1, 40)]
    maps = [simhash.parity_map(s) for s in sets]
    assert [len(m) * 8 for m in maps[:6]] == [2048, 2048, 2048, 4096, 8192, 16384]
    a, b = np.triu_indices(len(sets), 1)
    far = simhash.map_distances(maps, a, b, at_once=300)
    exact = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    assert (far <= exact).all() and far[(a == 4) & (b == 5)] > 1500


def test_long_sets_that_share_a_rare_member_only_are_no_candidates(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 6000
    for k in range(12):
        members = rng.integers(0, 2**62, n, dtype=np.uint64)
        members[:3] = [1, 2, 3]
        rows.append((k, k, members))
    near = rows[5][2].copy()
    near[-300:] = rng.integers(0, 2**62, 300, dtype=np.uint64)
    rows.append((12, 12, near))
    made = [(i, c, n, [int(x) for x in m[: simhash.prefix_size(n, 0.8)]], bytearray(simhash.parity_map(np.unique(m)))) for i, c, m in rows]
    sets = spark.createDataFrame(made, "id long, component long, n int, prefix array<bigint>, map binary")
    assert [tuple(r) for r in simhash.crossing(sets, 0.8).collect()] == [(5, 12)]


def test_sifted_rows_hold_all_that_are_wanted(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x"), (-7, "x")], "doc_id long, text string"))
    wanted = spark.createDataFrame([(7,), (-7,), (4999,), (99_999,), (None,)], "id long")
    for bits in (64, 1 << 24):
        got = sifted(rows, "doc_id", wanted, bits)
        assert got.columns == rows.columns and got.count() == got.distinct().count()
        assert {7, -7, 4999} <= {r["doc_id"] for r in got.collect()}
    assert {r["doc_id"] for r in got.collect()} == {7, -7, 4999}
    assert sifted(rows, "doc_id", wanted.where("id IS NULL")).count() == 0
