import numpy as np
from pyspark.sql import functions as F

from quire.llm.common import components, in_blocks, spanning, union_find


def test_components_of_chains_stars_and_repeats(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(300, 420, (60, 2))] + [(7, 7), (200, 7), (200, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = sorted({x for p in pairs for x in p if p[0] != p[1]})
    at = {x: k for k, x in enumerate(ids)}
    roots = union_find(len(ids), np.array([(at[a], at[b]) for a, b in pairs if a != b]))
    assert found == {x: ids[roots[at[x]]] for x in ids}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_blocks_let_every_pair_meet_once_and_stay_small(spark):
    rows = [(1, k) for k in range(100)] + [(2, 500), (2, 501), (3, 600)]
    dealt = in_blocks(spark.createDataFrame(rows, "key long, id long"), ["key"], "id", limit=10)
    assert dealt.where("key = 3").count() == 0  # nobody to meet
    assert dealt.groupBy("key", "_i", "_j").count().agg(F.max("count")).first()[0] < 60
    other = dealt.select("key", "_i", "_j", F.col("id").alias("id2"), F.col("_own").alias("_own2"))
    met = dealt.join(other, ["key", "_i", "_j"]).where("id < id2 AND (_i = _j OR _own <> _own2)")
    assert met.count() == met.select("key", "id", "id2").distinct().count() == 100 * 99 // 2 + 1


def test_spanning_forest_prefers_near_pairs():
    pairs = np.array([(0, 1), (1, 2), (0, 2), (3, 4)])
    assert sorted(spanning(5, pairs, np.array([5, 1, 2, 9])).tolist()) == [1, 2, 3]
    assert len(spanning(3, np.zeros((0, 2), int), np.zeros(0, int))) == 0
