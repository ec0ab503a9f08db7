"""Ordered sweeps over trees against plain walks from node to node."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import tree

SCHEMA = "packet_id bigint, node string, parent string, pos bigint, path array<string>, order_path array<bigint>, setting string, own_name string, type string, titled boolean, open boolean, leaf boolean, dir string, source string"


def grown(rng, packet, size, deep):
    """Rows of a random tree of a packet; ``deep`` prefers young parents."""
    paths, orders, rows, children = {}, {}, {}, {}
    for k in range(size):
        node = f"n{rng.randrange(10**9)}x{k}"
        choice = [p for p in paths if len(paths[p]) < 64]
        parent = None if not paths or rng.random() < 0.02 else (choice[-1] if deep and rng.random() < deep else rng.choice(choice))
        pos = children[parent] = children.get(parent, 0) + rng.randrange(1, 3)
        paths[node] = [*paths.get(parent, []), node]
        orders[node] = [*orders.get(parent, []), pos]
        maybe = lambda values, share=0.4: rng.choice(values) if rng.random() < share else None
        rows[node] = [packet, node, parent, pos, paths[node], orders[node], maybe("st"), maybe("pqr"), maybe(["text", "choice"]), rng.random() < 0.3, rng.random() < 0.6, False, maybe(["a", "/b", "..", "./c"]), maybe(["f.pdf", "/g.pdf", "../h.pdf"])]
    for node in rows:
        rows[node][11] = node not in children
    return rows


def plain(rows):
    """All results by (packet, node) for the rows of one packet."""
    up = lambda n: [] if rows[n][2] is None else [*up(rows[n][2]), rows[n][2]]
    found = {}
    below = {n: [] for n in rows}
    for n in rows:
        for a in up(n):
            below[a].append(n)
    titled = sorted((n for n in rows if rows[n][9]), key=lambda n: rows[n][5])
    for n, r in rows.items():
        line = up(n)
        nearest = lambda k, own=True: next((rows[a][k] for a in reversed([*line, n] if own else line) if rows[a][k] is not None), None)
        visible = sum(all(rows[x][10] for x in up(m)[len(line) + 1:]) for m in below[n])
        leaves = 1 if r[11] else sum(rows[m][11] for m in below[n])
        above = [a for a in line if rows[a][9]]
        found[n] = {
            "inherited": (nearest(6), nearest(7)), "strict": nearest(6, False), "counts": (leaves, visible if r[10] else -visible),
            "section": (titled.index(n) + 1, above[-1] if above else None, len(above)) if r[9] else None,
            "name": (".".join(rows[a][7] for a in [*line, n] if rows[a][7] is not None), nearest(8)) if not below[n] else None,
            "dirs": [rows[a][12] for a in line if rows[a][12] is not None],
        }
    return found


def cleaned(dirs, source):
    import posixpath

    whole = "/w"
    for step in [*dirs, source]:
        whole = step if step.startswith("/") else f"{whole}/{step}"
    return posixpath.normpath(whole)


@pytest.mark.parametrize("limit", ["100000", "3"])
def test_sweeps_equal_walks(spark, limit):
    rng = random.Random(5)
    packets = {p: grown(rng, p, rng.choice([1, 2, 7, 40]), 0.8 * (p % 2)) for p in range(25)} | {99: grown(rng, 99, 400, 0.97)}
    nodes = spark.createDataFrame([r for rows in packets.values() for r in rows.values()], SCHEMA).repartition(4)
    want = {(p, n): v for p, rows in packets.items() for n, v in plain(rows).items()}
    assert max(len(r[4]) for rows in packets.values() for r in rows.values()) == 64
    spark.conf.set("spark.quire.groupLimit", limit)
    try:
        got = {(r.packet_id, r.node): (r.setting_inherited, r.own_name_inherited) for r in tree.inherit_nearest(nodes, ["setting", "own_name"]).collect()}
        assert got == {k: v["inherited"] for k, v in want.items()}
        got = {(r.packet_id, r.node): (r.leaves, r.visible) for r in tree.subtree_counts(nodes).collect()}
        assert got == {k: v["counts"] for k, v in want.items()}
        got = {(r.packet_id, r.node): (r.section_index, r.parent_section, r.depth) for r in tree.sections(nodes).collect()}
        assert got == {k: v["section"] for k, v in want.items() if v["section"]}
        got = {(r.packet_id, r.node): (r.full_name, r.type) for r in tree.qualified_names(nodes).collect()}
        assert got == {k: v["name"] for k, v in want.items() if v["name"]}
        got = {(r.packet_id, r.node): r.resolved for r in tree.scope_paths(nodes, F.lit("/w")).collect()}
        assert got == {(p, n): cleaned(want[p, n]["dirs"], r[13]) for p, rows in packets.items() for n, r in rows.items() if r[13]}
    finally:
        spark.conf.unset("spark.quire.groupLimit")


def test_missing_ancestors_give_nothing(spark):
    rows = [(1, "a", None, 1, ["a"], [1], "s"), (1, "c", "b", 1, ["a", "b", "c"], [1, 2, 1], None), (1, "d", None, 2, ["d"], [2], None), (1, "f", "e", 1, ["d", "e", "f"], [2, 1, 1], None)]
    nodes = spark.createDataFrame(rows, "packet_id bigint, node string, parent string, pos bigint, path array<string>, order_path array<bigint>, setting string")
    assert {r.node: r.setting_inherited for r in tree.inherit_nearest(nodes, ["setting"]).collect()} == {"a": "s", "c": "s", "d": None, "f": None}
    assert tree.inherit_nearest(nodes.limit(0), ["setting"]).collect() == []


def test_no_join_and_one_reading(spark):
    nodes = spark.createDataFrame([(1, "a", None, 1, ["a"], [1], "s")], "packet_id bigint, node string, parent string, pos bigint, path array<string>, order_path array<bigint>, setting string")
    plan = tree.inherit_nearest(nodes, ["setting"], split=False, levels=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def test_large_packet_over_many_chunks(spark):
    """A packet of 300,000 nodes (groups of 1,000 leaves below 300 titled groups) in chunks of 5,000."""
    ids = spark.range(300_300).selectExpr("id", "id div 1001 AS g", "id % 1001 AS k")
    node, group = F.concat(F.lit("x"), F.col("id").cast("string")), F.concat(F.lit("x"), (F.col("g") * 1001).cast("string"))
    nodes = ids.select(
        F.lit(7).cast("bigint").alias("packet_id"), node.alias("node"), F.when(F.col("k") > 0, group).alias("parent"), F.col("k").alias("pos"),
        F.when(F.col("k") > 0, F.array(group, node)).otherwise(F.array(node)).alias("path"), F.when(F.col("k") > 0, F.array("g", "k")).otherwise(F.array("g")).alias("order_path"),
        F.when(F.col("k") == 0, F.col("g")).alias("setting"), (F.col("k") == 0).alias("titled"), F.lit("o").alias("own_name"), (F.col("g") % 2 == 0).alias("open"), (F.col("k") > 0).alias("leaf"))
    spark.conf.set("spark.quire.groupLimit", "5000")
    try:
        wrong = tree.inherit_nearest(nodes, ["setting"]).where("setting_inherited <> cast(path[0] is not null as int) * (cast(substring(path[0], 2) as bigint) div 1001)").count()
        counts = tree.subtree_counts(nodes).groupBy("leaves", "visible").count().collect()
    finally:
        spark.conf.unset("spark.quire.groupLimit")
    assert wrong == 0
    assert sorted(tuple(r) for r in counts) == [(1, 0, 300_000), (1000, -1000, 150), (1000, 1000, 150)]
