"""Reachability in few rounds, per packet, and innermost spans and sizes of pages, against plain loops."""

import random

from pyspark.sql import functions as F

from quire.operators import layout, ranges, tree


def walked(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        node = todo.pop()
        for a, b in edges:
            if a == node and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_random_graphs_per_packet(spark):
    rng = random.Random(3)
    nodes, edges, roots, want = [], [], [], {}
    for packet in range(40):
        n = rng.randrange(1, 30)
        mine = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.5, 1, 1.5, 3])))]
        mine += [(k, k + 1) for k in range(rng.randrange(n)) if rng.random() < 0.9] if packet % 3 == 0 else []
        start = rng.sample(range(n), rng.randrange(0, min(n, 3) + 1))
        nodes += [(packet, k) for k in range(n)]
        edges += [(packet, a, b) for a, b in mine] + [(packet, 0, 1000), (packet, None, 0)]
        roots += [(packet, k) for k in start] + [(packet, 999)]
        want |= {(packet, k): k in walked(mine, start) for k in range(n)}
    found = tree.reach(spark.createDataFrame(nodes, "packet_id long, node long"), spark.createDataFrame(edges, "packet_id long, src long, dst long"), spark.createDataFrame(roots, "packet_id long, node long"), ("packet_id",))
    got = [((r.packet_id, r.node), True) for r in found.reached.collect()] + [((r.packet_id, r.node), False) for r in found.unreachable.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    written = []
    durable = tree.durable
    monkeypatch.setattr(tree, "durable", lambda frame: written.append(1) or durable(frame))
    nodes = spark.range(10_050).select(F.col("id").alias("node"))
    edges = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = tree.reach(nodes, edges, spark.range(1).select(F.col("id").alias("node")))
    assert found.reached.count() == 10_001 and found.unreachable.count() == 49
    assert len(written) < 26  # 14 doublings, and a few tables before and after


def test_ladders_and_cycles(spark):
    # two strands with crossings, from a cycle; and a strand that nothing leads to
    edges = [(0, 1), (1, 2), (2, 0)] + [(2, 10), (2, 11)] + [(k, k + d) for k in range(10, 60) for d in (2, 3 if k % 2 == 0 else 1)] + [(k, k + 1) for k in range(100, 140)]
    nodes = sorted({x for e in edges for x in e})
    found = tree.reach(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,)], "node long"))
    want = walked(edges, [1])
    assert {r.node for r in found.reached.collect()} == want and {r.node for r in found.unreachable.collect()} == set(nodes) - want


def test_aliases_are_known_by_packet(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "a", "x"), (2, "b", "b"), (2, "c", "a")], "packet_id long, name string, target string")
    found = lambda *standard: {(r.packet_id, r.name): (r.terminal, r.status) for r in tree.resolve_aliases(links, *standard).collect()}
    assert found() == {(1, "a"): ("c", "ok"), (1, "b"): ("c", "ok"), (2, "a"): ("x", "ok"), (2, "b"): (None, "cycle"), (2, "c"): ("x", "ok")}
    one = spark.createDataFrame([("c",)], "name string")
    assert found(one)[(1, "a")] == ("c", "ok") and found(one)[(2, "a")] == ("x", "not_standard")
    assert found(one.withColumn("packet_id", F.lit(2).cast("long")))[(1, "a")] == ("c", "not_standard")


def test_innermost_span(spark):
    rng, spans, points = random.Random(1), [], []
    for group in range(20):
        def cut(first, last, depth):
            while first <= last and depth < 4:
                start = first + rng.randrange(4)
                end = start + rng.randrange(12)
                if end > last:
                    break
                spans.append((group, start, end, depth, f"{depth}/{start}"))
                cut(start, end, depth + 1)
                first = end + 1
        cut(1, 40, 0)
        points += [(group, p) for p in range(0, 45)] + [(group, 7)]
    want = {(g, p): max(((d, n) for h, a, b, d, n in spans if h == g and a <= p <= b), default=(0, None))[1] for g, p in points}
    frames = spark.createDataFrame(points, "g long, p long"), spark.createDataFrame(spans, "g long, a long, b long, depth int, name string")
    for limit in ("100000", "3"):
        spark.conf.set("spark.quire.groupLimit", limit)
        try:
            rows = ranges.innermost_at(*frames, ["g"], "p", "a", "b", "depth", ["name"], 4).collect()
        finally:
            spark.conf.unset("spark.quire.groupLimit")
        assert len(rows) == len(points) and {(r.g, r.p): r.name for r in rows} == want


def test_page_trace_keeps_pages_without_size_or_section(spark):
    span = lambda a, b: (a, b)
    parts = [(1, 1, 1, "source", "s", 5, [span(2, 4), span(8, 9)], 1, 5, 1, 1, None, None), (1, 2, 0, "padding", None, 1, None, 6, 6, None, None, 1.0, 1.0),
             (1, 2, 1, "page", None, 2, None, 7, 8, 7, None, 3.0, 4.0), (1, 3, 1, "source", "unknown", 2, None, 9, 10, None, 1, None, None)]
    schema = "packet_id long, pos long, band int, kind string, path string, pages long, ranges array<struct<first:long,last:long>>, first_page long, last_page long, label_start long, occurrence long, width double, height double"
    runs = spark.createDataFrame([("s", 3, 3, 10.0, 11.0), ("s", 4, 8, 20.0, 21.0)], "path string, first long, last long, width double, height double")
    sections = spark.createDataFrame([(1, "outer", 0, 1, 8), (1, "inner", 1, 7, 8)], "packet_id long, section string, depth int, first_page long, last_page long")
    rows = layout.page_trace(spark.createDataFrame(parts, schema), runs, sections, 2).orderBy("output_page").collect()
    assert [(r.output_page, r.source_page, r.width, r.section, r.occurrence) for r in rows] == [
        (1, 2, None, "outer", 1), (2, 3, 10.0, "outer", 1), (3, 4, 20.0, "outer", 1), (4, 8, 20.0, "outer", 1), (5, 9, None, "outer", 1),
        (6, None, None, "outer", None), (7, None, 3.0, "inner", None), (8, None, 3.0, "inner", None), (9, 1, None, None, 1), (10, 2, None, None, 1)]
