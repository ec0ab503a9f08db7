"""Cases of the fourth round of findings: the trace of large tables filled the disk."""

import random

import oracle
from pyspark.sql import functions as F

from quire.operators import layout, ranges
from quire.plans import load_queries
from quire.plans.registry import ORACLES, QUERIES

load_queries()


def exchanges(frame):
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_sweep_over_sections_joins_nothing_to_the_points(spark):
    """Points keep all their columns, also without a place; a group without a key has no spans."""
    points = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, None, "c"), (None, 2, "d"), (2, 9, "e")], "g long, p long, name string")
    spans = spark.createDataFrame([(1, 1, 3, 0, "x"), (None, 1, 3, 0, "y")], "g long, a long, b long, depth int, section string")
    for split in (False, True):
        found = ranges.innermost_at(points, spans, ["g"], "p", "a", "b", "depth", ["section"], 1, split)
        assert split or "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.columns == ["g", "p", "name", "section"]
        assert {r.name: r.section for r in found.collect()} == {"a": "x", "b": "x", "c": None, "d": None, "e": None}


def test_spans_and_sizes_meet_by_blocks(spark):
    """Sources of many blocks with holes between their runs, and spans without a source."""
    rng, runs, sizes = random.Random(4), [], {}
    for path in ("a", "b"):
        page = 1 + rng.randrange(3)
        while page < 1500:
            last = page + rng.choice([0, 2, 40, 300])
            runs.append((path, page, last, float(len(runs)), 1.0))
            sizes |= {(path, p): float(len(runs) - 1) for p in range(page, last + 1)}
            page = last + 1 + rng.choice([0, 0, 5, 600])
    spans = [(n, rng.choice(["a", "b", "unknown"]), first := rng.randrange(1, 2000), 10 * n + 1, 10 * n + 1 + rng.choice([0, 3, 255, 256, 900])) for n in range(60)]
    spans += [(60, None, None, 5, 25_007), (61, "a", None, 7, 9), (62, None, 4, 7, 9)]
    expected = sorted((n, p, s + p - a if s else -1, sizes.get((path, s + p - a), -1.0) if s else -1.0) for n, path, s, a, b in spans for p in range(a, b + 1))
    frames = spark.createDataFrame(spans, "pos long, path string, _src long, _first long, _last long"), spark.createDataFrame(runs, "path string, first long, last long, width double, height double")
    for tasks in (None, 13):
        cut = layout._cut_by_size(*frames, tasks)
        assert cut.select(F.max(F.col("_last") - F.col("_first"))).first()[0] < ranges.EXPAND_CHUNK
        pages = cut.select("pos", F.explode(F.sequence("_first", "_last")).alias("page"), "_src", "_first", "_run_width")
        found = pages.select("pos", "page", F.coalesce(F.col("_src") + F.col("page") - F.col("_first"), F.lit(-1)), F.coalesce("_run_width", F.lit(-1.0)))
        assert sorted(tuple(r) for r in found.collect()) == expected
        assert not tasks or any(", 13)" in line and "_of" in line for line in exchanges(cut))


def test_trace_shuffles_parts_and_no_cut_spans(spark):
    """Parts are sent to their sources and pages come back summed up; nothing else after the items are dealt."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    spark.conf.set("spark.quire.taskRows", "100")
    try:
        found = QUERIES["page_trace"](spark, "/root/testdata/sf0.001")
        plan = exchanges(found)
        assert not [line for line in plan if "REPARTITION_BY_COL" in line or "first_page" in line]
        assert sum("path" in line for line in plan) == 3 and sum("packet_id" in line and "path" not in line for line in plan) == 1
        assert sum(f", {-(-lines // 100)})" in line and "path" in line for line in plan) == 2
        problems, rows = oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", QUERIES["page_trace"], ORACLES["page_trace"])
    finally:
        spark.conf.unset("spark.quire.taskRows")
    assert not problems and rows
