"""Literal layout cases, the pinned workload shapes, and random packets against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, ranges

EVENTS = (
    "packet_id bigint, pos bigint, ref string, kind string, pages bigint, odd boolean, enabled boolean, mode string, start bigint, "
    "width double, height double, first_w double, first_h double, last_w double, last_h double, section_path array<string>, ranges array<struct<first:bigint,last:bigint>>"
)
BLANK = dict(odd=False, enabled=True, mode=None, start=None, width=None, height=None, first_w=None, first_h=None, last_w=None, last_h=None, section_path=[], ranges=None, kind="page", pages=1)


def events(spark, rows, packet=1):
    names = [f.split(" ")[0] for f in EVENTS.split(", ")]
    full = [{**BLANK, "packet_id": packet, "pos": i + 1, "ref": f"i{i + 1}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], EVENTS)


def placed(frame, split=False):
    padded = layout.pad_odd_starts(frame, keep=("mode", "start"), split=split)
    parts = layout.place_parts(padded, split)
    return parts.withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def rows(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.orderBy("packet_id", "pos", "band").collect()]


def test_a_blank_goes_before_an_odd_start_only_on_an_odd_count(spark):
    parts = placed(events(spark, [dict(kind="source", pages=3), dict(odd=True, pages=2), dict(odd=True, pages=1), dict(pages=1)]))
    assert rows(parts, "kind", "first_page", "last_page") == [
        ("source", 1, 3), ("padding", 4, 4), ("page", 5, 6), ("page", 7, 7), ("page", 8, 8)]


def test_nested_odd_starts_share_one_blank(spark):
    group = dict(kind="group", pages=0, odd=True)
    parts = placed(events(spark, [dict(pages=1), group, group, dict(pages=1)]))
    assert [r[0] for r in rows(parts, "kind")] == ["page", "padding", "group", "group", "page"]
    assert rows(parts, "first_page")[-1] == (3,)


def test_a_child_blank_belongs_to_the_parent_section(spark):
    # cover, parent section opened at page 2 with an aligned child: the blank is page 2
    frame = events(spark, [dict(kind="source", pages=1), dict(kind="group", pages=0, section_path=["p"]), dict(odd=True, pages=1, section_path=["p", "c"])])
    parts = layout.place_parts(layout.pad_odd_starts(frame, split=False), False)
    parts = parts.withColumn("section_path", F.when(F.col("kind") == "padding", F.array(F.lit("p"))).otherwise(F.col("section_path")))
    sections = spark.createDataFrame([(1, "p"), (1, "c")], "packet_id bigint, section string")
    spans = {r.section: (r.first_page, r.last_page, r.target) for r in layout.section_spans(sections, parts).collect()}
    assert spans == {"p": (2, 3, 3), "c": (3, 3, 3)}


def test_sizes_come_from_the_nearest_source_and_blanks_from_the_sheet_below(spark):
    source = lambda w: dict(kind="source", first_w=w, first_h=w, last_w=w + 1, last_h=w + 1)
    frame = events(spark, [dict(), source(100.0), dict(width=50.0, height=60.0), dict(odd=True), dict()])
    sized, findings = layout.inherit_sizes(layout.pad_odd_starts(frame, split=False), split=False)
    assert rows(sized, "kind", "size_w") == [("page", 100.0), ("source", 101.0), ("page", 50.0), ("padding", 50.0), ("page", 101.0), ("page", 101.0)]
    assert findings.count() == 0


def test_a_fitted_packet_uses_the_target_for_generated_pages(spark):
    frame = events(spark, [dict(kind="source", first_w=90.0, first_h=100.0, last_w=90.0, last_h=100.0), dict(odd=True)])
    sized, _ = layout.inherit_sizes(layout.pad_odd_starts(frame, split=False), fit=(200.0, 300.0, 0.01), split=False)
    assert rows(sized, "kind", "output_w") == [("source", 200.0), ("padding", 200.0), ("page", 200.0)]


def test_size_findings(spark):
    frame = events(spark, [dict(), dict(width=0.5, height=10.0), dict(width=14401.0, height=10.0)])
    _, findings = layout.inherit_sizes(frame.withColumn("band", F.lit(1)), split=False)
    assert [(r.pos, r.code) for r in findings.orderBy("pos").collect()] == [(1, "page_size_required"), (2, "plan_value"), (3, "page_size_too_large")]


@pytest.mark.parametrize("mode, labels", [("physical", [9, 11, None, 15]), ("consecutive", [9, 11, None, 13])])
def test_labels_from_nine(spark, mode, labels):
    policy = dict(mode=mode, start=9)
    frame = events(spark, [dict(kind="source", pages=2, **policy), dict(pages=2, **policy), dict(pages=2, enabled=False, **policy), dict(**policy)])
    parts = placed(frame)
    assert [r[0] for r in rows(layout.label_pages(parts, split=False), "label_start")] == labels
    none = layout.label_pages(parts, F.array().cast("array<string>"), False)
    assert [r[0] for r in rows(none, "label_start")] == [None] * 4
    spans = layout.label_spans(layout.label_pages(parts, split=False), False).orderBy("first_page").collect()
    assert [(s.first_page, s.last_page, s.label_start) for s in spans] == [(1, 4, 9), (5, 6, None), (7, 7, labels[3])]


def test_label_overflow_at_the_largest_index(spark):
    top = 9_223_372_036_854_775_807
    frame = events(spark, [dict(pages=3, mode="physical", start=top - 1)])
    found = layout.label_overflow(placed(frame), split=False).collect()
    assert [(r.page, r.largest_start) for r in found] == [(3, top - 2)]


def test_selected_ranges_map_to_output(spark):
    pairs = lambda *ps: [dict(first=a, last=b) for a, b in ps]
    frame = events(spark, [dict(kind="divider"), dict(kind="source", pages=4, ranges=pairs((2, 4), (7, 7)))])
    parts = placed(frame)
    spans = ranges.span_map(parts.filter("kind = 'source'"), ["packet_id", "pos"]).orderBy("out_first").collect()
    assert [(s.src_first, s.src_last, s.out_first) for s in spans] == [(2, 4, 2), (7, 7, 5)]
    labelled = layout.label_pages(parts, split=False)
    pages = layout.page_map(labelled.select("packet_id", "pos", "band", "kind", "pages", "ranges", "first_page", "last_page", "label_start"))
    assert [(r.output_page, r.source_page, r.label) for r in pages.orderBy("output_page").collect()] == [
        (1, None, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 7, "5")]


def test_pinned_shapes(spark):
    mixed = events(spark, [dict(kind="source", pages=2) if i % 2 == 0 else dict() for i in range(4000)], 1)
    single = events(spark, [dict(pages=100_000)], 2)
    many = events(spark, [dict(kind="source") for _ in range(500)], 3)
    # contents of 16 pages, then 500 odd-start sections of a divider and a page
    book = [dict(kind="contents", pages=16)]
    for i in range(500):
        book += [dict(kind="divider", odd=True, section_path=[f"s{i}"]), dict(section_path=[f"s{i}"])]
    sections = spark.createDataFrame([(4, f"s{i}") for i in range(500)], "packet_id bigint, section string")
    parts = placed(mixed.union(single).union(many).union(events(spark, book, 4)))
    totals = {r.packet_id: (r.total_pages, r.n) for r in layout.page_totals(parts).join(parts.groupBy("packet_id").agg(F.count("*").alias("n")), "packet_id").collect()}
    assert totals == {1: (6000, 4000), 2: (100_000, 1), 3: (500, 500), 4: (1016, 1001)}
    targets = {r.section: r.target for r in layout.section_spans(sections, parts.filter("packet_id = 4")).collect()}
    assert targets == {f"s{n}": 17 + 2 * n for n in range(500)}
    pages = layout.page_map(layout.label_pages(parts, split=False).select("packet_id", "pos", "band", "kind", "pages", "ranges", "first_page", "last_page", "label_start"))
    assert {r.packet_id: r["count"] for r in pages.groupBy("packet_id").count().collect()} == {1: 6000, 2: 100_000, 3: 500, 4: 1016}


def test_refreshed_source_moves_padding_and_target(spark):
    # a source of 2, 3 and 4 pages before an odd divider and a closing page
    for pages, total, blank in ((2, 4, None), (3, 6, 4), (4, 6, None)):
        parts = placed(events(spark, [dict(kind="source", pages=pages), dict(odd=True, kind="divider"), dict()]))
        got = rows(parts, "kind", "first_page", "last_page")
        assert got[-1][2] == total
        assert [r[1] for r in got if r[0] == "padding"] == ([blank] if blank else [])


def fold(items):
    """The sequential reading: one item after the other."""
    count, numbered, out = 0, 0, []
    for item in items:
        if item["odd"] and count % 2:
            count += 1
            out.append(("padding", count, count, None))
        first, count = count + 1, count + item["pages"]
        label = None
        if item["mode"] is None:
            label = first
        elif item["enabled"]:
            label = item["start"] + (first - 1 if item["mode"] == "physical" else numbered)
            numbered += item["pages"]
        out.append((item["kind"], first, count, label))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_random_packets_against_a_fold(spark, split):
    dice = random.Random(7)
    frame, wanted = None, []
    for packet in range(40):
        mode, start = dice.choice([None, "physical", "consecutive"]), dice.randint(1, 9)
        items = [dict(kind=dice.choice(["source", "page"]), pages=dice.randint(1, 4), odd=dice.random() < 0.5, enabled=dice.random() < 0.7, mode=mode, start=start)
                 for _ in range(dice.randint(1, 30))]
        wanted += [(packet, *row) for row in fold(items)]
        one = events(spark, items, packet)
        frame = one if frame is None else frame.union(one)
    spark.conf.set("spark.quire.groupLimit", "4")
    try:
        labelled = layout.label_pages(placed(frame.coalesce(4), split), split=split)
        # without a policy a blank has its page number as well
        got = rows(labelled.withColumn("label", F.when(F.col("kind") != "padding", F.col("label_start"))), "packet_id", "kind", "first_page", "last_page", "label")
    finally:
        spark.conf.unset("spark.quire.groupLimit")
    assert got == wanted


@pytest.mark.parametrize("limit", ["1000", "3"])
def test_random_pagination_by_fold_and_by_doubling(spark, limit):
    dice = random.Random(11)
    data, wanted = [], []
    for packet in range(5):
        page, used = 0, 0
        for pos in range(1, dice.randint(2, 30)):
            height = dice.randint(1, 40)
            if page == 0 or used + height > 50:
                page, used = page + 1, 0
            used += height + 6
            data.append((packet, pos, height))
            wanted.append((packet, pos, page))
    spark.conf.set("spark.quire.groupLimit", limit)
    try:
        frame = spark.createDataFrame(data, "packet_id bigint, pos bigint, height bigint")
        got, rejected = layout.paginate_rows(frame, 50, 6)
        assert sorted((r.packet_id, r.pos, r.page) for r in got.collect()) == wanted
        assert rejected.count() == 0
    finally:
        spark.conf.unset("spark.quire.groupLimit")


def test_page_runs_break_at_gaps_and_sizes(spark):
    data = [("a", 1, 10.0), ("a", 2, 10.0), ("a", 4, 10.0), ("a", 5, 10.001)]
    frame = spark.createDataFrame(data, "path string, page bigint, source_w double").withColumns(
        {"source_h": F.lit(1.0), "output_w": F.lit(1.0), "output_h": F.lit(1.0)})
    runs = ranges.page_runs(frame, ["path"], False).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in runs] == [(1, 2), (4, 4), (5, 5)]
