"""Value grammars and boundaries as literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions.rules import language_ok, parse_size, parse_tolerance, title_ok
from quire.operators import admission, findings, geometry, integrity, names, tree


def one(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", expression(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_sizes(spark):
    got = one(spark, ["A4", "Letter", "210x297mm", "1x2in", "inherit", ".5x1", "14400x1", "14401x1", "a4", "1X2", "-1x2", "10x"], parse_size)
    assert (got[0].width, got[0].height) == (595.2755905511812, 841.8897637795276)
    assert (got[1].width, got[1].height) == (612.0, 792.0)
    assert math.isclose(got[2].width, 595.2755905511812, rel_tol=1e-12)
    assert (got[3].width, got[3].height) == (72.0, 144.0)
    assert got[4].width is None and got[4].reject is None
    assert [g.reject for g in got[5:]] == ["size_range", None, "size_range", "size_grammar", "size_grammar", "size_grammar", "size_grammar"]


def test_tolerances(spark):
    assert one(spark, ["0", "-0", "1mm", "2.54cm", "1in", "-1", "14400.1", "x"], parse_tolerance) == [
        0.0, 0.0, 360 / 127, 72.0, 72.0, None, None, None]


def test_language_tags(spark):
    good = ["en", "de-1996", "zh-Hans-CN", "en-a-bbb-x-a-ccc", "x-whatever", "i-klingon", "sl-rozaj-biske", "de-CH-x-phonebk"]
    bad = ["", "a", "en-", "de-1996-1996", "en-a-bb-a-cc", "en-u", "toolonglanguage", "en_GB", "x", "Ka"]
    assert one(spark, good, language_ok) == [True] * len(good)
    assert one(spark, bad, language_ok) == [False] * len(bad)


def test_titles(spark):
    assert one(spark, ["Plan", " x ", "", "  ", "a\nb", "a\u200bb", "\u2028", "x" * 10001], title_ok) == [True, True] + [False] * 6


def test_fit_boundaries_are_inclusive_to_the_last_float(spark):
    low, high = 100 - 0.01, 100 + 0.01
    sides = [low, high, math.nextafter(low, 0), math.nextafter(high, 1e9)]
    frame = spark.createDataFrame([(s, 200.0) for s in sides] + [(200.0, 100.0)], "width double, height double")
    got = geometry.fit_decisions(frame, F.lit(100.0), F.lit(200.0), F.lit(0.01)).collect()
    assert [r.transform for r in got] == [False, False, True, True, True]


def test_effective_geometry_rejects_an_empty_intersection(spark):
    rows = [([0.0, 0.0, 10.0, 20.0], None, 90, 2.0), ([10.0, 20.0, 0.0, 0.0], [2.0, 2.0, 5.0, 6.0], 0, 1.0), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0], 0, 1.0)]
    frame = spark.createDataFrame(rows, "media array<double>, crop array<double>, rotate bigint, unit double")
    accepted, rejected = geometry.effective_geometry(frame)
    assert sorted((r.width, r.height) for r in accepted.collect()) == [(3.0, 4.0), (40.0, 20.0)]
    assert rejected.count() == 1


def test_problem_runs(spark):
    text = "ab\t\tc\x07d\u200be\u2028f\u05d0\u05d1g\r\nh\u0640" + "\tx" * 9
    frame = spark.createDataFrame([(1, text), (2, "plain text, café, Ж, α, €")], "id int, text string")
    got = admission.text_problem_runs(frame).orderBy("offset").collect()
    assert [(r.offset, r.run, r.reason) for r in got] == [
        (2, 2, "tab"), (5, 1, "control"), (7, 1, "format"), (9, 1, "separator"), (11, 2, "script"), (16, 1, "rtl"), *((17 + 2 * k, 1, "tab") for k in range(9))]
    assert {r.id for r in got} == {1}


def test_portable_keys(spark):
    keys = one(spark, ["A.pdf", "a.PDF", "É.pdf", "é.pdf", "a\u200b.pdf", "straße", "STRASSE"], names.portable_key)
    assert keys[0] == keys[1] == keys[4] and keys[2] == keys[3] and keys[5] == keys[6] and keys[0] != keys[2]


def test_clean_paths(spark):
    assert one(spark, ["a/./b//c", "a/../b", "../a", "/../a", "a/..", "/", "a/b/../../..", "x/link/../b"], tree.clean_path) == [
        "a/b/c", "b", "../a", "/a", ".", "/", "..", "x/b"]


def test_path_conflicts(spark):
    rows = [(1, "output", "X/a.pdf"), (2, "input", "x/A.pdf"), (3, "output", "o"), (4, "output", "O"), (5, "report", "o"), (6, "input", "in"), (7, "input", "in")]
    got = names.path_conflicts(spark.createDataFrame(rows, "packet_id int, role string, path string")).collect()
    assert sorted((r.packet_id, r.code) for r in got) == [(1, "output_is_input"), (4, "output_exists"), (5, "report_is_output")]


def test_tags_skip_reserved_ones(spark):
    wanted = spark.createDataFrame([(n,) for n in "dacb"], "identity string")
    reserved = spark.createDataFrame([("AAAAAA",), ("AAAAAC",), ("AAAAAD",), ("short",)], "tag string")
    got = sorted((r.identity, r.tag) for r in integrity.assign_tags(wanted, reserved).collect())
    assert got == [("a", "AAAAAB"), ("b", "AAAAAE"), ("c", "AAAAAF"), ("d", "AAAAAG")]


def test_canonical_digest_ignores_order(spark):
    frame = spark.sql("select map('a', map('x', 1, 'y', 2), 'b', map()) as m union all select map('b', map(), 'a', map('y', 2, 'x', 1))")
    digests = [r.digest for r in integrity.canonical_digest(frame, ["m"]).collect()]
    assert digests[0] == digests[1]


FINDING = "packet_id bigint, seq bigint, code string, file string, identity_kind string, phase string, parameters array<string>, items array<string>, setting string, location string"


def test_only_equal_warnings_merge(spark):
    warning = lambda seq, items, **k: (1, seq, k.get("code", "destinations_renamed"), k.get("file", "f"), k.get("kind", "k"), "p", k.get("params", ["x"]), items, k.get("setting"), k.get("location"))
    data = [
        warning(1, ["b", "a"]), warning(2, ["a", "c"]), warning(3, ["z"], file=None), warning(4, ["z"], file=None), warning(5, ["d"], params=["y"]),
        warning(6, ["e", "e"], code="source_invalid"), warning(7, ["e"], code="source_invalid"), warning(8, ["s"], setting="/x"), warning(9, ["l"], location="1"), warning(10, ["l", "m"], location="1"),
    ]
    merged, items = findings.merge_findings(spark.createDataFrame(data, FINDING))
    assert sorted(r.seq for r in merged.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    listed = {}
    for r in items.orderBy("seq", "ordinal").collect():
        listed.setdefault(r.seq, []).append(r["item"])
    assert listed[1] == ["b", "a", "c"] and listed[6] == ["e"] and listed[9] == ["l", "m"]


def test_ranking_puts_publication_failures_first(spark):
    codes = ["destinations_renamed", "source_invalid", "source_unreadable", "interrupted", "report_write_failed", "interrupted"]
    data = [(1, i, c, "f", None, None, None, [], None, None) for i, c in enumerate(codes)]
    frame = spark.createDataFrame(data, FINDING)
    ranked = findings.rank_findings(frame, False).orderBy("rank").collect()
    assert [r.seq for r in ranked] == [4, 3, 5, 2, 1, 0]
    packets = spark.createDataFrame([(1,), (2,)], "packet_id bigint")
    status = {r.packet_id: r.status for r in findings.packet_status(packets, frame).collect()}
    assert status == {1: "interrupted", 2: "ok"}


@pytest.mark.parametrize("limit", ["1000", "2"])
def test_renames_probe_authored_suffixes(spark, limit):
    prefix = "packet.destination"
    parts = [
        (1, ["a", f"{prefix}.4"]), (2, ["a"]), (3, ["a", f"{prefix}.5", "b"]), (4, [f"{prefix}.6", "a", f"{prefix}.9"]), (5, ["b", "a"]), (6, [f"{prefix}.7", f"{prefix}.12"]),
    ]
    used, wanted = set(), {}
    for part, listed in parts:
        for name in sorted(listed):
            chosen = name
            if name in used:
                n = len(used) + 1
                while f"{prefix}.{n}" in used or f"{prefix}.{n}" in listed:
                    n += 1
                chosen = f"{prefix}.{n}"
            used.add(chosen)
            wanted[(part, name)] = chosen
    data = [(1, part, name, 1) for part, listed in parts for name in listed]
    data += [(1, 2, "gone", None), (2, 1, "a", 1), (2, 2, "a", 1)]
    spark.conf.set("spark.quire.groupLimit", limit)
    try:
        got = names.rename_collisions(spark.createDataFrame(data, "packet_id bigint, part bigint, name string, page bigint")).collect()
    finally:
        spark.conf.unset("spark.quire.groupLimit")
    assert {(r.part, r.name): r.to for r in got if r.packet_id == 1} == wanted
    assert {r.part: r.to for r in got if r.packet_id == 2} == {1: "a", 2: f"{prefix}.2"}


def test_tree_faults(spark):
    chain = [(f"d{i}", f"d{i - 1}" if i else None, 1) for i in range(7)]
    nodes = chain + [("o", "nowhere", 1), ("below", "o", 1), ("c1", "c2", 1), ("c2", "c1", 1), ("tail", "c1", 1), ("m", "d0", 1), ("m", "d1", 2), ("under", "m", 1)]
    got = tree.check_tree(spark.createDataFrame(nodes, "node string, parent string, pos bigint"), limit=4).collect()
    assert sorted((r.node, r.fault) for r in got) == [
        ("c1", "cycle"), ("c2", "cycle"), ("d5", "too_deep"), ("d6", "too_deep"), ("m", "several_parents"), ("o", "orphan"), ("tail", "cycle")]


def test_alias_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s")], "name string, target string")
    standard = spark.createDataFrame([("c",)], "name string")
    got = {r.name: (r.terminal, r.status) for r in tree.resolve_aliases(links, standard).collect()}
    assert got == {"a": ("c", "ok"), "b": ("c", "ok"), "x": (None, "cycle"), "y": (None, "cycle"), "w": (None, "cycle"), "s": (None, "cycle")}


def test_index_faults(spark):
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (6, "g")], "key int, element string")
    index = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "x", True), (4, "e", True), (5, "f", False)], "key int, element string, live boolean")
    found, repaired = integrity.two_way_index(owners, index, ["key"])
    assert sorted((r.key, r.fault) for r in found.collect()) == [
        (2, "duplicate_claim"), (3, "disagreeing_entry"), (4, "stale_entry"), (5, "unreferenced_entry"), (6, "missing_entry")]
    assert [(r.key, r.element) for r in repaired.collect()] == [(1, "a")]
