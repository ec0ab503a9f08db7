"""Values at the edges: unlisted codes, absent facts, short boxes, spellings of paths."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.functions.limits import FINDING_CODES
from quire.functions.rules import language_ok
from quire.operators import admission, findings, geometry, integrity, names, occurrences, ranges, tree
from quire.sources import manifests, reports


def test_every_code_has_its_status_and_others_fail(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(FINDING_CODES)], "packet_id int, code string")
    found = {r["packet_id"]: r["status"] for r in findings.packet_status(rows, rows).collect()}
    assert len(FINDING_CODES) == 85
    assert [found[k] for k, _ in enumerate(FINDING_CODES)] == [kind or "ok" for _, kind in FINDING_CODES.values()]
    for code in ("no_such_code", None):
        odd = spark.createDataFrame([(1, code)], "packet_id int, code string")
        with pytest.raises(PySparkException):
            findings.packet_status(odd, odd).collect()


def test_geometry_of_absent_and_short_values(spark):
    box = [0.0, 0.0, 10.0, 20.0]
    rows = [(1, box, None, None, None), (2, box, None, 90, None), (3, [0.0, 5.0], None, 0, 1.0), (4, box, [1.0, 2.0], 0, 1.0), (5, box, [None, 0.0, 5.0, 5.0], 0, 1.0), (6, None, None, 0, 1.0), (7, box, [1.0, 1.0, 5.0, 9.0], 0, 2.0)]
    good, bad = geometry.effective_geometry(spark.createDataFrame(rows, "page int, media array<double>, crop array<double>, rotate int, unit double"))
    assert {r["page"]: (r["width"], r["height"]) for r in good.collect()} == {1: (10.0, 20.0), 2: (20.0, 10.0), 7: (8.0, 16.0)}
    assert sorted(r["page"] for r in bad.collect()) == [3, 4, 5, 6]


def test_language_tags_of_any_length(spark):
    variants = [f"a{k:04d}" for k in range(70)]
    rows = spark.createDataFrame([("-".join(["en", *variants]),), ("-".join(["en", *variants, variants[69]]),)], "tag string")
    assert [r[0] for r in rows.select(language_ok(F.col("tag"))).collect()] == [True, False]


def test_all_problem_runs_are_kept(spark):
    rows = spark.createDataFrame([(1, "a\x07" * 50)], "id int, text string")
    assert admission.text_problem_runs(rows).count() == 50


def test_unknown_sources_and_unwritten_sides(spark):
    chosen = spark.createDataFrame([(1, "known", 1, 1, 9), (2, "gone", 1, 1, 2), (3, "gone", 1, 5, 2)], "packet_id int, path string, ordinal long, first long, last long")
    facts = spark.createDataFrame([("known", 5, False)], "path string, pages long, has_fields boolean")
    found = {r["packet_id"]: r["code"] for r in ranges.range_rejects(chosen, facts, ["packet_id"]).collect()}
    assert found == {1: "source_selection_out_of_range", 2: "source_processing_failed", 3: "plan_value"}
    want = spark.createDataFrame([(1, 1, "t", 5.0, 6.0), (1, 2, "t", None, None)], "packet_id int, page int, text string, width double, height double")
    got = spark.createDataFrame([(1, 1, "t", None, None, "a"), (1, 2, "t", 1.0, 1.0, "b")], "packet_id int, page int, text string, width double, height double, object string")
    assert [(r["page"], r["check"]) for r in integrity.verify_pages(want, got).collect()] == [(1, "geometry")]


def test_absent_differs_from_empty_and_claims_count(spark):
    uses = spark.createDataFrame([("s", None), ("s", ""), ("s", "")], "source string, ranges string")
    assert sorted(r["uses"] for r in occurrences.share_analyses(uses, ["source", "ranges"])[0].collect()) == [1, 2]
    owners = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "key int, element string, claims boolean")
    index = spark.createDataFrame([(1, "a", True), (2, "c", True)], "key int, element string, live boolean")
    faults, repaired = integrity.two_way_index(owners, index, ["key"])
    assert [(r["key"], r["fault"]) for r in faults.collect()] == [(2, "stale_entry")]
    assert [r["key"] for r in repaired.collect()] == [1]


def test_spellings_of_a_path_conflict(spark):
    rows = [(1, "input", "in/a.pdf"), (2, "output", "in/./a.pdf"), (3, "report", "in/x/../A.pdf"), (4, "output", "s3://b/x//y"), (5, "input", "s3://b/x/y"), (6, "output", "other")]
    found = names.path_conflicts(spark.createDataFrame(rows, "packet_id int, role string, path string")).collect()
    assert sorted((r["packet_id"], r["code"]) for r in found) == [(2, "output_is_input"), (3, "report_is_input"), (4, "output_is_input")]


def test_publishing_never_replaces_an_input(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    df = spark.read.parquet(source).limit(1)
    for target in (f"{tmp_path}/out/../in", f"file://{tmp_path}/in", f"file:{tmp_path}/./in/", str(tmp_path)):
        with pytest.raises(reports.PublishRefused):
            reports.publish(df, target, [], overwrite=True)
    assert spark.read.parquet(source).count() == 3
    target = str(tmp_path / "out")
    reports.publish(df, target, [source])
    with pytest.raises(reports.PublishRefused):
        reports.publish(df, target, [source])
    reports.publish(spark.read.parquet(source), target, [source], overwrite=True)
    assert spark.read.parquet(target).count() == 3


def test_trees_of_different_packets_do_not_mix(spark):
    rows = [(p, n, up, k) for p in ("a", "b") for n, up, k in (("/0", None, 0), ("/0/0", "/0", 0), ("/0/1", "/0", 1))] + [("b", "/9", "/8", 0)]
    nodes = spark.createDataFrame(rows, "packet_id string, node string, parent string, pos int")
    reached, unreached = tree.with_paths(nodes)
    assert reached.count() == 6 and [(r["packet_id"], r["node"]) for r in unreached.collect()] == [("b", "/9")]
    assert [(r["packet_id"], r["node"], r["fault"]) for r in tree.check_tree(nodes).collect()] == [("b", "/9", "orphan")]


def test_leaves_below_the_depth_limit_count(spark):
    chain = [(0, None, 0, 1)] + [(k, k - 1, 0, None) for k in range(1, 6)]
    nodes = spark.createDataFrame(chain, "node int, parent int, pos int, claim int")
    assert {(r["node"], r["fault"]) for r in tree.check_tree(nodes, limit=3, declared="claim").collect()} == {(4, "too_deep"), (5, "too_deep")}


ITEMS = [
    ('{"source": "a", "pages": [[1]]}', "plan_type"), ('{"source": "a", "pages": [[1, 2, 3]]}', "plan_type"), ('{"source": "a", "pages": [["x", 2]]}', "plan_type"),
    ('{"source": "a", "pages": [1]}', "plan_type"), ('{"source": "a", "pages": []}', "plan_value"), ('{"source": "a", "pages": [[]]}', "plan_type"),
    ('{"source": "a", "page": {}}', "plan_item_shape"), ('{"source": "a", "title": "t"}', "plan_item_shape"), ('{"page": {}, "title": "t"}', "plan_item_shape"),
    ('{"contents": {}, "divider": {}}', "plan_item_shape"), ('{"items": [{"source": "a"}]}', "plan_item_shape"), ('{"title": "t", "items": []}', "plan_value"),
    ('{"page": {"colour": 1}}', "plan_unknown_member"), ('{"page": {"size": null}}', "plan_null"), ("{}", "plan_item_shape"),
    ('{"source": "a", "pages": [[1, 2], [4, 4]], "numbering": true}', None), ('{"page": {}, "count": 2}', None), ('{"contents": {}}', None),
    ('{"title": "t", "divider": {}, "items": [{"source": "a"}]}', None), ('{"numbering": false, "items": [{"source": "a"}]}', None),
]


def test_items_are_refused_by_their_members(spark):
    cases = {f"p{k}": (f'{{"version": 8, "items": [{item}]}}', code) for k, (item, code) in enumerate(ITEMS)}
    texts = spark.createDataFrame([(name, text) for name, (text, _) in cases.items()] + [("fine", '{"version": 8, "items": [{"source": "b"}]}')], "packet_id string, manifest string")
    found = manifests.parse_manifests(texts)
    assert {r["packet_id"]: r["code"] for r in found.rejects.collect()} == {name: code for name, (_, code) in cases.items() if code}
    assert {r["packet_id"] for r in found.items.collect()} == {"fine", *[name for name, (_, code) in cases.items() if not code]}
