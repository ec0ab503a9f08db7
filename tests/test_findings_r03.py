"""Cases of the third round of findings: queries whose results or plans failed on larger tables."""

import duckdb

import oracle
from quire.plans import load_queries
from quire.plans.registry import ORACLES, QUERIES

load_queries()


def test_manifest_with_a_foreign_member_and_another_version_matches_duckdb(spark, tmp_path):
    """Ids that are divisible by two of the divisors carry two faults; the smaller tables have none of them."""
    ids = "(VALUES (1), (37), (41), (43), (37 * 41), (37 * 43), (41 * 43)) v(i)"
    duckdb.sql(f"SELECT i::BIGINT AS doc_id, 'x' AS text, 'en' AS lang, 'web' AS source, 1::BIGINT AS n_chars FROM {ids}").write_parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    problems, rows = oracle.compare(spark, connection, str(tmp_path), QUERIES["manifest_rejects"], ORACLES["manifest_rejects"])
    assert not problems and rows == 6


def broadcasts(frame):
    """Sides of joins that the plan sends through the driver."""
    return [line for line in frame._jdf.queryExecution().sparkPlan().toString().splitlines() if "Broadcast" in line]


def test_exploded_pages_are_not_sent_through_the_driver(spark):
    """A part table of few bytes explodes into many pages, which its size does not tell."""
    from quire.operators import layout, ranges

    parts = spark.range(3).selectExpr("concat('part/', id) as path", "explode(sequence(1L, 20L)) as page", "1.0D as width")
    chosen = spark.createDataFrame([(1, "part/1", 1, 2, 7)], "pos bigint, path string, ordinal bigint, first bigint, last bigint")
    assert not broadcasts(ranges.select_pages(chosen, parts, ["pos"], False))
    spans = chosen.selectExpr("path", "1L as _src", "first as _first", "last as _last")
    runs = parts.selectExpr("path", "page as first", "page as last", "width", "width as height")
    cut = layout._cut_by_size(spans, runs)
    assert not broadcasts(cut)
    assert sorted(r[:2] for r in cut.select("_first", "_src").collect()) == [(p, p - 1) for p in range(2, 8)]


def test_select_pages_cuts_ranges_at_blocks(spark):
    """Long ranges over several blocks, and two uses of one source."""
    from quire.operators import ranges

    rows = spark.createDataFrame([(1, "a", 1, 250, 700), (1, "a", 2, 800, 800), (2, "a", 1, 1, 2), (3, "b", 1, 5, 4)], "pos bigint, path string, ordinal bigint, first bigint, last bigint")
    pages = spark.range(1, 1001).selectExpr("'a' as path", "id as page", "cast(id as double) as width")
    found = ranges.select_pages(rows, pages, ["pos"]).select("pos", "page", "selected", "width").collect()
    expected = [(1, p, p - 249) for p in range(250, 701)] + [(1, 800, 452), (2, 1, 1), (2, 2, 2)]
    assert sorted(tuple(r) for r in found) == sorted((*e, float(e[1])) for e in expected)


def test_rounds_over_nodes_send_no_table_to_the_driver(spark, monkeypatch):
    """Every table that a round writes is planned without a broadcast side."""
    from quire.operators import tree

    found, write = [], tree.durable

    def watched(frame):
        found.extend(broadcasts(frame))
        return write(frame)

    monkeypatch.setattr(tree, "durable", watched)
    nodes = spark.range(40).selectExpr("id as node", "case when id > 0 then id div 2 end as parent", "id as pos", "1L as claim")
    edges = nodes.filter("node > 0").selectExpr("parent as src", "node as dst")
    assert tree.reach(nodes, edges, nodes.filter("node = 0")).reached.count() == 40
    found += broadcasts(tree.check_tree(nodes, declared="claim"))
    found += broadcasts(tree.resolve_aliases(edges.selectExpr("dst as name", "src as target"), nodes.selectExpr("node as name")))
    assert not found


def test_tree_queries_number_the_nodes_once(spark, monkeypatch):
    """Every numbering sorts, writes and shuffles the whole tree where packets outgrow a task."""
    from quire.operators import tree

    calls, number = [], tree.with_positions

    def watched(*args, **kwargs):
        calls.append(args[3])
        return number(*args, **kwargs)

    monkeypatch.setattr(tree, "with_positions", watched)
    for name in ("deep_outlines", "graft_trees", "renamed_fields", "qualified_names"):
        calls.clear()
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1, (name, calls)


def test_following_row_is_the_same_in_chunks(spark):
    from quire.operators.scan import Following, scan

    rows = spark.createDataFrame([(1, p, None if p == 4 else p * 10) for p in (1, 2, 4, 7, 8)] + [(2, 3, 5)], "g int, pos bigint, v int")
    expected = [(1, 1, 20), (1, 2, None), (1, 4, 70), (1, 7, 80), (1, 8, None), (2, 3, None)]
    for limit in ("3", "100"):
        spark.conf.set("spark.quire.groupLimit", limit)
        try:
            found = scan(rows, ["g"], ["pos"], [Following("n", rows["v"])]).select("g", "pos", "n").collect()
        finally:
            spark.conf.unset("spark.quire.groupLimit")
        assert sorted(tuple(r) for r in found) == expected


def test_page_map_digest_writes_no_label_as_text(spark):
    plan = QUERIES["page_map"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan and "—" not in plan


def test_authored_renames_write_no_tables_within_the_limit(spark, monkeypatch):
    """Packets within the limit are settled in one pass; free numbers are found without trying the used ones again."""
    from quire.operators import names

    def never(frame):
        raise AssertionError("a table was written")

    monkeypatch.setattr(names, "durable", never)
    rows = [(1, part, f"packet.destination.{part + 3000}", 1) for part in range(1, 6000)] + [(1, 6000 + part, "packet.destination.3001", 1) for part in range(6000)]
    rows += [(2, 1, "a", 1), (2, 2, "a", 1), (2, 2, "packet.destination.2", None), (2, 2, "packet.destination.3", 1), (3, 1, "b", 1)]
    frame = spark.createDataFrame(rows, "packet_id bigint, part bigint, name string, page bigint")
    found = {(r.packet_id, r.part, r.name): (r.to, r.renamed, r.n) for r in names.rename_collisions(frame, tasks=3).collect()}
    assert len(found) == len(rows) - 1
    assert found[(2, 2, "a")] == ("packet.destination.4", True, 2) and found[(2, 2, "packet.destination.3")] == ("packet.destination.3", False, 3)
    assert found[(1, 6000, "packet.destination.3001")] == ("packet.destination.9000", True, 6000)
    assert found[(1, 11999, "packet.destination.3001")] == ("packet.destination.14999", True, 11999)
    assert found[(3, 1, "b")] == ("b", False, 1)


def test_suspicious_characters_are_the_same_by_two_classes(spark):
    """The common characters are settled by the first class, before the ranges of the accepted blocks."""
    from quire.operators.admission import SUSPECT

    accepted = r"[^\n\x20-\x7E\xA0-\xAC\xAE-ɏΑ-ΡΣ-ωА-я‐-‧]"
    assert SUSPECT.startswith(r"[[^\n\x20-\x7E]&&")
    points = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["\U0001F600", "\U000E0001"]
    rows = spark.createDataFrame([(c,) for c in points], "c string")
    assert rows.where(rows.c.rlike(SUSPECT) != rows.c.rlike(accepted)).count() == 0
    assert 0 < rows.where(rows.c.rlike(SUSPECT)).count() < len(points)


def dealt(spark, name, rows):
    """The plan of a query whose tasks take about ``rows`` rows each."""
    spark.conf.set("spark.quire.taskRows", rows)
    try:
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.quire.taskRows")


def test_packets_are_dealt_over_more_tasks_in_larger_tables(spark):
    """The number of tasks follows the rows of the table, not the session's number of partitions."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("span_map", "merge_ranges", "range_rejects", "inherit_sizes", "inherit_size_findings", "repaired_index", "two_way_index"):
        for rows in (100, 300):
            assert f", {-(-lines // rows)}), REPARTITION_BY_NUM" in dealt(spark, name, rows), (name, rows)
        assert "REPARTITION_BY_NUM" not in dealt(spark, name, 1_000_000), name


def test_sources_joined_sorted_are_dealt_over_more_tasks(spark, monkeypatch):
    """Beyond some sources their join is sorted; both sides and the packets after it follow the number of rows."""
    from quire.plans import fixtures

    monkeypatch.setattr(fixtures, "SORTED_PARTS", 10)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    number = f", {-(-lines // 100)}), REPARTITION_BY_NUM"
    plan = dealt(spark, "range_rejects", "100")
    assert plan.count(number) >= 4 and "path" in [line for line in plan.splitlines() if number in line and "path" in line][0]
    spark.conf.set("spark.quire.taskRows", "100")
    try:
        problems, rows = oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", QUERIES["range_rejects"], ORACLES["range_rejects"])
    finally:
        spark.conf.unset("spark.quire.taskRows")
    assert not problems and rows


def test_index_is_compared_without_a_join_and_null_keys_meet_nothing(spark):
    from quire.operators import integrity

    assert "FullOuter" not in dealt(spark, "two_way_index", 1_000_000)
    owners = spark.createDataFrame([(1, None, 5), (1, 2, 5), (1, 3, 6)], "p int, k int, element int")
    index = spark.createDataFrame([(1, None, 5, False), (1, 2, 5, True), (1, 4, 6, True)], "p int, k int, element int, live boolean")
    findings, repaired = integrity.two_way_index(owners, index, ["p", "k"])
    assert sorted((r.k or 0, r.fault) for r in findings.collect()) == [(0, "missing_entry"), (0, "unreferenced_entry"), (3, "missing_entry"), (4, "stale_entry")]
    assert [tuple(r) for r in repaired.collect()] == [(1, 2, 5)]


def test_pages_are_listed_after_their_sources_are_dealt(spark):
    plan = dealt(spark, "page_runs", 100).splitlines()
    exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
    listed = [i for i, line in enumerate(plan) if "Generate" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in plan[exchanges[0]] and exchanges[0] > listed[0]
