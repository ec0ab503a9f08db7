from quire.llm.lines import drop_boilerplate

SCHEMA = "doc_id long, source string, text string, n_dropped string"


def cut(spark, rows, **kw):
    found = drop_boilerplate(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in found), key=str)


def test_lines_are_judged_by_site(spark):
    rows = [(k, "a", f"menu\nown {k}\n\nmenu", "x") for k in range(5)] + [(k, "b", f"menu\nown {k}", "x") for k in range(10, 12)]
    found = cut(spark, rows, ratio=0.5, least_pages=3)
    assert found == sorted([(k, f"own {k}\n", 2) for k in range(5)] + [(k, f"menu\nown {k}", 0) for k in range(10, 12)], key=str)


def test_ratio_counts_pages_not_occurrences(spark):
    rows = [(1, "a", "x\nx\nx\nx", None), *((k, "a", f"y{k}", None) for k in range(2, 10))]
    assert all(n == 0 for _, _, n in cut(spark, rows, ratio=0.3, least_pages=2))


def test_odd_rows(spark):
    rows = [(1, None, "m\nq", None), (2, "a", None, None), (3, "a", "", None), (4, "a", "m", None), (4, "a", "m", None), (5, "a", "m\n" + "z" * 1_000_000, None)]
    assert cut(spark, rows, ratio=0.5, least_pages=3) == sorted([(1, "m\nq", 0), (2, None, 0), (3, "", 0), (4, "", 1), (4, "", 1), (5, "z" * 1_000_000, 1)], key=str)
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_of_any_name_stay(spark):
    rows = [(k, "a", f"menu\nown {k}", "h", "d", 7, "p", "s") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, _host string, _drop string, _kept long, _page string, _split string").selectExpr("*", "9 AS n_dropped", "1 AS `a.b`")
    found = drop_boilerplate(frame, ratio=0.5, least_pages=3)
    assert found.columns == [*[c for c in frame.columns if c != "n_dropped"], "n_dropped"]
    assert sorted(tuple(r) for r in found.collect()) == [(k, "a", f"own {k}", "h", "d", 7, "p", "s", 1, 1) for k in range(5)]
