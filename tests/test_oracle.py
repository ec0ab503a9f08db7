"""Every registered query against DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
import oracle
from quire.plans import load_queries
from quire.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
load_queries()
STATEMENTS = ORACLES


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_a_statement_and_is_exposed():
    assert set(QUERIES) == set(STATEMENTS) <= set(entry.queries())
    assert set(STATEMENTS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, connection, name):
    problems, _ = oracle.compare(spark, connection, SF_DIR, QUERIES[name], STATEMENTS[name])
    assert not problems


# One query per ordered primitive, with groups forced through the chunked path.
SPLIT = ["label_pages", "inherit_sizes", "lookup_at", "preorder", "merge_finding_items", "rename_collisions", "paginate_rows", "limit_breaches", "default_conflicts"]


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_match_duckdb(spark, connection, name):
    spark.conf.set("spark.quire.groupLimit", "3")
    try:
        problems, _ = oracle.compare(spark, connection, SF_DIR, QUERIES[name], STATEMENTS[name])
    finally:
        spark.conf.unset("spark.quire.groupLimit")
    assert not problems


def test_partition_count_does_not_matter(spark):
    results = []
    for partitions in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        frame = QUERIES["label_pages"](spark, SF_DIR)
        results.append(oracle.digest(frame.columns, [tuple(r) for r in frame.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
