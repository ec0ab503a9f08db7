"""The queries that SQL can express against DuckDB, and that all are registered."""

import pytest

import __spark_entry__ as entry
import oracle
from quire.llm import queries as _  # noqa: F401
from quire.llm.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    assert [n for k in range(1, 14) for n in QUERIES if n.startswith(f"op{k}_")] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert len(QUERIES) == 13 and {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    problems, _ = oracle.compare(spark, oracle.connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert not problems
