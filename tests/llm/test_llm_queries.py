"""Every query of the subpackage with SQL agrees with it; those without run."""

import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k in queries.SQL])
def test_agrees_with_sql(name, compare):
    compare(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k not in queries.SQL])
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
