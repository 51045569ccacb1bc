"""Every query with SQL agrees with it; those without run."""

import pytest

from tidemark import queries_core, queries_reference

MODULES = (queries_core, queries_reference)
WITH_SQL = [(k, m) for m in MODULES for k in m.QUERIES if k in m.SQL]
WITHOUT = [(k, m) for m in MODULES for k in m.QUERIES if k not in m.SQL]


@pytest.mark.parametrize(("name", "module"), WITH_SQL, ids=[k for k, _ in WITH_SQL])
def test_agrees_with_sql(name, module, compare):
    compare(module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize(("name", "module"), WITHOUT, ids=[k for k, _ in WITHOUT])
def test_runs(name, module, spark):
    assert module.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
