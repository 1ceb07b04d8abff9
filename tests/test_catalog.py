"""Every registered query against the same SQL in DuckDB."""

import pytest

from corvellum.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_engines_agree(name, spark, sf, duck, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf), duck.sql(catalog.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0
