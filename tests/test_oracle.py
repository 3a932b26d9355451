"""Every query that has SQL gives the rows of its SQL."""

import pytest

from quillmere.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(name, same):
    assert same(catalog.QUERIES[name], catalog.SQL[name]) > 0  # nothing against nothing proves nothing


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() >= 0
