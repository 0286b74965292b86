"""All named queries of the subpackage with SQL, on the smallest test data; skipped where the data aren't there."""

import os

import pytest

queries = pytest.importorskip("helixframe.llm.queries")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    from test_plans import test_query_equals_sql

    test_query_equals_sql(spark, name)
