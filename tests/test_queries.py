"""Every graph query against its SQL."""

import pytest
from graphspark.plans import catalog
from oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", catalog.queries()[name], catalog.oracle_sql()[name]) == []
