"""The queries that SQL can express, against it."""

import pytest
from graphspark.llm import entry
from oracle import differences


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", entry.queries()[name], entry.oracle_sql()[name]) == []
