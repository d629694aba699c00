import os

import pytest

from spectraloom.llm import queries
from tests.oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name]) > 0
