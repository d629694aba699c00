import os

import pytest

from spectraloom.plans import suite
from tests.oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_as_sql(spark, name):
    assert compare(spark, suite.QUERIES[name], suite.SQL[name]) > 0


def test_names():
    assert suite.SQL.keys() <= suite.QUERIES.keys() and suite.FLAGSHIP in suite.QUERIES
