"""Every registered query agrees with its SQL on the smallest data."""

import pytest

from verification import ORACLES, QUERIES
from verification.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, connection, ORACLES[name]) is None
    else:
        assert df.count() > 0
