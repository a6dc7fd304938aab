import os

import pytest

from embera.queries import ORACLES, QUERIES
from tests.sql_check import differs

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert differs(df, ORACLES[name], DATA) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())
    if os.path.isdir(DATA):
        assert E.entry(spark).count() == 20
