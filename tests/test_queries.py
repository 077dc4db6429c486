"""Every registered query runs, and equals its SQL where it has one."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare
from vecspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLES:
        compare(df, catalogue.ORACLES[name], SMALL)
    else:
        assert len(df.collect()) == 10


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 10
    assert set(e.oracle_sql()) <= set(e.queries())
