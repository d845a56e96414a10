"""Every query of the library against its SQL."""

import pytest
from compare import compare
from conftest import SF

from weftgraph import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, SF, Q.queries()[name], Q.oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["v", "label"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
