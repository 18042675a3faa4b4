"""Every query of the engine against its SQL over the smallest tables."""

import compare
import pytest

from fathomline import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    names, rows = compare.spark_rows(df)
    assert len(set(names)) == len(names)
    if name in plans.SQL:
        want_names, want = compare.sql_rows(plans.SQL[name], SF)
        assert names == want_names
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
