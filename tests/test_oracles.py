"""Every query with SQL gives the rows that the SQL gives on the smallest tables."""

import pytest
from conftest import values
from screenlake.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got = [r.asDict(recursive=True) for r in QUERIES[name](spark, small).collect()]
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert values(got) == values(want)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
