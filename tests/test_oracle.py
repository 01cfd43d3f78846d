"""Every registered query with an oracle SQL matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import _rows

NAMES = sorted(E.oracle_sql())


def test_every_query_is_registered_with_entry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert set(df.columns) == {"k", "n_queries", "hits", "hit_rate"}
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    dk = duck.sql(E.oracle_sql()[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
