"""Layer 1: every query with an oracle equals DuckDB on sf0.001 (rows,
columns and an order-insensitive multiset of values)."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import _rows

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_every_query_has_a_builder():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 70


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["risk_level", "age_band", "n", "mean_probability"]
    assert df.count() > 0
