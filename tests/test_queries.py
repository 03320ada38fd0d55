"""Every registered query of the engine against its DuckDB twin, or for its rows."""

import pytest
from compare import same

from cairnfield.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


#: Empty on the smallest tables: too few edges for a cycle, one lot a road.
SPARSE = {"graph_two_core", "stitched_profiles"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0 or name in SPARSE


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "source", "name", "distance_m"]
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
