"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import pytest

from fieldspark.plans.catalogue import QUERIES, SQL

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_values(spark, sf, name):
    """What SQL can't express has rows, and values in each column; test_operators.py holds the operators against others' results."""
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and not got.isna().all().any(), name


def test_force_chains_on_more_rows(spark, sf):
    """The smallest tables hold no chain of three."""
    more = sf.replace("sf0.001", "sf0.01")
    got = QUERIES["force_chains"](spark, more).toPandas()
    assert len(got) > 500
    assert_same(got, connect(more).execute(SQL["force_chains"]).df())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
