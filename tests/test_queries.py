"""Every query of the library at sf0.001, against its SQL where it has one."""

import pytest

from quillstone.plans import catalog, library  # noqa: F401
from tests import oracle
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [n for n, q in catalog.QUERIES.items() if q.sql])
def test_same_rows_as_sql(spark, con, name):
    query = catalog.QUERIES[name]
    same, _, why = oracle.compare(spark, con, query.run, query.sql, SF)
    assert same, why


@pytest.mark.parametrize("name", [n for n, q in catalog.QUERIES.items() if not q.sql])
def test_runs(spark, name):
    df = catalog.QUERIES[name].run(spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
