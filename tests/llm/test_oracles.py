"""The queries of the subpackage that SQL can express."""

import pytest

from quillstone.llm import registry
from tests import oracle

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    same, n, why = oracle.compare(spark, oracle.connect(sf_dir), registry.queries()[name], SQL[name], sf_dir)
    assert same and n, why
