"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    fine = "ok" if name in entry.oracle_sql() else "rows"
    assert result.startswith(fine) and "TYPES" not in result, result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
