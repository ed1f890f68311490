"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

from loomquery.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], FOLDER)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
