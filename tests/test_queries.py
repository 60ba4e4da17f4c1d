"""Each query against its SQL; queries without SQL must give rows or have tests of their own."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import parity  # noqa: E402

from quillon import plans  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return parity.connection(sf)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_parity(spark, con, sf, name):
    parity.check(spark, con, sf, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
