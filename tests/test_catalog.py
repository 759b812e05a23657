import os

import pytest

import __spark_entry__ as driver
from compare import differences
from tollgate.catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_check_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows, found = differences(spark, FOLDER, name)
    assert rows > 0 and not found


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["nauc", "ps", "qnc", "points"] and df.count() == 1


def test_names_in_the_skew_test_are_registered():
    """A query that is renamed is missed here, not after twenty minutes of runs."""
    from test_skew import test_query

    names = next(m for m in test_query.pytestmark if m.name == "parametrize").args[1]
    assert set(names) <= set(QUERIES)
