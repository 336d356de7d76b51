import os
import re

import pytest

import __spark_entry__ as entry_point
from compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names():
    ours = {n for n in entry_point.queries() if not re.match(r"op[0-9]+_|pipeline$", n)}
    assert ours == {n for n in entry_point.oracle_sql() if not re.match(r"op[0-9]+_|pipeline$", n)}


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) & set(entry_point.oracle_sql())))
def test_query_matches_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    assert differences(df, duck, entry_point.oracle_sql()[name]) == []
