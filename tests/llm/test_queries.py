"""Every query that SQL can express, against DuckDB."""

import pytest

from compare import connect, differences
from tallyhouse.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) == []


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
