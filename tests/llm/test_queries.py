"""The queries with SQL against it, over whole tables."""

import os

import pytest

from passagemill.llm import oracle, queries
from tests.compare import TESTDATA, compare, connect

SF = os.environ.get("TEST_SF_DIR", f"{TESTDATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, name):
    rows, problem, *_ = compare(spark, connect(SF), SF, name, queries.QUERIES[name], oracle.ORACLE[name])
    assert problem is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(oracle.ORACLE) <= set(queries.QUERIES)
