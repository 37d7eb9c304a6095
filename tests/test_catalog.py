"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from passagemill.plans import catalog, oracle
from tests.compare import TESTDATA, compare, connect

SF = os.environ.get("TEST_SF_DIR", f"{TESTDATA}/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    rows, problem, *_ = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(oracle.ORACLE)


def test_recall_of_the_approximate_searches(spark):
    """Held at what was first measured on this table: 0.70 at sf0.01 for both."""
    sf = f"{TESTDATA}/sf0.01"
    pairs = lambda name: {(r.query_id, r.vec_id) for r in entry.queries()[name](spark, sf).collect()}
    exact = pairs("topk_cosine")
    for name in ("ann_ivf", "ann_lsh"):
        assert len(pairs(name) & exact) / len(exact) > 0.65


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "query_id", "rank", "raw_data_id", "chunk_index", "chunk_text", "distance",
    ]
