"""Every registered query against its SQL."""

import pytest
from compare import _plain, compare, connect
from conftest import FOLDER

from tablewright.plans.all import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, QUERIES[name], SQL[name]) == []


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["c_mktsegment", "n", "total", "mean"]
    assert df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


ORDERED = "order_multi order_expr top_k top_k_grouped page page_deep page_deep_text page_deep_long page_deep_decimal page_after".split()


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_come_in_order(spark, duck, name):
    relation = duck.sql(SQL[name])
    df = QUERIES[name](spark, FOLDER).select(*relation.columns)
    got = [[_plain(v) for v in row] for row in df.collect()]
    assert got == [[_plain(v) for v in row] for row in relation.fetchall()]
