"""Pages keep their order at every depth, and write sort keys at most."""

import glob
import os

import pytest

from tablewright.functions import multiply
from tablewright.schema import Catalog
from tablewright.session import shared_dir
from tablewright.workspace import Workspace

N = 30_000


@pytest.fixture(scope="module")
def numbers(spark):
    from pyspark.sql import functions as F

    df = spark.range(N).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("hot"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("a long common start "), F.col("id") % 900)).alias("t"),
        (F.col("id") * 7919 % N).cast("double").alias("d"),
    ).repartition(5)
    return Workspace(spark, Catalog(), None).query(df.cache())


def ranked(query, key):
    return sorted((tuple(r) for r in query.columns("id", "hot", "t", "d").frame().collect()), key=key)


ORDERS = {
    "number": (lambda q: q.desc("d").asc("id"), lambda r: (-r[3], r[0])),
    "hot value": (lambda q: q.asc("hot").asc("t").asc("id"), lambda r: (r[1], r[2] is not None, r[2] or "", r[0])),
    "text": (lambda q: q.asc("t", "last").desc("id"), lambda r: (r[2] is None, r[2] or "", -r[0])),
    "expression": (lambda q: q.order(multiply("d", -2)), lambda r: -r[3]),
}


@pytest.mark.parametrize("name", ORDERS)
@pytest.mark.parametrize("bounds", [(5, 12_000), (14_990, 30), (25_000, 9_000)])
def test_pages_in_order(numbers, name, bounds):
    order, key = ORDERS[name]
    offset, count = bounds
    query = order(numbers).columns("id", "hot", "t", "d").limit(offset, count)
    assert query.list() == ranked(numbers, key)[offset : offset + count]


def test_grouped_and_distinct_pages_in_order(numbers):
    grouped = numbers.group("id").columns("id").rows("n").desc("id").limit(12_000, 6)
    assert grouped.list() == [(N - 1 - i, 1) for i in range(12_000, 12_006)]
    distinct = numbers.distinct("d").asc("d").limit(10_500, 3)
    assert distinct.list() == [(10_500.0,), (10_501.0,), (10_502.0,)]


def test_pages_write_sort_keys_only(spark, numbers):
    def files():
        return set(glob.glob(os.path.join(shared_dir(spark), "**", "*.parquet"), recursive=True))

    before = files()
    assert numbers.columns("id").limit(20_000).count_rows() == 20_000
    assert numbers.columns("id").limit(29_000, 5_000).count_rows() == 1_000
    assert numbers.columns("id", "d").asc("d").limit(9_000, 10).count_rows() == 10
    assert files() == before
    assert numbers.columns("id", "t", "d").asc("d").limit(20_000, 10).count_rows() == 10
    assert set(spark.read.parquet(*files() - before).columns) == {"_o0", "_part", "_pos"}


ROWS = 600


@pytest.fixture(scope="module")
def keys(spark):
    """Keys that agree far from their start, beyond doubles, in NULL, NaN, signed zero, and all but one."""
    from pyspark.sql import functions as F

    i = F.col("id")
    df = spark.range(ROWS).select(
        "id",
        F.concat(F.lit("x" * 400), F.lpad((i * 7 % ROWS).cast("string"), 4, "0")).alias("long_text"),
        (F.lit(1 << 62) + i * 11 % ROWS).alias("large"),
        (F.lit("1" + "0" * 30).cast("decimal(38,0)") + i * 13 % ROWS).cast("decimal(38,0)").alias("wide"),
        F.when(i % 5 == 0, None).when(i % 7 == 0, float("nan")).when(i % 2 == 0, -0.0).otherwise(0.0).alias("odd"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 17 % ROWS).alias("ts"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 19 % ROWS).cast("timestamp_ntz").alias("ntz"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i * 23 % ROWS).cast("int")).alias("day"),
        F.concat(F.lit("y" * 300), (i % 4).cast("string")).cast("binary").alias("few"),
        (i % 2 == 0).alias("flag"),
    )
    return Workspace(spark, Catalog(), None).query(df.repartition(6).cache())


KEYS = "long_text large wide odd ts ntz day few flag".split()


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_the_real_keys(keys, monkeypatch, key, descending):
    monkeypatch.setattr("tablewright.operators.paging.ONE_TASK", 20)
    ordered = keys.order(key, descending).asc("id").columns("id")
    want = [r[0] for r in ordered.list()]
    for offset, count in ((100, 50), (0, 300), (590, 50), (600, 5), (700, 5)):
        assert [r[0] for r in ordered.limit(offset, count).list()] == want[offset : offset + count]
    last = keys.order(key, descending, ).order("id", True).columns("id")
    nulls = keys.asc(key, "last").desc("id").columns("id")
    assert last.limit(200, 100).list() == last.list()[200:300]
    assert nulls.limit(200, 350).list() == nulls.list()[200:550]


@pytest.mark.parametrize("key", ["few", "flag", "odd"])
def test_ties_over_both_ends(keys, monkeypatch, key):
    monkeypatch.setattr("tablewright.operators.paging.ONE_TASK", 20)
    ordered = keys.asc(key).columns("id", key)
    want = [repr(r[1]).replace("-0.0", "0.0") for r in ordered.list()]
    for offset, count in ((100, 50), (140, 320), (10, 580), (0, 600)):
        got = ordered.limit(offset, count).list()
        assert [repr(r[1]).replace("-0.0", "0.0") for r in got] == want[offset : offset + count]
        assert len({r[0] for r in got}) == min(count, ROWS - offset)
