"""Outer joins with NULL, repeated and hot keys, and the plans behind them."""

import itertools
import random
import re

import duckdb
import pytest
from conftest import FOLDER, rows

from tablewright.functions import eq_property, gt, gte, is_null, lt_property, or_
from tablewright.operators import subqueries as sub
from tablewright.plans.all import QUERIES
from tablewright.plans.driver_tables import workspace
from tablewright.schema import Column, TableSpec

LEFT = TableSpec("l", (Column("id", "INTEGER"), Column("k", "INTEGER"), Column("x", "VARCHAR")))
RIGHT = TableSpec("r", (Column("id", "INTEGER"), Column("k", "INTEGER"), Column("y", "DOUBLE")))
KEYED = TableSpec("r", RIGHT.columns, primary_key=("k",))

LEFT_ROWS = [(1, 1, "a"), (2, 1, "b"), (3, 2, None), (4, None, "d"), (5, 9, "e")]
RIGHT_ROWS = [(1, 1, 1.0), (2, 1, None), (3, 3, 3.0), (4, None, 4.0), (5, 2, 5.0)]


def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE l (id INTEGER, k INTEGER, x VARCHAR)")
    con.execute("CREATE TABLE r (id INTEGER, k INTEGER, y DOUBLE)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", LEFT_ROWS)
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", RIGHT_ROWS)
    return con


def ordered(data):
    return sorted(data, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("extra", [False, True])
def test_join_kinds(small, how, extra):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    on = [("a.k", "b.k")] + ([gt("b.y", 2)] if extra else [])
    query = ws.query("l", "a").join("r", "b", on, how)
    got = rows(query.column("a.id", "a").column("x").column("b.id", "b").column("y").frame())
    condition = "a.k = b.k" + (" AND b.y > 2" if extra else "")
    sql = f"SELECT a.id, a.x, b.id, b.y FROM l a {how} JOIN r b ON {condition}"
    assert ordered(got) == ordered(duck().execute(sql).fetchall())


def test_chain_of_outer_joins(small):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    query = (
        ws.query("l", "a")
        .left_join("r", "b", [("a.k", "b.k")])
        .full_join("l", "c", [("b.id", "c.id")])
        .right_join("r", "d", [("c.k", "d.k")])
    )
    got = rows(
        query.column("a.id", "a").column("b.id", "b").column("c.id", "c").column("d.id", "d").frame()
    )
    sql = """SELECT a.id, b.id, c.id, d.id FROM l a LEFT JOIN r b ON a.k = b.k
             FULL JOIN l c ON b.id = c.id RIGHT JOIN r d ON c.k = d.k"""
    assert ordered(got) == ordered(duck().execute(sql).fetchall())


def scans(query):
    plan = query.frame()._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"LogicalRDD|Relation ", plan))


def test_a_chain_of_left_joins_reads_linearly(small):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    query, seen = ws.query("l", "a0"), []
    for i in range(1, 5):
        query = query.left_join("r" if i % 2 else "l", f"a{i}", [(f"a{i - 1}.k", f"a{i}.k")])
        seen.append(scans(query))
    assert {b - a for a, b in zip(seen, seen[1:], strict=False)} == {3}  # the side, its keys, the keys looked up
    got = rows(query.columns(*[f"a{i}.id" for i in range(5)]).frame().toDF(*"abcde"))
    sql = """SELECT a.id, b.id, c.id, d.id, e.id FROM l a LEFT JOIN r b ON a.k = b.k LEFT JOIN l c ON b.k = c.k
             LEFT JOIN r d ON c.k = d.k LEFT JOIN l e ON d.k = e.k"""
    assert ordered(got) == ordered(duck().execute(sql).fetchall())


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_either_spelling_and_further_conditions(small, how):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    first = ws.query("l", "a").left_join("r", "b", eq_property("a.k", "b.k"))
    for on, sql in (
        (eq_property("b.id", "c.id"), "b.id = c.id"),
        ([("b.id", "c.id"), gt("a.id", 1)], "b.id = c.id AND a.id > 1"),
        ([("a.k", "c.k"), ("b.id", "c.id")], "a.k = c.k AND b.id = c.id"),
    ):
        query = first.join("l", "c", on, how)
        got = rows(query.column("a.id", "a").column("b.id", "b").column("c.id", "c").frame())
        want = f"SELECT a.id, b.id, c.id FROM l a LEFT JOIN r b ON a.k = b.k {how} JOIN l c ON {sql}"
        assert ordered(got) == ordered(duck().execute(want).fetchall())


def test_joins_without_an_equality_are_refused(small):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    query = ws.query("l", "a")
    for refused in (
        lambda: query.from_("r", "b").filter(gt("b.id", 1)).frame(),
        lambda: query.from_("r", "b").filter(lt_property("a.id", "b.id")).frame(),
        lambda: query.cross_join("r", "b", True),
        lambda: query.inner_join("r", "b", lt_property("a.id", "a.k")),
        lambda: query.inner_join("r", "b", eq_property("a.id", "a.k")),
        lambda: query.filter(sub.exists(
            ws.query("r", "b").filter(lt_property("b.id", "a.id")).filter(lt_property("b.k", "a.k")))).frame(),
    ):
        with pytest.raises(ValueError, match="equality"):
            refused()
    tied = query.from_("r", "b").from_("l", "c").filter(eq_property("a.k", "b.k"))
    with pytest.raises(ValueError, match="'c'"):
        tied.frame()
    assert tied.filter(eq_property("c.id", "b.id")).count_rows() >= 0


def test_declared_key_keeps_the_plain_outer_join(small):
    plan = lambda q: q.frame()._jdf.queryExecution().optimizedPlan().toString()
    keyed = small({LEFT: LEFT_ROWS, KEYED: RIGHT_ROWS[2:3]})
    assert "Union" not in plan(keyed.query("l").left_join("r", "b", [("k", "b.k")]))
    open_key = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    query = open_key.query("l")
    assert "Union" in plan(query.left_join("r", "b", [("k", "b.k")]))
    assert "Union" not in plan(query.join("r", "b", [("k", "b.k")], "left", split=False))
    grouped = open_key.query("r").group("k").column("k", "key").rows("n")
    assert "Union" not in plan(query.left_join(grouped, "b", [("k", "b.key")]))


def test_unqualified_names_mean_the_root(small):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    query = ws.query("l").inner_join("r", "b", [("k", "b.k")]).filter(gt("id", 2))
    assert rows(query.columns("id").frame()) == [(3,)]
    assert query.frame().columns == ["id", "k", "x"]


def test_comma_join_needs_a_link(small):
    ws = small({LEFT: LEFT_ROWS, RIGHT: RIGHT_ROWS})
    with pytest.raises(ValueError, match="no equality ties"):
        ws.query("l", "a").from_("r", "b").frame()
    with pytest.raises(ValueError, match="taken"):
        ws.query("l", "a").from_("r", "a")


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


JOINING = [
    "comma_join", "join_cross", "join_theta", "join_self", "join_full", "join_left_many",
    "exists", "exists_correlated", "not_in_sub", "ne_all", "in_sub_nested", "by_example_frame",
    "delete_join", "delete_join_chain", "update_by_key", "scalar_sub_correlated", "set_intersect",
]


@pytest.mark.parametrize("name", JOINING)
def test_no_all_pairs_plan(spark, no_broadcast, name):
    plan = final_plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search("CartesianProduct|NestedLoopJoin|NullAware", plan)


def test_filters_and_columns_reach_the_scan(spark):
    ws = workspace(spark, FOLDER)
    query = ws.query("documents", "d").filter(gt("d.nChars", 500)).columns("d.docId")
    plan = final_plan(query.frame())
    assert "GreaterThan(n_chars,500)" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def hot(spark, n, share):
    """A frame in which one key holds `share` of the rows."""
    from pyspark.sql import functions as F

    return spark.range(n).select(
        F.when(F.col("id") < int(n * share), F.lit(7)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"),
    )


def test_hot_keys_are_split(spark, no_broadcast):
    """With thresholds lowered to test size, the hot key of a third of the rows is read by
    several tasks, on whichever side it is."""
    from tablewright.schema import Catalog
    from tablewright.workspace import Workspace

    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        ws = Workspace(spark, Catalog(), None)
        big, few = hot(spark, 60_000, 1 / 3), spark.range(0, 100, 1).withColumnRenamed("id", "k")
        left_hot = ws.query(big, "a").left_join(few, "b", [("a.k", "b.k")])
        right_hot = ws.query(few, "a").left_join(big, "b", [("a.k", "b.k")])
        semi = ws.query(big, "a").filter(sub.exists(ws.query(few), on=[("a.k", "k")]))
        groups = ws.query(big).group("k").column("k").max("v", "v")
        grouped = ws.query(big, "a").inner_join(groups, "b", [("a.k", "b.k")])
        in_groups = ws.query(big, "a").filter(sub.exists(groups, on=[("a.k", "k")]))
        either = ws.query(big, "a").filter(
            or_(sub.exists(ws.query(few), on=[("a.k", "k")]), gt("a.v", 50_000))
        )
        highest = ws.query(big, "i").filter(eq_property("i.k", "a.k")).max("v", "m")
        last = ws.query(big, "a").filter(gte("a.v", highest))
        cases = (
            (last, "a.v", 40_001),
            (either, "a.v", 29_999),
            (left_hot, "a.v", 60_000),
            (right_hot, "b.v", 20_099),
            (semi, "a.v", 20_000),
            (grouped, "a.v", 60_000),
            (in_groups, "a.v", 60_000),
        )
        for query, value, n in cases:
            df = query.column("a.k", "k").column(value, "v").frame()
            assert df.count() == n
            assert "skew=true" in final_plan(df)
    finally:
        for key in changed:
            spark.conf.unset(key)


def test_rows_without_partner_on_hot_right_side(spark):
    from tablewright.schema import Catalog
    from tablewright.workspace import Workspace

    ws = Workspace(spark, Catalog(), None)
    big, few = hot(spark, 3_000, 1 / 3), spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    query = ws.query(few, "a").left_join(big, "b", [("a.k", "b.k")])
    want = {(k, v) for k, v in itertools.chain(
        ((7, v) for v in range(1000)), ((k, k) for k in range(1001, 3000, 7) if k % 7 == 0))}
    want |= {(k, k) for k in range(1000, 3000) if k % 7 == 0}
    want |= {(k, None) for k in range(0, 4000, 7) if k != 7 and not 1000 <= k < 3000}
    got = {tuple(r) for r in query.column("a.k", "k").column("b.v", "v").frame().collect()}
    assert got == want
    alone = query.filter(is_null("b.v")).column("a.k", "k").frame()
    assert alone.count() == sum(1 for _, v in want if v is None)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_counts_over_a_chain_join_one_row_per_key(small, how):
    """As many joined rows as no job could go through: a thousand per key and join."""
    many = [(i, None if i % 50 == 7 else i % 3, None) for i in range(3000)]
    ws = small({LEFT: many, RIGHT: many})
    query = (
        ws.query("l", "a").join("r", "b", [("a.k", "b.k")], how).join("l", "c", [("b.k", "c.k")], how)
        .join("r", "d", [("c.k", "d.k")], how).join("r", "e", [("a.id", "e.id")], how)
        .group("a.k").column("a.k", "k").rows("n").count("b.k", "b").count("d.id", "d").count("a.id", "a").asc("k")
    )
    size = {k: sum(1 for r in many if r[1] == k) for k in (0, 1, 2)}
    want = [(k, n**4, n**4, n**4, n**4) for k, n in size.items()]
    lost = 3000 - sum(size.values())
    assert query.list() == ([(None, lost, 0, 0, lost)] if how == "left" else []) + want


def test_counts_over_joins_against_sql(small):
    rng = random.Random(5)
    left, right = (
        [(i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, v])) for i in range(n)] for n, v in ((20, "x"), (17, 1.5))
    )
    ws, con = small({LEFT: left, RIGHT: right}), duck()
    for name, data in (("l", left), ("r", right)):
        con.execute(f"DELETE FROM {name}")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", data)
    for how in ("left", "inner"):
        query = (
            ws.query("l", "a").join("r", "b", [("a.k", "b.k")], how).join("l", "c", [("b.id", "c.k"), ("b.k", "c.id")], how)
            .join("r", "d", [("a.k", "d.id")], how).group("a.k", "a.x").column("a.x", "t")
            .rows("n").count("b.y", "b").count("c.id", "c").count("d.k", "d").count("a.x", "own")
        )
        sql = f"""SELECT a.x, count(*), count(b.y), count(c.id), count(d.k), count(a.x) FROM l a
                  {how} JOIN r b ON a.k = b.k {how} JOIN l c ON b.id = c.k AND b.k = c.id {how} JOIN r d ON a.k = d.id
                  GROUP BY a.k, a.x"""
        assert ordered(rows(query.frame())) == ordered(con.execute(sql).fetchall())
