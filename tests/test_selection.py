"""Projection, grouping, order, pages, set operations, fields, named queries."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows

from tablewright.functions import (
    add,
    avg,
    by_example,
    by_identity,
    concat,
    count,
    divide,
    eq,
    field,
    func,
    gt,
    in_,
    literal,
    lt,
    max_,
    mod,
    multiply,
    op,
    pk,
    raw,
    subtract,
    sum_,
    template,
    text,
)
from tablewright.schema import Column, TableSpec

NUMS = TableSpec(
    "nums",
    (Column("id", "INTEGER"), Column("someA", "INTEGER"), Column("b", "INTEGER"), Column("s", "VARCHAR")),
    primary_key=("id",),
)
NUMS_ROWS = [
    (1, 7, 2, "x"), (2, -7, 2, "y'z"), (3, 5, 0, None), (4, None, 3, "x"),
    (5, 2147483647, 1, "?"), (6, 7, 2, "x"),
]


@pytest.fixture
def ws(small):
    return small({NUMS: NUMS_ROWS})


def only(ws, e, below=100):
    query = ws.query("nums").filter(lt("id", below)).column("id").column(e, "v")
    return [r[1] for r in rows(query.frame())]


def test_properties_and_columns(ws):
    q = ws.query("nums")
    assert ws.store.read("nums").columns == ["id", "some_a", "b", "s"]
    assert q.select_all().frame().columns == ["id", "someA", "b", "s"]
    assert q.select_subset(included=["someA"], as_property=False).frame().columns == ["some_a"]
    assert q.column("someA", "x").column("b").columns("id", "s").frame().columns == [
        "x", "b", "id", "s",
    ]
    assert rows(q.column(pk(), "key").limit(0).frame()) == []


def test_arithmetic(ws):
    assert only(ws, add("someA", "b"), below=5) == [9, -5, 5, None]
    assert only(ws, subtract("someA", "b"))[:3] == [5, -9, 5]
    assert only(ws, subtract("someA", 1))[:3] == [6, -8, 4]
    assert only(ws, multiply(add("b", 1), 10)) == [30, 30, 10, 40, 20, 30]
    assert only(ws, divide("someA", "b")) == [3.5, -3.5, None, None, 2147483647.0, 3.5]
    assert only(ws, mod("someA", "b")) == [1, -1, None, None, 0, 1]
    assert only(ws, field("someA").bit_and("b")) == [2, 0, 0, None, 1, 2]
    assert only(ws, field("b") ^ 1) == [3, 3, 1, 2, 0, 3]
    assert only(ws, 10 - field("b")) == [8, 8, 10, 7, 9, 8]


def test_overflow_is_an_error(ws):
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        only(ws, add("someA", 1))


def test_text_fields(ws):
    assert only(ws, concat("s", literal("-"), "id")) == ["x-1", "y'z-2", None, "x-4", "?-5", "x-6"]
    assert only(ws, template("coalesce(?, ?)", "'s'", "it's ? \\ 体"))[2] == "it's ? \\ 体"
    assert only(ws, template(r"concat(?, '\?')", "'s'"))[0] == "x?"
    assert only(ws, template("? + ? + ?", "'id'", 1))[0] == 3
    assert only(ws, template("?", None)) == [None] * 6
    assert only(ws, template("year(?)", dt.date(1999, 5, 1)))[0] == 1999
    assert only(ws, template("cast(? as int)", Decimal("7.5")))[0] == 7
    with pytest.raises(TypeError):
        only(ws, template("?", object()))


def test_named_function_arguments(ws):
    assert only(ws, func("left", "'s'", 1))[1] == "y"
    assert only(ws, func("coalesce", "'s'", "none"))[2] == "none"
    assert only(ws, func("coalesce", None, "'b'"))[0] == 2
    assert only(ws, func("year", dt.datetime(2001, 1, 1)))[0] == 2001
    with pytest.raises(TypeError, match="unsupported argument"):
        func("left", ["s"]).build(ws.query("nums").scope)


def test_registered_function_is_reachable(ws, spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN x * 2")
    assert only(ws, func("twice", "'b'"))[:2] == [4, 4]


def test_date_times_are_wall_clock_times(ws, spark):
    moment = dt.datetime(2020, 3, 29, 2, 30)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert only(ws, literal(moment))[0] == moment
        times = ws.spark.sql("SELECT timestamp_ntz'2020-03-29 02:30:00' AS t")
        assert ws.query(times).filter(eq("t", moment)).count_rows() == 1
        assert ws.query(times).filter(in_("t", [moment])).count_rows() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clauses_accumulate(ws):
    q = ws.query("nums").filter(gt("id", 1)).filter(gt("b", 1))
    assert q.count_rows() == 3
    q = ws.query("nums").group("someA").group("b").columns("someA", "b").rows("n")
    assert rows(q.having(gt(count("id"), 1)).having(gt("someA", 0)).frame()) == [(7, 2, 2)]
    q = ws.query("nums").desc("b").asc("id").columns("id")
    assert q.list() == [(4,), (1,), (2,), (6,), (5,), (3,)]


def test_group_without_columns_and_errors(ws):
    assert rows(ws.query("nums").group("s").having(gt(count("id"), 1)).frame()) == [("x",)]
    with pytest.raises(ValueError, match="having needs a group"):
        ws.query("nums").having(gt("b", 1)).frame()


def test_null_order(ws):
    q = ws.query("nums").columns("id")
    assert q.asc("someA", nulls="last").desc("id").list()[-1] == (4,)
    assert q.asc("someA", nulls="first").list()[0] == (4,)


def test_distinct_and_aggregates(ws):
    q = ws.query("nums")
    assert rows(q.distinct("someA", "a").column("b").frame()) == [
        (-7, 2), (5, 0), (7, 2), (2147483647, 1), (None, 3),
    ]
    one = q.column(count("someA", True), "n").column(sum_("b", True), "s").column(avg("b", True), "m")
    assert one.first() == (4, 6, 1.5)
    assert q.max("b", "m").one() == 3
    assert q.column(max_(multiply("b", 2)), "m").first(as_dict=True) == {"m": 6}
    assert q.filter(gt("id", 100)).sum("b", "s").one() is None
    assert list(q.columns("id").asc("id").iterator())[:2] == [(1,), (2,)]


@pytest.mark.parametrize("bounds", [(0,), (2,), (0, 3), (2, 3), (5, 10), (9, 2), (3, 0)])
@pytest.mark.parametrize("deep", [False, True])
def test_pages(ws, bounds, deep, monkeypatch):
    if deep:
        monkeypatch.setattr("tablewright.operators.paging.ONE_TASK", -1)
    offset, n = bounds if len(bounds) == 2 else (0, bounds[0])
    want = [1, 2, 3, 4, 5, 6][offset : offset + n]
    got = ws.query("nums").columns("id").asc("id").limit(*bounds).frame()
    assert [r[0] for r in rows(got)] == want
    grouped = ws.query("nums").group("id").columns("id").rows("n").asc("id").limit(*bounds)
    assert [r[0] for r in rows(grouped.frame())] == want
    with pytest.raises(ValueError):
        ws.query("nums").limit(-1, 5)


def test_set_operations(ws, spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, None)], "a int, b string")
    b = spark.createDataFrame([(None, None), (1, "x"), (3, "z"), (3, "z")], "c int, d string")
    qa, qb = ws.query(a), ws.query(b)
    assert rows(qa.union(qb).frame()) == [(1, "x"), (2, None), (3, "z"), (None, None)]
    assert qa.union_all(qb).count_rows() == 8
    assert rows(qa.intersect(qb).frame()) == [(1, "x"), (None, None)]
    assert rows(qa.minus(qb).frame()) == [(2, None)]
    assert rows(qb.minus(qa).frame()) == [(3, "z")]
    assert rows(qa.union(qb).minus(qa.intersect(qb)).filter(gt("a", 2)).frame()) == [(3, "z")]


def test_raw_text(ws):
    assert ws.query("nums").filter(text("someA", "> 5 and b < 2")).count_rows() == 1
    assert ws.query("nums").filter(raw("this.b in (0, 3)")).count_rows() == 2
    with pytest.raises(ValueError, match="unknown operator"):
        op("b", "; drop", 1)


def test_examples(ws, spark):
    spec = ws.spec("nums")
    like_one = by_example(spec, {"someA": 7, "b": 0}, selector="NON_NULL_OR_ZERO")
    assert ws.query("nums").filter(like_one).count_rows() == 2
    assert ws.query("nums").filter(by_example(spec, {"someA": 7, "s": "x"})).count_rows() == 2
    by_key = by_example(spec, {"id": 3, "someA": 1000})
    assert rows(ws.query("nums").filter(by_key).columns("id").frame()) == [(3,)]
    everything = by_example(spec, {"id": None, "someA": 5, "b": 0}, selector="ALL")
    assert ws.query("nums").filter(everything).count_rows() == 0
    without = by_example(spec, {"someA": 7, "s": "q"}, exclude=["s"])
    assert ws.query("nums").filter(without).count_rows() == 2
    with pytest.raises(ValueError, match="identity"):
        by_identity(spec, {"id": None})
    frame = spark.createDataFrame([(7, None), (None, 0), (7, None)], "someA int, b int")
    assert rows(ws.by_examples("nums", frame).columns("id").frame()) == [(1,), (3,), (6,)]
    anything = spark.createDataFrame([(None, None)], "someA int, b int")
    assert ws.by_examples("nums", anything).count_rows() == 6
    assert ws.by_examples("nums", frame.limit(0)).count_rows() == 0


SELECTORS = {
    "NON_NULL": lambda e, r: e is None or e == r,
    "NON_NULL_OR_ZERO": lambda e, r: e in (None, 0) or e == r,
    "ALL": lambda e, r: e == r,
}


@pytest.mark.parametrize("selector", SELECTORS)
def test_frames_of_examples(small, spark, selector):
    import itertools
    import random

    from tablewright.schema import Column, TableSpec

    spec = TableSpec("t", tuple(Column(c, "INTEGER") for c in "iabc"))
    rng = random.Random(3)
    data = [(i, *[rng.choice([None, 0, 1, 2]) for _ in "abc"]) for i in range(60)] + [(1, 1, 1, 1)] * 2
    every = list(itertools.product([None, 0, 1], repeat=3))
    for examples in (rng.sample(every, 4), [(None, 1, 2), (1, None, None), (1, 1, 1), (1, 1, 1)], [(None,) * 3], []):
        frame = spark.createDataFrame(examples, "a int, b int, c int")
        found = small({spec: data}).by_examples("t", frame, selector=selector)
        fits = SELECTORS[selector]
        want = [r for r in data if any(all(fits(e, v) for e, v in zip(x, r[1:], strict=True)) for x in examples)]
        assert rows(found.frame()) == sorted(want, key=lambda r: tuple((v is None, v or 0) for v in r))
    plan = found.frame()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 1
    with pytest.raises(ValueError, match="selector"):
        small({spec: data}).by_examples("t", frame, selector="SOME")


def test_get_and_named(ws):
    assert ws.get("nums", 3).first()["b"] == 0
    assert ws.get("nums", {"id": 99}).first() is None
    ws.query("nums").filter(eq("b", 2)).cache("twos")
    assert ws.named("twos").count_rows() == 3
    kept = ws.query("nums").cache_as("all")
    assert kept.storageLevel.useMemory and ws.cached("all", None) is kept
    ws.evict("all")
    assert not kept.storageLevel.useMemory


def test_scalar_with_several_rows_is_an_error(ws):
    with pytest.raises(Exception, match="(?i)more than one row"):
        ws.query("nums").filter(gt("b", ws.query("nums").columns("b"))).frame().collect()


def test_sql_parameters(ws):
    assert ws.sql("SELECT count(*) FROM nums WHERE b = ?", [2]).first()[0] == 3
    assert ws.sql("SELECT count(*) FROM nums WHERE s = :s", {"s": "y'z"}).first()[0] == 1
