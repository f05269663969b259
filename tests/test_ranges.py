"""Joins without an equality, against comparing all pairs; NULLs, hot values, every kind of bound."""

import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions import add, between, eq, field, gt_property, gte_property, lt_property, lte_property
from tablewright.operators import ranges
from tablewright.schema import Column, TableSpec

A = TableSpec("a", (Column("id", "INTEGER"), Column("lo", "INTEGER"), Column("hi", "INTEGER"),
                    Column("t", "VARCHAR"), Column("d", "DATE")), ("id",))
B = TableSpec("b", (Column("id", "INTEGER"), Column("x", "INTEGER"), Column("y", "INTEGER"),
                    Column("t", "VARCHAR"), Column("d", "DATE")), ("id",))


def some(rng, i):
    x = 50 if rng.random() < 0.33 else rng.randrange(200)
    low, high = (None if rng.random() < 0.05 else x for _ in range(2))
    high = None if high is None else high + rng.randrange(-3, 9)
    day = None if rng.random() < 0.1 else date(2024, 1, 1) + timedelta(days=x)
    return (i, low, high, None if rng.random() < 0.1 else f"k{x:03}", day)


@pytest.fixture
def ws(small, monkeypatch):
    monkeypatch.setattr(ranges, "BIN", 7)
    rng = random.Random(2)
    made = small({A: [some(rng, i) for i in range(150)], B: [some(rng, i) for i in range(130)]})
    made.a, made.b = (made.table(n).collect() for n in ("a", "b"))
    return made


def le(x, y):
    return x is not None and y is not None and x <= y


def lt(x, y):
    return x is not None and y is not None and x < y


CASES = {
    "value between columns": (
        lambda: between("b.x", field("a.lo"), field("a.hi")), lambda a, b: le(a.lo, b.x) and le(b.x, a.hi)),
    "column between values": (
        lambda: between("a.lo", field("b.x"), field("b.y")), lambda a, b: le(b.x, a.lo) and le(a.lo, b.y)),
    "band": (
        lambda: [lt_property("a.lo", "b.x"), lte_property("b.x", add("a.lo", 4))],
        lambda a, b: lt(a.lo, b.x) and b.x <= a.lo + 4),
    "overlap": (
        lambda: [lte_property("a.lo", "b.y"), lte_property("b.x", "a.hi")],
        lambda a, b: le(a.lo, b.y) and le(b.x, a.hi)),
    "one comparison": (lambda: gt_property("a.lo", "b.x"), lambda a, b: lt(b.x, a.lo)),
    "turned": (lambda: gte_property("b.x", "a.hi"), lambda a, b: le(a.hi, b.x)),
    "text and more": (
        lambda: [between("b.t", field("a.t"), add("a.id", 0)), eq("b.id", 7)], lambda a, b: False),
    "days": (
        lambda: [lte_property("a.d", "b.d"), lt_property("b.id", "a.id")],
        lambda a, b: le(a.d, b.d) and b.id < a.id),
    "text": (
        lambda: [lt_property("a.t", "b.t"), lte_property("b.x", add("a.lo", 5))],
        lambda a, b: lt(a.t, b.t) and a.lo is not None and b.x is not None and b.x <= a.lo + 5),
}
CASES.pop("text and more")


@pytest.mark.parametrize("name", CASES)
def test_range_joins(ws, name):
    on, test = CASES[name]
    query = ws.query("a", "a").inner_join("b", "b", on()).columns("a.id", "b.id")
    want = sorted((a.id, b.id) for a in ws.a for b in ws.b if test(a, b))
    assert want and sorted(map(tuple, query.frame().collect())) == want


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("name", ["band", "overlap"])
def test_outer_range_joins(ws, name, how):
    on, test = CASES[name]
    query = ws.query("a", "a").join("b", "b", on(), how).column("a.id", "i").column("b.id", "j").column("b.x", "x")
    want = [(a.id, b.id, b.x) for a in ws.a for b in ws.b if test(a, b)]
    if how != "right":
        want += [(a.id, None, None) for a in ws.a if not any(test(a, b) for b in ws.b)]
    if how != "left":
        want += [(None, b.id, b.x) for b in ws.b if not any(test(a, b) for a in ws.a)]
    assert sorted(map(str, map(tuple, query.frame().collect()))) == sorted(map(str, want))


def test_no_pairs_in_the_plan_and_a_hot_bin_is_split(ws, spark):
    on, _ = CASES["value between columns"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ws.query("a", "a").inner_join("b", "b", on()).columns("a.id", "b.id").frame()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan
    keys = plan[plan.index("SortMergeJoin") :].split("]")[0]
    assert "own" in keys and "other" in keys  # the parts of a crowded bin are keys of the join


def test_range_join_after_a_join_and_in_a_chain(ws):
    query = (
        ws.query("a", "a").inner_join("b", "b", [("a.id", "b.id")])
        .inner_join("b", "c", between("c.x", field("a.lo"), field("b.x")))
        .columns("a.id", "c.id")
    )
    pairs = [(a, b) for a in ws.a for b in ws.b if a.id == b.id]
    want = sorted((a.id, c.id) for a, b in pairs for c in ws.b if le(a.lo, c.x) and le(c.x, b.x))
    assert want and sorted(map(tuple, query.frame().collect())) == want


def test_delete_by_range(ws):
    on, test = CASES["band"]
    change = ws.delete("a", "a").inner_join("b", "b", on()).plan()
    assert [r[0] for r in rows(change.frame("a"))] == [a.id for a in ws.a if not any(test(a, b) for b in ws.b)]


def test_empty_sides_and_what_is_refused(small):
    ws = small({A: [], B: [(1, 1, 1, "k", None)]})
    on, _ = CASES["value between columns"]
    assert ws.query("a", "a").inner_join("b", "b", on()).frame().count() == 0
    assert ws.query("b", "b").left_join("a", "a", on()).column("b.id").list() == [(1,)]
    with pytest.raises(ValueError, match="comparison"):
        ws.query("a", "a").inner_join("b", "b", eq("a.id", 1))


DELETES = {
    **{name: CASES[name] for name in ("value between columns", "one comparison", "turned", "overlap")},
    "inside": (lambda: between("a.lo", field("b.x"), field("b.y")), lambda a, b: le(b.x, a.lo) and le(a.lo, b.y)),
    "strictly inside": (
        lambda: [gt_property("a.lo", "b.x"), lt_property("a.lo", "b.y")],
        lambda a, b: lt(b.x, a.lo) and lt(a.lo, b.y)),
    "open below": (
        lambda: [gt_property("a.lo", "b.x"), lte_property("a.lo", add("b.x", 40))],
        lambda a, b: lt(b.x, a.lo) and a.lo <= b.x + 40),
    "open above": (
        lambda: [gte_property("a.lo", "b.x"), lt_property("a.lo", add("b.x", 1))],
        lambda a, b: a.lo is not None and a.lo == b.x),
}


@pytest.mark.parametrize("name", DELETES)
def test_delete_by_any_range(small, monkeypatch, name):
    """Few rows on the joined side, so that some rows stay; intervals that nest, touch and leave gaps."""
    monkeypatch.setattr(ranges, "BIN", 2)
    on, test = DELETES[name]
    rng, left = random.Random(3), 0
    for spread in (60, 400):
        b = [(i, x, x + rng.choice([-2, 0, 1, 5, 30]), None, None) for i in range(25) for x in [rng.randrange(spread)]]
        a = [(i, rng.choice([None, *range(spread + 40)]), i % 90, None, None) for i in range(200)]
        made = small({A: a, B: [*b, (99, None, 5, None, None), (98, 5, None, None, None)]})
        change = made.delete("a", "a").inner_join("b", "b", on()).plan()
        there = made.table("b").collect()
        want = [r.id for r in made.table("a").collect() if not any(test(r, o) for o in there)]
        assert [r[0] for r in rows(change.frame("a"))] == want
        left += len(want)
    assert left


def test_rows_with_a_partner_take_no_pairs(small):
    """A million pairs, of which a row needs one."""
    made = small({A: [(i, i % 40, 0, None, None) for i in range(1000)], B: [(i, i % 20, 60, None, None) for i in range(1000)]})
    met = made.query("a", "a").met("b", "b", between("a.lo", field("b.x"), field("b.y"))).rows_frame()
    assert 1000 <= met.count() <= 2000


def test_tasks_follow_from_the_pairs(ws, monkeypatch):
    monkeypatch.setattr(ranges, "PAIRS", 50)
    on, test = CASES["band"]
    df = ws.query("a", "a").inner_join("b", "b", on()).columns("a.id", "b.id").frame()
    pairs = sum(test(a, b) for a in ws.a for b in ws.b)
    used = df.select(F.spark_partition_id().alias("p"), "*").groupBy("p").count().collect()
    assert len(used) > 8 and df.rdd.getNumPartitions() > pairs / 50  # 8: the session's shuffle partitions
    assert max(r[1] for r in used) < pairs / 4
