"""Choices where a query builder can easily mean something else than it says."""

import random

import duckdb
import pytest
from conftest import rows

from tablewright.functions import (
    add,
    and_,
    eq,
    eq_property,
    gt,
    lt_property,
    multiply,
    or_,
    pk,
)
from tablewright.operators import subqueries as sub
from tablewright.schema import Column, ForeignKey, TableSpec

ALBUM = TableSpec("album", (Column("id", "INTEGER"), Column("name", "VARCHAR")), ("id",))
IMAGE = TableSpec(
    "image",
    (
        Column("id", "INTEGER"),
        Column("albumId", "INTEGER"),
        Column("coverOf", "INTEGER"),
        Column("ownerId", "INTEGER"),
        Column("score", "DOUBLE"),
    ),
    ("id",),
    foreign_keys=(
        ForeignKey(("albumId",), "album", ("id",)),
        ForeignKey(("ownerId",), "owner", ("id",)),
    ),
)
OWNER = TableSpec("owner", (Column("id", "INTEGER"), Column("name", "VARCHAR")), ("id",))


@pytest.fixture
def ws(small):
    return small(
        {
            ALBUM: [(1, "a"), (2, "b"), (3, None)],
            IMAGE: [(1, 1, 1, 7, 5.0), (2, 1, None, 8, 3.0), (3, 2, 2, None, None), (4, None, 1, 7, 1.0)],
            OWNER: [(7, "x"), (8, "y")],
        }
    )


def test_conditions_group_as_written(ws):
    q = ws.query("image")
    both = or_(eq("id", 1), eq("id", 2)).and_(eq("ownerId", 8))
    assert rows(q.filter(both).columns("id").frame()) == [(2,)]
    assert q.filter(eq("id", 1)).column(multiply(add("id", 2), 10), "v").one() == 30


def test_where_applies_after_joins(ws):
    q = ws.query("album", "a").left_join("image", "i", [("a.id", "i.albumId")])
    assert q.filter(gt("i.score", 4)).count_rows() == 1
    before = ws.query("album", "a").filter(gt("a.id", 1))
    assert before.left_join("image", "i", [("a.id", "i.albumId")]).count_rows() == 2


def test_rows_counts_rows(ws):
    q = ws.query("album", "a").left_join("image", "i", [("a.id", "i.albumId")])
    assert q.rows("n").rows("images", "i").first() == (4, 3)
    unkeyed = ws.query("album", "a").left_join(
        ws.query("image").columns("albumId", "score"), "i", [("a.id", "i.albumId")]
    )
    assert unkeyed.rows("images", "i").one() == 3


def test_first_table_stays_the_root(ws):
    q = ws.query("album", "a").from_("image", "i").filter(eq_property("id", "i.albumId"))
    assert q.frame().columns == ["id", "name"]
    assert rows(q.columns("id").frame()) == [(1,), (1,), (2,)]
    assert rows(q.column(pk("i"), "image").frame()) == [(1,), (2,), (3,)]


def test_relate_uses_only_keys_to_that_table(ws):
    q = ws.query("image", "i").relate("album", "a").column("i.id", "image").column("a.name")
    assert rows(q.frame()) == [(1, "a"), (2, "a"), (3, "b")]
    outer = ws.query("image", "i").relate("album", "a", "left").relate("owner", "o", "left")
    named = outer.column("i.id", "image").column("a.name", "album").column("o.name", "owner")
    assert rows(named.frame()) == [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "x")]
    with pytest.raises(ValueError, match="no foreign key"):
        ws.query("album").relate("image", "i")


def test_cross_join_with_a_condition(ws):
    on = and_(eq_property(add("a.id", 5), "o.id"), lt_property("a.id", "o.id"))
    q = ws.query("album", "a").cross_join("owner", "o", on)
    assert q.count_rows() == 2
    with pytest.raises(ValueError, match="equality"):
        ws.query("album", "a").cross_join("owner", "o", lt_property("a.id", "a.name"))


def test_outer_and_derived_aliases(ws):
    inner = ws.query("image", "i").filter(and_(eq_property("albumId", "a.id"), gt("score", 4)))
    assert rows(ws.query("album", "a").filter(sub.exists(inner)).columns("id").frame()) == [(1,)]
    related = ws.query("image", "i").relate_outer("album", "a")
    unused = ws.query("album", "a").filter(sub.not_exists(related)).columns("id")
    assert rows(unused.frame()) == [(3,)]
    derived = ws.query(ws.query("image", "inner").columns("albumId", "score"), "d")
    assert derived.filter(gt("d.score", 2)).count_rows() == 2
    nested = ws.query(derived.filter(gt("score", 2)), "e").columns("e.albumId")
    found = ws.query("album", "inner").filter(sub.in_query("id", nested)).columns("id")
    assert rows(found.frame()) == [(1,)]


def test_subqueries_in_larger_conditions(ws):
    covers = ws.query("image").columns("coverOf")
    scored = ws.query("image").filter(gt("score", 2)).columns("albumId")
    either = or_(sub.in_query("id", covers), eq("name", "zzz"), sub.in_query("id", scored))
    assert rows(ws.query("album").filter(either).columns("id").frame()) == [(1,), (2,)]
    neither = ~either
    # the set of covers holds a NULL, so no row is certainly outside of it
    assert rows(ws.query("album").filter(neither).columns("id").frame()) == []
    plan = ws.update("album").filter(either).set("name", "hit").plan()
    assert rows(plan.frame("album")) == [(1, "hit"), (2, "hit"), (3, None)]
    assert plan.affected("album").columns == ["id", "name"]
    plan = ws.delete("album").filter(either).plan()
    assert rows(plan.frame("album")) == [(3, None)]
    assert plan.frame("album").columns == ["id", "name"]


def test_random_frames_against_sql(small):
    """Filters, outer joins, grouping and set operations on random rows with many NULLs."""
    rng = random.Random(7)

    def table(n):
        return [
            (i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 1.0, 2.0, 5.0])) for i in range(n)
        ]

    columns = (Column("id", "INTEGER"), Column("k", "INTEGER"), Column("v", "DOUBLE"))
    a, b = TableSpec("a", columns), TableSpec("b", columns)
    data = {a: table(40), b: table(30)}
    ws = small(data)
    con = duckdb.connect()
    for spec, made in data.items():
        con.execute(f"CREATE TABLE {spec.name} (id INTEGER, k INTEGER, v DOUBLE)")
        con.executemany(f"INSERT INTO {spec.name} VALUES (?, ?, ?)", made)

    def same(query, sql):
        want = sorted(
            con.execute(sql).fetchall(),
            key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
        )
        assert rows(query.frame()) == want

    qa, qb = ws.query("a").columns("k", "v"), ws.query("b").columns("k", "v")
    same(qa.union(qb), "SELECT k, v FROM a UNION SELECT k, v FROM b")
    same(qa.intersect(qb), "SELECT k, v FROM a INTERSECT SELECT k, v FROM b")
    same(qa.minus(qb), "SELECT k, v FROM a EXCEPT SELECT k, v FROM b")
    full = ws.query("a", "x").full_join("b", "y", [("x.k", "y.k"), lt_property("x.v", "y.v")])
    same(
        full.column("x.id", "i").column("y.id", "j"),
        "SELECT x.id, y.id FROM a x FULL JOIN b y ON x.k = y.k AND x.v < y.v",
    )
    grouped = ws.query("a").group("k").columns("k").sum("v", "s", distinct=True).count("v", "n")
    same(
        grouped.having(gt(add("k", 0), 1)),
        "SELECT k, sum(DISTINCT v), count(v) FROM a GROUP BY k HAVING k > 1",
    )
    joined = ws.query("b", "b").left_join(grouped, "g", [("b.k", "g.k")])
    same(
        joined.column("b.id", "id").column("g.n", "n"),
        "SELECT b.id, g.n FROM b LEFT JOIN (SELECT k, count(v) n FROM a GROUP BY k) g ON b.k = g.k",
    )
    for text, condition in (
        ("k IN (SELECT k FROM b WHERE v > 1)", sub.in_query("k", qb_keys := ws.query("b").filter(gt("v", 1)).columns("k"))),
        ("k NOT IN (SELECT k FROM b WHERE v > 1)", sub.not_in_query("k", qb_keys)),
        ("NOT (k IN (SELECT k FROM b WHERE v > 1) AND v > 1)", ~and_(sub.in_query("k", qb_keys), gt("v", 1))),
        ("v >= ALL (SELECT v FROM b WHERE v IS NOT NULL)", sub.gte_all("v", ws.query("b").filter(gt("v", 0)).columns("v"))),
    ):
        same(ws.query("a").filter(condition).columns("id"), f"SELECT id FROM a WHERE {text}")
