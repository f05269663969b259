"""Three-valued logic: each condition and its negation against DuckDB, with NULLs, duplicates and
empty sets. The given tables hold no NULL, so only these tests cover it."""

import duckdb
import pytest
from conftest import rows

from tablewright.functions import (
    add,
    and_,
    between,
    count,
    eq,
    eq_property,
    false,
    gt,
    gte_property,
    in_,
    is_null,
    like,
    lte_property,
    ne,
    not_,
    op,
    or_,
    outer,
    true,
)
from tablewright.operators import subqueries as sub
from tablewright.schema import Column, TableSpec

VALS = TableSpec("vals", (Column("id", "INTEGER"), Column("k", "INTEGER"), Column("v", "DOUBLE")))
PICK = TableSpec("pick", (Column("g", "INTEGER"), Column("w", "DOUBLE")))

VALS_ROWS = [
    (1, 1, 10.0), (2, 1, 10.0), (3, 2, None), (4, None, 5.0), (5, 3, 20.0), (6, None, None),
    (7, 4, -3.0), (8, 5, 7.5),
]
SETS = {
    "plain": [(1, 10.0), (1, 7.5), (3, 20.0)],
    "single": [(1, 10.0), (2, 10.0)],
    "with null": [(1, 10.0), (2, None), (4, 7.5)],
    "single with null": [(1, 10.0), (2, None)],
    "all null": [(1, None), (None, None)],
    "empty": [],
}


def ids(con, condition):
    return sorted(r[0] for r in con.execute(f"SELECT id FROM vals WHERE {condition}").fetchall())


def duck(pick=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE vals (id INTEGER, k INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO vals VALUES (?, ?, ?)", VALS_ROWS)
    con.execute("CREATE TABLE pick (g INTEGER, w DOUBLE)")
    if pick:
        con.executemany("INSERT INTO pick VALUES (?, ?)", pick)
    return con


QUANTIFIED = {
    "v < ANY": sub.lt_any, "v <= ANY": sub.lte_any, "v > ANY": sub.gt_any, "v >= ANY": sub.gte_any,
    "v < ALL": sub.lt_all, "v <= ALL": sub.lte_all, "v > ALL": sub.gt_all, "v >= ALL": sub.gte_all,
    "v <> ANY": sub.ne_any, "v <> ALL": sub.ne_all, "v IN": sub.in_query, "v NOT IN": sub.not_in_query,
}


@pytest.mark.parametrize("kind", SETS)
def test_quantified(small, kind):
    ws = small({VALS: VALS_ROWS, PICK: SETS[kind]})
    con = duck(SETS[kind])
    for text, build in QUANTIFIED.items():
        condition = build("v", ws.query("pick").columns("w"))
        sql = f"{text} (SELECT w FROM pick)"
        for made, want in (
            (condition, sql),
            (~condition, f"NOT ({sql})"),
            (or_(condition, eq("id", 4)), f"({sql}) OR id = 4"),
            (not_(and_(condition, gt("id", 2))), f"NOT (({sql}) AND id > 2)"),
        ):
            got = rows(ws.query("vals").filter(made).columns("id").frame())
            assert [r[0] for r in got] == ids(con, want), (text, want)


@pytest.mark.parametrize("kind", SETS)
def test_exists(small, kind):
    ws = small({VALS: VALS_ROWS, PICK: SETS[kind]})
    con = duck(SETS[kind])
    picked = ws.query("pick").columns("g")
    sql = "EXISTS (SELECT 1 FROM pick WHERE g = k)"
    linked = ws.query("pick", "p").filter(eq_property("g", "t.k"))
    turned = ws.query("pick", "p").filter(and_(true(), eq_property(outer("t.k"), "p.g")))
    unequal = linked.filter(lte_property("g", "t.k")).filter(gte_property("g", "t.k"))
    for condition in (
        sub.exists(picked, on=[("k", "g")]),
        sub.exists(linked),
        sub.exists(turned),
        sub.exists(unequal),
    ):
        for made, want in (
            (condition, sql),
            (~condition, f"NOT {sql}"),
            (or_(~condition, is_null("v")), f"NOT {sql} OR v IS NULL"),
        ):
            got = rows(ws.query("vals", "t").filter(made).columns("id").frame())
            assert [r[0] for r in got] == ids(con, want), want
    empty = sub.exists(ws.query("pick").filter(gt("w", 1000)))
    assert ws.query("vals").filter(empty).count_rows() == 0
    assert ws.query("vals").filter(~empty).count_rows() == len(VALS_ROWS)


def test_same_table_inside_and_outside(small):
    ws = small({VALS: VALS_ROWS})
    inner = ws.query("vals").filter(gt("v", 8)).columns("v")
    got = rows(ws.query("vals").filter(sub.in_query("v", inner)).columns("id").frame())
    assert got == [(1,), (2,), (5,)]
    got = rows(ws.query("vals").filter(sub.not_in_query("v", inner)).columns("id").frame())
    assert got == [(4,), (7,), (8,)]


def test_correlated_aggregates(small):
    picked = [(1, 10.0), (1, 7.5), (3, 20.0), (None, 5.0), (2, None)]
    ws, con = small({VALS: VALS_ROWS, PICK: picked}), duck(picked)

    def linked():
        return ws.query("pick", "p").filter(eq_property("g", "t.k"))

    cases = [
        (eq("v", linked().max("w", "m")), "v = (SELECT max(w) FROM pick WHERE g = k)"),
        (eq("id", linked().rows("n")), "id = (SELECT count(*) FROM pick WHERE g = k)"),
        (lte_property("id", "k") & gt("k", linked().rows("n")), "id <= k AND k > (SELECT count(*) FROM pick WHERE g = k)"),
        (~gt("k", linked().count("w", "n")), "NOT (k > (SELECT count(w) FROM pick WHERE g = k))"),
        (or_(gt("v", linked().filter(gt("w", 8)).avg("w", "a")), is_null("k")), "v > (SELECT avg(w) FROM pick WHERE g = k AND w > 8) OR k IS NULL"),
        (gt("v", linked().column(add(count("w"), 6), "n")), "v > (SELECT count(w) + 6 FROM pick WHERE g = k)"),
    ]
    for condition, sql in cases:
        got = rows(ws.query("vals", "t").filter(condition).columns("id").frame())
        want = con.execute(f"SELECT id FROM vals t WHERE {sql}").fetchall()
        assert got == sorted(want), sql
    plan = ws.update("vals", "t").filter(gt("id", 2)).set("v", linked().rows("n")).plan()
    want = con.execute(
        """SELECT id, k, CASE WHEN id > 2 THEN (SELECT count(*) FROM pick WHERE g = k) ELSE v END
           FROM vals"""
    ).fetchall()
    assert sorted(r[0::2] for r in rows(plan.frame("vals"))) == sorted(r[0::2] for r in want)


CONDITIONS = [
    (lambda: eq("v", 10.0), "v = 10"),
    (lambda: ne("v", 10.0), "v <> 10"),
    (lambda: is_null("v"), "v IS NULL"),
    (lambda: between("v", 5, 10), "v BETWEEN 5 AND 10"),
    (lambda: in_("k", [1, 4]), "k IN (1, 4)"),
    (lambda: eq_property("v", "k"), "v = k"),
    (lambda: op("k", "is distinct from", 1), "k IS DISTINCT FROM 1"),
    (lambda: op("k", "<>", 1), "k <> 1"),
    (lambda: and_(eq("k", 1), gt("v", 8)), "k = 1 AND v > 8"),
    (lambda: or_(eq("k", 1), gt("v", 8)), "k = 1 OR v > 8"),
    (lambda: or_(and_(true(), is_null("k")), false()), "k IS NULL"),
    (lambda: eq("k", 1).or_(eq("k", 2)).and_(gt("id", 1)), "(k = 1 OR k = 2) AND id > 1"),
]


@pytest.mark.parametrize("i", range(len(CONDITIONS)))
def test_conditions(small, i):
    build, sql = CONDITIONS[i]
    ws, con = small({VALS: VALS_ROWS}), duck()
    for made, want in ((build(), sql), (~build(), f"NOT ({sql})")):
        got = rows(ws.query("vals").filter(made).columns("id").frame())
        assert [r[0] for r in got] == ids(con, want)


NAMES = TableSpec("names", (Column("s", "VARCHAR"),))
TEXTS = ["a%b", "a_b", "axb", "!", "it's", "体育文章", "", None, "the cat and dog", "and the",
         "thethe an and", "x\nthe\nand", "a\\b"]


@pytest.mark.parametrize(
    ("pattern", "mode", "escape"),
    [
        ("a%b", "ANY_WHERE", None), ("a_b", "START", None), ("a!%b", "ANY_WHERE", "!"),
        ("a!_b", "END", "!"), ("!!", "START", "!"), ("育", "ANY_WHERE", None), ("", "ANY_WHERE", None),
        ("the%and", "ANY_WHERE", None), ("the%the%and", "ANY_WHERE", None), ("'s", "END", None),
        ("%", "ANY_WHERE", None), ("t%e%a%d", "ANY_WHERE", None),
    ],
)
def test_like(small, pattern, mode, escape):
    ws = small({NAMES: [(t,) for t in TEXTS]})
    shape = {"START": "{}%", "END": "%{}", "ANY_WHERE": "%{}%"}[mode].format(pattern)
    con = duckdb.connect()
    con.execute("CREATE TABLE names (s VARCHAR)")
    con.executemany("INSERT INTO names VALUES (?)", [(t,) for t in TEXTS])
    suffix = f" ESCAPE '{escape}'" if escape else ""
    quoted = shape.replace("'", "''")
    for negated in (False, True):
        condition = like("s", pattern, mode, escape)
        condition = ~condition if negated else condition
        sql = f"SELECT s FROM names WHERE {'NOT ' if negated else ''}(s LIKE '{quoted}'{suffix})"
        assert rows(ws.query("names").filter(condition).frame()) == sorted(
            con.execute(sql).fetchall()
        )
