"""Subqueries that name the enclosing row, and EXISTS of any query, against SQL."""

import duckdb
import pytest
from conftest import rows

from tablewright import functions
from tablewright.functions import add, and_, eq, eq_property, gt, max_, or_, outer
from tablewright.functions import rows as count_rows
from tablewright.operators import subqueries as sub
from tablewright.schema import Column, TableSpec

OUTER = TableSpec("o", (Column("id", "INTEGER"), Column("k", "INTEGER"), Column("v", "INTEGER")))
INNER = TableSpec("i", (Column("k", "INTEGER"), Column("g", "INTEGER"), Column("w", "INTEGER")))
OUTER_ROWS = [(1, 1, 5), (2, 1, None), (3, 2, 5), (4, None, 5), (5, 3, 1), (6, 4, 9), (7, 4, None), (8, 5, 7)]
SETS = {
    "plain": [(1, 1, 5), (1, 1, 6), (1, 2, 7), (2, 1, 1), (4, 3, 9), (4, 3, 9)],
    "with null": [(1, 1, 5), (1, 2, None), (2, 1, 5), (4, 1, None), (None, 1, 5), (5, 1, 7)],
    "empty": [],
}


@pytest.fixture(params=SETS)
def case(request, small):
    con = duckdb.connect()
    con.execute("CREATE TABLE o (id INT, k INT, v INT); CREATE TABLE i (k INT, g INT, w INT)")
    con.executemany("INSERT INTO o VALUES (?, ?, ?)", OUTER_ROWS)
    if SETS[request.param]:
        con.executemany("INSERT INTO i VALUES (?, ?, ?)", SETS[request.param])
    return small({OUTER: OUTER_ROWS, INNER: SETS[request.param]}), con


def check(case, condition, sql, light=False):
    """The condition alone, negated, and within others; `light` leaves the mixed forms out."""
    ws, con = case
    forms = (
        (condition, sql),
        (~condition, f"NOT ({sql})"),
        (or_(condition, eq("o.id", 8)), f"({sql}) OR o.id = 8"),
        (or_(~condition, eq("o.id", 8)), f"NOT ({sql}) OR o.id = 8"),
        (and_(condition, gt("o.id", 1)), f"({sql}) AND o.id > 1"),
    )
    for made, want in forms[:2] if light else forms:
        got = [r[0] for r in rows(ws.query("o", "o").filter(made).columns("o.id").frame())]
        assert got == sorted(r[0] for r in con.execute(f"SELECT o.id FROM o WHERE {want}").fetchall()), want


def linked(ws):
    return ws.query("i", "i").filter(eq_property("i.k", outer("o.k")))


def test_in_any_all(case):
    ws, _ = case
    values = linked(ws).columns("i.w")
    sql = "SELECT w FROM i WHERE i.k = o.k"
    check(case, sub.in_query("o.v", values), f"o.v IN ({sql})")
    check(case, sub.not_in_query("o.v", values), f"o.v NOT IN ({sql})")
    for name, symbol in (("gt", ">"), ("lte", "<=")):
        check(case, getattr(sub, f"{name}_any")("o.v", values), f"o.v {symbol} ANY ({sql})")
        check(case, getattr(sub, f"{name}_all")("o.v", values), f"o.v {symbol} ALL ({sql})")
    check(case, sub.ne_any("o.v", values), f"o.v <> ANY ({sql})")


def test_in_of_groups(case):
    ws, _ = case
    tops = linked(ws).group("i.g").column(max_("i.w"), "m").having(gt(count_rows(), 1))
    sql = "SELECT max(w) FROM i WHERE i.k = o.k GROUP BY g HAVING count(*) > 1"
    check(case, sub.in_query("o.v", tops), f"o.v IN ({sql})")
    check(case, sub.gt_any("o.v", tops), f"o.v > ANY ({sql})")


def test_exists_of_any_query(case):
    ws, con = case
    n = con.execute("SELECT count(*) FROM i").fetchone()[0]
    grouped = linked(ws).group("i.g").having(gt(count_rows(), 1))
    check(case, sub.exists(grouped), "EXISTS (SELECT g FROM i WHERE i.k = o.k GROUP BY g HAVING count(*) > 1)")
    check(case, sub.exists(linked(ws).max("i.w", "m")), "EXISTS (SELECT max(w) FROM i WHERE i.k = o.k)")
    check(case, sub.exists(linked(ws).limit(0)), "1 = 0")
    check(case, sub.exists(linked(ws).limit(3)), "EXISTS (SELECT 1 FROM i WHERE i.k = o.k)")
    check(case, sub.exists(linked(ws).limit(1, 3)), "(SELECT count(*) FROM i WHERE i.k = o.k) > 1")
    two = linked(ws).distinct("i.g").limit(1, 1)
    check(case, sub.exists(two), "(SELECT count(DISTINCT g) FROM i WHERE i.k = o.k) > 1")
    alone = ws.query("i")
    check(case, sub.exists(alone.group("g").having(gt(count_rows(), 2))),
          "EXISTS (SELECT 1 FROM i GROUP BY g HAVING count(*) > 2)")
    check(case, sub.exists(alone.limit(0)), "1 = 0")
    check(case, sub.exists(alone.filter(eq("g", 99)).max("w", "m")), "1 = 1")
    check(case, sub.exists(alone.columns("w").limit(2, 1)), f"{n} > 2")


SYMBOLS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "ne": "<>"}


@pytest.mark.parametrize("name", SYMBOLS)
def test_exists_by_one_comparison(case, name):
    ws, _ = case
    compare, symbol = getattr(functions, f"{name}_property"), SYMBOLS[name]
    alone = ws.query("i", "i").filter(compare("i.w", outer("o.v")))
    check(case, sub.exists(alone), f"EXISTS (SELECT 1 FROM i WHERE i.w {symbol} o.v)", name != "lt")
    turned = ws.query("i", "i").filter(compare("o.v", "i.w")).filter(eq("i.g", 1))
    check(case, sub.exists(turned), f"EXISTS (SELECT 1 FROM i WHERE o.v {symbol} i.w AND i.g = 1)", True)
    keyed = linked(ws).filter(compare("i.w", add("o.v", 1)))
    check(case, sub.exists(keyed), f"EXISTS (SELECT 1 FROM i WHERE i.k = o.k AND i.w {symbol} o.v + 1)", name != "ne")


def test_values_of_a_page_per_key(case):
    ws, _ = case
    for offset, count in ((0, 1), (1, 2), (0, 0)):
        sql = f"""SELECT w FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC NULLS LAST) AS n FROM i) t
                  WHERE t.k = o.k AND n > {offset} AND n <= {offset + count}"""
        page = linked(ws).columns("i.w").desc("i.w").limit(offset, count)
        check(case, sub.in_query("o.v", page), f"o.v IN ({sql})")
        check(case, sub.gt_any("o.v", page), f"o.v > ANY ({sql})", True)
        check(case, sub.lte_all("o.v", page), f"o.v <= ALL ({sql})", True)
    sql = """SELECT w FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w NULLS FIRST) AS n
             FROM (SELECT DISTINCT k, w FROM i)) t WHERE t.k = o.k AND n = 2"""
    second = linked(ws).distinct("i.w").asc("i.w").limit(1, 1)
    check(case, sub.in_query("o.v", second), f"o.v IN ({sql})")
    sql = """SELECT m FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m NULLS FIRST) AS n
             FROM (SELECT k, g, max(w) AS m FROM i GROUP BY k, g)) t WHERE t.k = o.k AND n = 1"""
    least = linked(ws).group("i.g").column(max_("i.w"), "m").asc("m").limit(1)
    check(case, sub.in_query("o.v", least), f"o.v IN ({sql})", True)


def test_an_aggregate_is_a_set_of_one_value(case):
    ws, _ = case
    for made, text in ((linked(ws).max("i.w", "m"), "max(w)"), (linked(ws).rows("n"), "count(*)"),
                       (linked(ws).filter(eq("i.g", 1)).count("i.w", "n"), "count(w) FILTER (g = 1)")):
        sql = f"SELECT {text} FROM i WHERE i.k = o.k"
        check(case, sub.in_query("o.v", made), f"o.v IN ({sql})")
        check(case, sub.gt_any("o.v", made), f"o.v > ANY ({sql})", True)
        check(case, sub.lt_all("o.v", made.limit(3)), f"o.v < ALL ({sql})", True)
        check(case, sub.ne_any("o.v", made), f"o.v <> ANY ({sql})", True)
    nothing = linked(ws).max("i.w", "m").limit(1, 1)
    check(case, sub.in_query("o.v", nothing), "1 = 0")
    check(case, sub.lt_all("o.v", nothing), "1 = 1")


def test_a_hot_key_is_reduced_before_it_meets(case):
    ws, _ = case
    page = linked(ws).columns("i.w").desc("i.w").limit(0, 2)
    df = ws.query("o", "o").filter(sub.gt_any("o.v", page)).frame()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    extremum = ws.query("i", "i").filter(functions.gt_property("i.w", outer("o.v")))
    plan = ws.query("o", "o").filter(sub.exists(extremum)).frame()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_what_cannot_be_joined_by_key_is_refused(case):
    ws, _ = case
    unequal = ws.query("i", "i").filter(gt("i.k", outer("o.k")))
    twice = unequal.filter(gt("i.g", outer("o.v")))
    for bad in (sub.exists(twice), sub.exists(unequal.limit(3)), sub.in_query("o.v", unequal.columns("i.w")),
                sub.gt_all("o.v", unequal.max("i.w", "m"))):
        with pytest.raises(ValueError):
            ws.query("o", "o").filter(bad).frame()
