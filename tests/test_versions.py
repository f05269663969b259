"""Changes that meet, changes of partitioned tables, and the small repairs."""

import pytest
from conftest import rows

from tablewright.functions import eq, eq_property, gt, or_, sum_
from tablewright.functions import rows as count_rows
from tablewright.operators import subqueries as sub
from tablewright.operators.evolve import SchemaMismatch, ensure_all, validate
from tablewright.schema import Catalog, Column, ForeignKey, TableSpec
from tablewright.sources.tables import Conflict, TableStore
from tablewright.workspace import Workspace

PARENT = TableSpec("p", (Column("id", "INTEGER"), Column("name", "VARCHAR")), ("id",))
CHILD = TableSpec(
    "c",
    (Column("id", "INTEGER"), Column("pid", "INTEGER")),
    ("id",),
    foreign_keys=(ForeignKey(("pid",), "p", ("id",), on_delete="CASCADE"),),
)


@pytest.fixture
def ws(spark, tmp_path):
    made = Workspace.over_tables(spark, Catalog(CHILD, PARENT), "v_" + tmp_path.name, str(tmp_path))
    ensure_all(made, "CREATE")
    made.insert("p").values([{"id": i, "name": "n"} for i in range(4)]).execute()
    made.insert("c").values([{"id": 10 + i, "pid": i} for i in range(4)]).execute()
    yield made
    made.close()


def table(ws, name):
    return rows(ws.table(name))


def test_a_change_of_an_old_version_is_refused(ws):
    update = ws.update("p").filter(eq("id", 1)).set("name", "changed").plan()
    removal = ws.delete("p").filter(eq("id", 2)).plan()
    assert ws.apply(update) == {"p": 1}
    with pytest.raises(Conflict, match="p changed"):
        ws.apply(removal)
    assert table(ws, "p") == [(0, "n"), (1, "changed"), (2, "n"), (3, "n")]
    ws.apply(ws.delete("p").filter(eq("id", 2)).plan())
    assert table(ws, "p") == [(0, "n"), (1, "changed"), (3, "n")]


def test_an_insert_counts_as_a_change_also_from_elsewhere(spark, ws):
    removal = ws.delete("p").filter(eq("id", 2)).plan()
    other = Workspace(spark, ws.catalog, TableStore(spark, ws.store.database, ws.store.location))
    other.insert("p").values({"id": 9, "name": "new"}).execute()
    with pytest.raises(Conflict):
        ws.apply(removal)
    assert (9, "new") in table(ws, "p")


def test_a_change_of_several_tables_is_one(ws):
    cascade = ws.delete("p").filter(eq("id", 1)).cascade()
    ws.insert("c").values({"id": 20, "pid": 1}).execute()
    with pytest.raises(Conflict, match="c changed"):
        ws.apply(cascade)
    assert len(table(ws, "p")) == 4 and len(table(ws, "c")) == 5


def test_a_change_that_comes_in_while_rows_are_written(ws, monkeypatch):
    removal = ws.delete("p").filter(eq("id", 2)).plan()
    gathered, other = ws.store._gathered, ws.update("p").filter(eq("id", 1)).set("name", "new").plan()

    def meanwhile(name, df):
        monkeypatch.undo()
        ws.apply(other)
        return gathered(name, df)

    monkeypatch.setattr(ws.store, "_gathered", meanwhile)
    with pytest.raises(Conflict, match="p changed"):
        ws.apply(removal)
    assert table(ws, "p") == [(0, "n"), (1, "new"), (2, "n"), (3, "n")]


def test_an_insert_beside_a_change_is_told(ws, monkeypatch):
    change, gathered = ws.update("p").filter(eq("id", 1)).set("name", "new").plan(), ws.store._gathered

    def meanwhile(name, df):
        monkeypatch.undo()
        ws.apply(change)
        return gathered(name, df)

    monkeypatch.setattr(ws.store, "_gathered", meanwhile)
    with pytest.raises(Conflict, match="replaced while"):
        ws.insert("p").values({"id": 9, "name": "late"}).execute()


def test_two_inserts_do_not_take_the_same_ids(spark, tmp_path):
    log = TableSpec("log", (Column("id", "BIGINT", auto_increment=True), Column("v", "INTEGER")), ("id",))
    ws = Workspace.over_tables(spark, Catalog(log), "l_" + tmp_path.name, str(tmp_path))
    ensure_all(ws, "CREATE")
    ws.insert("log").values([{"v": 1}, {"v": 2}]).execute()
    early = ws.insert("log").values([{"v": 3}])
    rows_, lasts = early._numbered()
    ws.insert("log").values([{"v": 4}]).execute()
    with pytest.raises(Conflict, match="taken ids"):
        early._append(rows_, lasts)
    early.execute()
    assert table(ws, "log") == [(1, 1), (2, 2), (3, 4), (4, 3)]


# ---- partitioned tables --------------------------------------------------------------------

DAY = TableSpec(
    "day",
    (Column("id", "INTEGER"), Column("v", "INTEGER"), Column("theDay", "DATE"), Column("kind", "VARCHAR")),
    ("id",),
    partition_by=("theDay", "kind"),
)


@pytest.fixture
def days(spark, tmp_path):
    from datetime import date

    made = Workspace.over_tables(spark, Catalog(DAY), "d_" + tmp_path.name, str(tmp_path))
    ensure_all(made, "CREATE")
    made.insert("day").values([
        {"id": i, "v": i, "theDay": [date(2024, 1, 1), date(2024, 1, 2), None][i % 3], "kind": "ab"[i % 2]}
        for i in range(12)
    ]).execute()
    yield made
    made.close()


def test_a_delete_that_hits_nothing(days):
    before = table(days, "day")
    assert days.apply(days.delete("day").filter(eq("id", 99)).plan()) == {"day": 0}
    assert table(days, "day") == before


def test_an_update_that_hits_nothing(days):
    before = table(days, "day")
    assert days.apply(days.update("day").filter(eq("id", 99)).set("v", 0).plan()) == {"day": 0}
    assert days.apply(days.update("day").filter(eq("id", 99)).set("kind", "z").plan()) == {"day": 0}
    assert table(days, "day") == before


@pytest.mark.parametrize("column,value,left", [("kind", "a", 6), ("theDay", "2024-01-02", 8)])
def test_a_delete_of_whole_partitions(days, column, value, left):
    removal = days.delete("day").filter(eq(column, value)).plan()
    assert days.apply(removal) == {"day": 12 - left}
    assert days.table("day").count() == left and days.table("day").where(f"{column} = '{value}'").isEmpty()
    days.insert("day").values({"id": 50, "v": 1, "theDay": None, "kind": "a"}).execute()
    assert days.table("day").count() == left + 1


def test_a_delete_of_a_null_partition(days):
    from tablewright.functions import is_null

    assert days.apply(days.delete("day").filter(is_null("theDay")).plan()) == {"day": 4}
    assert [r[0] for r in table(days, "day")] == [0, 1, 3, 4, 6, 7, 9, 10]


def test_truncate_of_a_partitioned_table(days):
    days.store.truncate("day")
    assert table(days, "day") == []
    days.insert("day").values({"id": 50, "v": 1, "kind": "a"}).execute()
    assert table(days, "day") == [(50, 1, None, "a")]


# ---- small repairs -------------------------------------------------------------------------


def test_get_by_a_composite_key_needs_all_parts(small):
    pair = TableSpec("t", (Column("a", "INTEGER"), Column("b", "INTEGER")), ("a", "b"))
    ws = small({pair: [(1, 1), (1, 2)]})
    with pytest.raises(ValueError, match="mapping"):
        ws.get("t", 1)
    assert rows(ws.get("t", {"a": 1, "b": 2})) == [(1, 2)]


@pytest.mark.parametrize("action", ["on_delete", "on_update"])
def test_set_default_of_a_function(small, action):
    from pyspark.sql import functions as F

    parent = TableSpec("p", (Column("id", "INTEGER"),), ("id",))
    child = TableSpec(
        "c",
        (Column("id", "INTEGER"), Column("pid", "INTEGER", default=lambda: F.lit(3) + 4)),
        ("id",),
        foreign_keys=(ForeignKey(("pid",), "p", ("id",), **{action: "SET_DEFAULT"}),),
    )
    ws = small({parent: [(1,), (7,)], child: [(5, 1), (6, 7)]})
    if action == "on_delete":
        change = ws.delete("p").filter(eq("id", 1)).with_actions()
    else:
        change = ws.update_keys("p").set("id", 2).filter(eq("id", 1)).plan()
    assert rows(change.frame("c")) == [(5, 7), (6, 7)]


def test_delete_by_join_with_a_subquery_filter(small):
    ws = small({PARENT: [(1, "a"), (2, "b"), (3, "c")], CHILD: [(1, 1), (2, 2), (3, 2)]})
    busy = ws.query("c").group("pid").column("pid").having(gt(count_rows(), 1))
    removal = ws.delete("p", "p").inner_join("c", "c", [("p.id", "c.pid")])
    removal = removal.filter(or_(sub.in_query("p.id", busy), eq("p.id", 9)))
    assert rows(removal.plan().frame("p")) == [(1, "a"), (3, "c")]


def test_set_operations_on_equal_labels(small):
    ws = small({PARENT: [(1, "a"), (2, "b")], CHILD: [(1, 1), (2, 9)]})
    pairs = ws.query("c", "c").column("c.id", "v").column("c.pid", "v")
    same = ws.query("p", "p").column("p.id", "v").column("p.id", "v")
    assert rows(pairs.intersect(same).frame()) == [(1, 1)]
    assert rows(pairs.minus(same).frame()) == [(2, 9)]


def test_validate_names_every_problem(spark, tmp_path):
    declared = TableSpec("w", tuple(Column(f"c{i}", "INTEGER") for i in range(40)))
    found = TableSpec("w", (Column("other", "INTEGER"),))
    ws = Workspace.over_tables(spark, Catalog(found), "w_" + tmp_path.name, str(tmp_path))
    ensure_all(ws, "CREATE")
    ws = Workspace(spark, Catalog(declared), ws.store)
    with pytest.raises(SchemaMismatch) as error:
        validate(ws, declared)
    assert all(f"c{i}'" in str(error.value) for i in range(40))


def test_having_over_sums(small):
    ws = small({PARENT: [(1, "a")], CHILD: [(1, 1), (2, 1), (3, 2)]})
    query = ws.query("c").group("pid").column("pid").having(gt(sum_("id"), 2))
    assert rows(query.frame()) == [(1,), (2,)]
    joined = ws.query("c", "c").inner_join("p", "p", eq_property("c.pid", "p.id"))
    assert joined.count_rows() == 2
