"""Inserts, updates, deletes, cascades and foreign-key actions on small tables."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    eq,
    eq_property,
    field,
    gt,
    is_null,
    lt,
    raw,
)
from tablewright.operators.cascade import ForeignKeyViolation
from tablewright.operators.evolve import ensure
from tablewright.operators.generators import Identity, IdSequence
from tablewright.operators.subqueries import exists, in_query
from tablewright.schema import Catalog, Column, ForeignKey, TableSpec
from tablewright.workspace import Workspace

ARTICLE = TableSpec(
    "article",
    (
        Column("id", "INTEGER", auto_increment=True),
        Column("author", "VARCHAR", length=255),
        Column("title", "VARCHAR", nullable=False),
        Column("score", "FLOAT"),
        Column("lastModified", "TIMESTAMP", generator="now"),
        Column("guid", "VARCHAR", generator="guid"),
        Column("price", "DECIMAL", precision=10, scale=2, default=Decimal("1.50")),
    ),
    primary_key=("id",),
)
ORDERS = TableSpec(
    "ord",
    (Column("id", "INTEGER"), Column("cust", "INTEGER"), Column("total", "DOUBLE")),
    primary_key=("id",),
)
CUSTOMER = TableSpec(
    "cust", (Column("id", "INTEGER"), Column("name", "VARCHAR"), Column("bal", "DOUBLE")), ("id",)
)
ORDER_ROWS = [(1, 1, 5.0), (2, 1, 8.0), (3, 2, None), (4, None, 9.0), (5, 7, 1.0)]
CUSTOMER_ROWS = [(1, "a", 1.0), (2, "b", None), (3, None, 3.0)]


@pytest.fixture
def tables(spark, tmp_path):
    def build(*specs):
        ws = Workspace.over_tables(spark, Catalog(*specs), "db_" + tmp_path.name, str(tmp_path))
        for spec in specs:
            ws.store.drop(spec.name)
            ws.store.create(spec.name, spec.struct(physical=True))
        return ws

    return build


# ---- inserts -------------------------------------------------------------------------------


def test_insert_fills_and_checks(tables):
    ws = tables(ARTICLE)
    keys = ws.save("article", {"author": "Jerry", "title": "论军事", "score": 58.0})
    assert rows(keys) == [(1,)]
    n = (
        ws.insert("article")
        .values([{"title": "体育", "price": Decimal("10.801")}, {"title": "b", "id": 77}])
        .values({"title": "c", "price": Decimal("100.209"), "score": 180.0}, exclude=["score"])
        .execute()
    )
    assert n == 3
    stored = ws.table("article").orderBy("id").collect()
    assert [r.id for r in stored] == [1, 2, 3, 4]
    assert sorted(r.price for r in stored) == [
        Decimal("1.50"), Decimal("1.50"), Decimal("10.80"), Decimal("100.21"),
    ]
    assert len({r.guid for r in stored}) == 4 and all(r.lastModified for r in stored)
    assert [r.score for r in stored if r.title == "c"] == [None]
    with pytest.raises(Exception, match="must not be null"):
        ws.insert("article").values({"author": "x"}).execute()
    assert ws.table("article").count() == 4


def test_batch(tables):
    ws = tables(ARTICLE)
    batch = ws.insert("article").batch(flush_size=2)
    for i in range(5):
        batch.push({"title": f"t{i}"})
    assert batch.inserted == 4
    assert batch.execute() == 5
    assert rows(ws.table("article").select("id")) == [(i,) for i in range(1, 6)]


def test_generated_ids_go_on(tables):
    spec = TableSpec(
        "gen",
        (
            Column("a", "BIGINT", generator=Identity(start=10, interval=5)),
            Column("b", "BIGINT", generator=IdSequence(start_with=100, increment_by=-1, min_value=0, cache=1)),
            Column("v", "VARCHAR"),
        ),
    )
    ws = tables(spec)
    ws.insert("gen").values([{"v": "x"}, {"v": "y"}]).in_order(F.col("v")).execute()
    ws.insert("gen").values([{"v": "z"}, {"v": "given", "a": 1}]).in_order(F.col("v")).execute()
    got = {r.v: (r.a, r.b) for r in ws.table("gen").collect()}
    assert got == {"x": (10, 100), "y": (15, 99), "given": (1, 98), "z": (20, 97)}


def test_insert_select_by_position(tables):
    ws = tables(ARTICLE, CUSTOMER)
    ws.insert("cust").values([{"id": i, "name": f"n{i}"} for i in range(3)]).execute()
    source = ws.query("cust").filter(gt("id", 0)).column("name")
    assert ws.insert("article").values_from(source, ["title"]).execute() == 2
    assert rows(ws.table("article").select("title")) == [("n1",), ("n2",)]
    assert ws.query("cust").column("id").column("name").limit(1, 5).into("cust") == 2
    assert ws.query("cust").create_as("copy") == 5
    with pytest.raises(ValueError, match="exists"):
        ws.query("cust").create_as("copy")


# ---- updates -------------------------------------------------------------------------------


def test_update(small):
    ws = small({ORDERS: ORDER_ROWS, CUSTOMER: CUSTOMER_ROWS})
    plan = (
        ws.update("ord")
        .filter(gt("total", 4))
        .filter(gt("id", 1))
        .set("total", add("total", 1))
        .set_property("cust", "id")
        .plan()
    )
    assert rows(plan.frame("ord")) == [
        (1, 1, 5.0), (2, 2, 9.0), (3, 2, None), (4, 4, 10.0), (5, 7, 1.0),
    ]
    assert plan.affected("ord").count() == 2
    swap = ws.update("ord").set("id", field("cust")).set("cust", field("id")).plan()
    assert rows(swap.frame("ord").where("cust < 3")) == [(1, 1, 5.0), (1, 2, 8.0)]


def test_update_with_subqueries(small):
    ws = small({ORDERS: ORDER_ROWS, CUSTOMER: CUSTOMER_ROWS})
    high = ws.query("cust").max("bal", "m")
    plan = ws.update("ord").filter(is_null("total")).set("total", high).plan()
    assert rows(plan.frame("ord").where("id = 3")) == [(3, 2, 3.0)]
    known = ws.query("cust").columns("id")
    plan = ws.update("ord").filter(~in_query("cust", known)).set("total", 0).plan()
    assert rows(plan.affected("ord").select("id")) == [(5,)]
    assert rows(plan.frame("ord").where("total = 0").select("id")) == [(5,)]
    plan = ws.update("ord").set_from("total", ws.query("cust"), [("cust", "id")], "bal").plan()
    assert [r[2] for r in rows(plan.frame("ord"))] == [1.0, 1.0, None, None, None]
    several = ws.query("ord").column("cust", "k").column("total", "v")
    plan = ws.update("cust").set_from("bal", several, [("id", "k")], "v")
    with pytest.raises(Exception, match="more than one value"):
        plan.plan().frame("cust").collect()
    plan = plan.filter(eq("id", 2)).plan()
    assert rows(plan.frame("cust")) == CUSTOMER_ROWS


def test_update_by_key(small, spark):
    ws = small({CUSTOMER: CUSTOMER_ROWS})
    changes = spark.createDataFrame(
        [(1, None, 0.0), (2, "B", 7.0), (9, "z", 1.0)], "id int, name string, bal double"
    )
    plan = ws.update_by_key("cust", changes)
    assert rows(plan.frame("cust")) == [(1, "a", 0.0), (2, "B", 7.0), (3, None, 3.0)]
    assert plan.affected("cust").count() == 2
    plan = ws.update_by_key("cust", changes, selector="ALL")
    assert rows(plan.frame("cust"))[0] == (1, None, 0.0)
    plan = ws.update_by_key("cust", changes, selector="NON_NULL_OR_ZERO")
    assert rows(plan.frame("cust"))[0] == (1, "a", 1.0)
    plan = ws.update_by_key("cust", changes, exclude=["bal"])
    assert rows(plan.frame("cust"))[1] == (2, "B", None)
    for bad in ([(1, "x", 1.0), (1, "y", 2.0)], [(None, "x", 1.0)]):
        with pytest.raises(ValueError, match="null or repeated key"):
            ws.update_by_key("cust", spark.createDataFrame(bad, changes.schema))
    plan = ws.update_object("cust", {"id": 2, "name": "obj", "bal": None})
    assert rows(plan.frame("cust"))[1] == (2, "obj", None)


# ---- deletes -------------------------------------------------------------------------------


def test_delete_keeps_rows_where_the_condition_is_null(small):
    ws = small({ORDERS: ORDER_ROWS})
    plan = ws.delete("ord").filter(lt("total", 6)).filter(gt("cust", 1)).plan()
    assert rows(plan.frame("ord").select("id")) == [(1,), (2,), (3,), (4,)]
    assert plan.affected("ord").count() == 1
    assert ws.delete("ord").plan().frame("ord").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("where", [None, "c.bal IS NULL", "c.bal > this.total"])
def test_delete_join(small, how, where):
    import duckdb

    ws = small({ORDERS: ORDER_ROWS, CUSTOMER: CUSTOMER_ROWS})
    removal = ws.delete("ord").join("cust", "c", [("cust", "c.id")], how)
    sql = f"SELECT this.id FROM ord this {how} JOIN cust c ON this.cust = c.id"
    if where:
        removal = removal.filter(raw(where))
        sql += f" WHERE {where}"
    con = duckdb.connect()
    con.execute("CREATE TABLE ord (id INTEGER, cust INTEGER, total DOUBLE)")
    con.execute("CREATE TABLE cust (id INTEGER, name VARCHAR, bal DOUBLE)")
    con.executemany("INSERT INTO ord VALUES (?, ?, ?)", ORDER_ROWS)
    con.executemany("INSERT INTO cust VALUES (?, ?, ?)", CUSTOMER_ROWS)
    gone = {r[0] for r in con.execute(sql).fetchall()}
    plan = removal.plan()
    assert {r.id for r in plan.affected("ord").collect()} == gone - {None}
    assert {r.id for r in plan.frame("ord").collect()} == {1, 2, 3, 4, 5} - gone


def test_delete_by_exists_and_key(small, spark):
    ws = small({ORDERS: ORDER_ROWS, CUSTOMER: CUSTOMER_ROWS})
    linked = ws.query("ord", "o").filter(eq_property("cust", "c.id"))
    plan = ws.delete("cust", "c").filter(exists(linked)).plan()
    assert rows(plan.frame("cust").select("id")) == [(3,)]
    keys = spark.createDataFrame([(1,), (1,), (None,), (4,)], "id int")
    assert rows(ws.delete_by_key("ord", keys).frame("ord").select("id")) == [(2,), (3,), (5,)]
    assert ws.delete_object("cust", {"id": 2}).affected("cust").count() == 1


# ---- foreign keys --------------------------------------------------------------------------


def chain(on_delete="NO_ACTION", on_update="NO_ACTION"):
    def fk(*args):
        return ForeignKey(*args, on_delete=on_delete, on_update=on_update)

    parent = TableSpec("parent", (Column("id", "INTEGER"), Column("alt", "INTEGER")), ("id",))
    child = TableSpec(
        "child",
        (Column("id", "INTEGER"), Column("pid", "INTEGER", default=-1), Column("altPid", "INTEGER", default=-2)),
        ("id",),
        foreign_keys=(fk(("pid",), "parent", ("id",)), fk(("altPid",), "parent", ("alt",))),
    )
    grand = TableSpec(
        "grand",
        (Column("id", "INTEGER"), Column("cid", "INTEGER", default=0)),
        ("id",),
        foreign_keys=(fk(("cid",), "child", ("id",)),),
    )
    return {
        parent: [(1, 10), (2, 20), (3, None)],
        child: [(1, 1, None), (2, 2, 10), (3, None, None), (4, 2, 20), (5, 3, 20), (6, 9, 99)],
        grand: [(1, 1), (2, 1), (3, 2), (4, 3), (5, None), (6, 4)],
    }


def test_cascade_reaches_every_level(small):
    ws = small(chain())
    plan = ws.delete("parent").filter(eq("id", 1)).cascade()
    assert rows(plan.frame("parent").select("id")) == [(2,), (3,)]
    assert rows(plan.frame("child").select("id")) == [(3,), (4,), (5,), (6,)]
    assert rows(plan.frame("grand").select("id")) == [(4,), (5,), (6,)]
    assert {t: p.affected.count() for t, p in plan.parts.items()} == {
        "parent": 1, "child": 2, "grand": 3,
    }
    assert rows(ws.delete_object("parent", {"id": 1}, cascade=True).frame("grand")) == rows(
        plan.frame("grand")
    )


@pytest.mark.parametrize(("action", "values"), [("SET_NULL", (None, None)), ("SET_DEFAULT", (-1, -2))])
def test_set_actions(small, action, values):
    ws = small(chain(on_delete=action))
    plan = ws.delete("parent").filter(eq("id", 2)).with_actions()
    got = {r.id: (r.pid, r.altPid) for r in plan.frame("child").collect()}
    assert got == {
        1: (1, None), 2: (values[0], 10), 3: (None, None), 4: values, 5: (3, values[1]), 6: (9, 99),
    }
    assert "grand" not in plan.parts


def test_no_action_refuses(small):
    ws = small(chain())
    with pytest.raises(ForeignKeyViolation):
        ws.delete("parent").filter(eq("id", 2)).with_actions()
    plan = ws.delete("grand").filter(eq("id", 2)).with_actions()
    assert plan.frame("grand").count() == 5
    with pytest.raises(ForeignKeyViolation):
        ws.update_keys("parent").set("id", 50).filter(eq("id", 2)).plan()


def test_declared_cascade_is_followed(small):
    ws = small(chain(on_delete="CASCADE"))
    plan = ws.delete("parent").filter(eq("id", 2)).with_actions()
    assert rows(plan.frame("child").select("id")) == [(1,), (3,), (6,)]
    assert rows(plan.frame("grand").select("id")) == [(1,), (2,), (4,), (5,)]


def test_key_update(small):
    ws = small(chain(on_update="CASCADE"))
    plan = ws.update_keys("parent").set("id", add("id", 1)).set("alt", 77).plan()
    assert rows(plan.frame("parent")) == [(2, 77), (3, 77), (4, 77)]
    got = {r.id: (r.pid, r.altPid) for r in plan.frame("child").collect()}
    assert got == {
        1: (2, None), 2: (3, 77), 3: (None, None), 4: (3, 77), 5: (4, 77), 6: (9, 99),
    }
    ws = small(chain(on_update="SET_NULL"))
    plan = ws.update_keys("parent").set("id", 50).filter(eq("id", 2)).plan()
    assert {r.id: r.pid for r in plan.frame("child").collect()} == {
        1: 1, 2: None, 3: None, 4: None, 5: 3, 6: 9,
    }
    unchanged = ws.update_keys("parent").set("id", field("id")).plan()
    assert rows(unchanged.frame("child")) == rows(ws.table("child"))


def test_key_update_reaches_grandchildren(small):
    mid = TableSpec(
        "mid",
        (Column("code", "INTEGER"), Column("v", "INTEGER")),
        ("code",),
        foreign_keys=(ForeignKey(("code",), "top", ("code",), on_update="CASCADE"),),
    )
    low = TableSpec(
        "low",
        (Column("id", "INTEGER"), Column("code", "INTEGER")),
        ("id",),
        foreign_keys=(ForeignKey(("code",), "mid", ("code",), on_update="CASCADE"),),
    )
    top = TableSpec("top", (Column("code", "INTEGER"),), ("code",))
    ws = small({top: [(1,), (2,)], mid: [(1, 5), (2, 6)], low: [(1, 1), (2, 2), (3, 1)]})
    plan = ws.update_keys("top").set("code", 9).filter(eq("code", 1)).plan()
    assert rows(plan.frame("mid")) == [(2, 6), (9, 5)]
    assert rows(plan.frame("low")) == [(1, 9), (2, 2), (3, 9)]


def test_cascade_over_a_cycle(small):
    def looped(name, ref):
        return TableSpec(
            name,
            (Column("id", "INTEGER"), Column("ref", "INTEGER")),
            ("id",),
            foreign_keys=(ForeignKey(("ref",), ref, ("id",)),),
        )

    a, b = looped("a", "b"), looped("b", "a")
    ws = small({a: [(1, None), (2, 10), (3, 30), (4, 40)], b: [(10, 1), (20, 2), (30, 99), (40, 2)]})
    plan = ws.delete("a").filter(eq("id", 1)).cascade()
    assert rows(plan.frame("a").select("id")) == [(3,)]
    assert rows(plan.frame("b").select("id")) == [(30,)]
    tree = TableSpec(
        "tree",
        (Column("id", "INTEGER"), Column("up", "INTEGER")),
        ("id",),
        foreign_keys=(ForeignKey(("up",), "tree", ("id",)),),
    )
    ws = small({tree: [(i, i // 2 or None) for i in range(1, 40)] + [(100, 101), (101, 100)]})
    plan = ws.delete("tree").filter(eq("id", 2)).cascade()
    below, todo = set(), [2]
    while todo:
        n = todo.pop()
        below.add(n)
        todo += [c for c in (2 * n, 2 * n + 1) if c < 40]
    assert {r.id for r in plan.affected("tree").collect()} == below
    assert {r.id for r in plan.frame("tree").collect()} == {*range(1, 40), 100, 101} - below
    plan = ws.delete("tree").filter(eq("id", 100)).cascade()
    assert {r.id for r in plan.affected("tree").collect()} == {100, 101}
    with pytest.raises(ValueError, match="cycle"):
        ws.delete("tree").with_actions()


def test_a_long_chain_takes_few_rounds(small, monkeypatch):
    from tablewright.operators import cascade

    tree = TableSpec(
        "tree",
        (Column("id", "INTEGER"), Column("code", "VARCHAR"), Column("up", "VARCHAR")),
        ("id",),
        unique={"c": ("code",)},
        foreign_keys=(ForeignKey(("up",), "tree", ("code",)),),
    )
    leaf = TableSpec(
        "leaf", (Column("id", "INTEGER"), Column("tree", "INTEGER")), ("id",),
        foreign_keys=(ForeignKey(("tree",), "tree", ("id",)),),
    )
    levels = 1000
    chain = [(i, f"c{i}", f"c{i - 1}" if i else None) for i in range(levels)]
    ring = [(5000 + i, f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(6000, "alone", "nobody"), (6001, None, None)]
    ws = small({tree: chain + ring, leaf: [(1, 990), (2, 5), (3, 5001), (4, None), (5, 77777)]})
    written, settle = [], cascade.settle
    monkeypatch.setattr(cascade, "settle", lambda df, label: (written.append(label), settle(df, label))[1])
    plan = ws.delete("tree").filter(eq("id", 10)).cascade()
    assert {r.id for r in plan.frame("tree").collect()} == {*range(10), *range(5000, 5007), 6000, 6001}
    assert {r.id for r in plan.frame("leaf").collect()} == {2, 3, 4, 5}
    assert written.count("chains") <= 12


def test_a_cycle_with_several_references_goes_level_by_level(small):
    node = TableSpec(
        "node", (Column("id", "INTEGER"), Column("a", "INTEGER"), Column("b", "INTEGER")), ("id",),
        foreign_keys=(ForeignKey(("a",), "node", ("id",)), ForeignKey(("b",), "node", ("id",))),
    )
    ws = small({node: [(1, None, None), (2, 1, None), (3, None, 2), (4, 9, 9), (9, 4, None), (5, 9, 3), (6, None, None)]})
    plan = ws.delete("node").filter(eq("id", 1)).cascade()
    assert {r.id for r in plan.frame("node").collect()} == {4, 9, 6}


# ---- applying ------------------------------------------------------------------------------


def test_apply_switches_tables_and_keeps_readers(tables):
    specs = chain()
    ws = tables(*specs)
    for spec, data in specs.items():
        ws.insert(spec.name).values(
            [dict(zip(spec.props, r, strict=True)) for r in data]
        ).execute()
    before = ws.table("child").collect()
    ids = [r.id for r in before]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]
    counts = ws.apply(ws.delete("parent").filter(eq("id", 1)).cascade())
    assert counts == {"parent": 1, "child": 2, "grand": 3}
    assert rows(ws.table("child").select("id")) == [(3,), (4,), (5,), (6,)]
    assert ws.apply(ws.update("child").filter(gt("id", 4)).set("pid", 0).plan()) == {"child": 2}
    assert rows(ws.table("child").where("pid = 0").select("id")) == [(5,), (6,)]
    assert ws.insert("child").values({"id": 7}).execute() == 1
    assert ws.table("child").count() == 5


def test_failed_apply_changes_nothing(tables):
    ws = tables(ORDERS)
    ws.insert("ord").values([{"id": 1, "total": 1.0}, {"id": 2, "total": 0.0}]).execute()
    bad = ws.update("ord").set("total", raw("raise_error('stop')")).plan()
    with pytest.raises(Exception, match="stop"):
        ws.apply(bad)
    assert rows(ws.table("ord")) == [(1, None, 1.0), (2, None, 0.0)]


def test_only_touched_partitions_are_rewritten(tables):
    spec = TableSpec(
        "log",
        (
            Column("id", "INTEGER"),
            Column("theDay", "DATE"),
            Column("kind", "VARCHAR"),
            Column("v", "INTEGER"),
        ),
        ("id",),
        partition_by=("theDay", "kind"),
    )
    ws = tables()
    ws.catalog = Catalog(spec)
    ws.store.create("log", spec.struct(physical=True), ["the_day", "kind"])
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    kinds = ["a/ b=c%", "it's", None]
    data = [(i, days[i % 3], kinds[i // 3 % 3], i) for i in range(27)]
    ws.insert("log").values([dict(zip(spec.props, r, strict=True)) for r in data]).execute()

    def stored():
        return rows(ws.table("log").select(*spec.props))

    def files():
        return set(ws.table("log").select("_metadata.file_path").distinct().toPandas().file_path)

    assert stored() == data
    before = files()
    assert ws.apply(ws.update("log").filter(eq("id", 4)).set("v", -4).plan()) == {"log": 1}
    data[4] = (4, days[1], kinds[1], -4)
    assert stored() == data
    assert len(before - files()) <= len(before) / 6
    ws.apply(ws.delete("log").filter(is_null("theDay")).filter(lt("id", 12)).plan())
    data = [r for r in data if r[1] or r[0] >= 12]
    assert stored() == data
    ws.apply(ws.delete("log").filter(eq("kind", "it's")).plan())
    data = [r for r in data if r[2] != "it's"]
    assert stored() == data
    assert "kind=it" not in str(ws.spark.sql(f"SHOW PARTITIONS {ws.store.full('log')}").collect())
    ws.apply(ws.update("log").filter(gt("id", 20)).set("kind", "new").plan())
    data = [(i, d, "new" if i > 20 else k, v) for i, d, k, v in data]
    assert stored() == data
    ws.apply(ws.delete("log").filter(eq("id", -1)).plan())
    assert stored() == data
    wider = [Column("v", "BIGINT") if c.prop == "v" else c for c in spec.columns]
    ws.catalog = Catalog(replace(spec, columns=(*wider, Column("more", "INTEGER", default=1))))
    ensure(ws, "log", "UPDATE")
    assert rows(ws.table("log").select(*spec.props, "more")) == [(*r, 1) for r in data]
    ws.store.truncate("log")
    assert stored() == []
