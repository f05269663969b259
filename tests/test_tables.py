"""Tables, policies, schema checks, ids and streams."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import eq
from tablewright.operators import checks, ids
from tablewright.operators.evolve import SchemaMismatch, ensure, ensure_all, evolve
from tablewright.schema import (
    Catalog,
    Column,
    ForeignKey,
    TableSpec,
    can_widen,
    snake_case,
    spark_type,
)
from tablewright.session import settle, shared_dir
from tablewright.sources.jdbc import JdbcSource
from tablewright.streaming.ingest import ingest, read_ingested
from tablewright.workspace import Workspace

PARENT = TableSpec("p", (Column("id", "INTEGER"), Column("name", "VARCHAR", length=3)), ("id",))
CHILD = TableSpec(
    "c",
    (Column("id", "INTEGER"), Column("pid", "INTEGER")),
    ("id",),
    foreign_keys=(ForeignKey(("pid",), "p", ("id",)),),
)


@pytest.fixture
def ws(spark, tmp_path):
    catalog = Catalog(CHILD, PARENT)
    made = Workspace.over_tables(spark, catalog, "t_" + tmp_path.name, str(tmp_path))
    yield made
    made.close()


# ---- declarations --------------------------------------------------------------------------


def test_types_and_names(spark):
    assert spark_type("DECIMAL", 10, 2) == T.DecimalType(10, 2)
    assert spark_type("INTEGER", unsigned=True) == T.LongType()
    assert spark_type("BIGINT", unsigned=True) == T.DecimalType(20, 0)
    assert spark_type("timestamp") == T.TimestampNTZType()
    assert spark_type(int) == T.LongType()
    assert spark_type("array<float>") == T.ArrayType(T.FloatType())
    assert snake_case("lastModified") == "last_modified"
    assert can_widen(T.ByteType(), T.LongType()) and not can_widen(T.LongType(), T.IntegerType())
    assert can_widen(T.DecimalType(5, 2), T.DecimalType(8, 3))
    assert not can_widen(T.DecimalType(5, 2), T.DecimalType(5, 3))


def test_declaration_errors():
    with pytest.raises(ValueError, match="unknown key"):
        TableSpec("x", (Column("a", "INTEGER"),), primary_key=("b",))
    with pytest.raises(ValueError, match="primary key already"):
        TableSpec("x", (Column("a", "INTEGER"),), ("a",), unique={"u": ("a",)})
    with pytest.raises(ValueError, match="length"):
        ForeignKey(("a", "b"), "x", ("a",))
    with pytest.raises(ValueError, match="action"):
        ForeignKey(("a",), "x", ("a",), on_delete="DROP")
    assert Catalog(CHILD, PARENT).parents_first() == ["p", "c"]
    assert [f.nullable for f in PARENT.struct()] == [False, True]


# ---- tables and policies -------------------------------------------------------------------


def test_policies(ws, spark):
    with pytest.raises(SchemaMismatch, match="does not exist"):
        ensure(ws, "c")
    ensure(ws, "c", "CREATE")
    assert ws.store.exists("p") and ws.store.exists("c")
    ws.insert("p").values([{"id": 1, "name": "abc"}, {"id": 2, "name": "d"}]).execute()
    ensure_all(ws, "VALIDATE")
    longer = TableSpec(
        "p",
        (
            Column("id", "BIGINT"),
            Column("name", "VARCHAR", length=2),
            Column("extra", "VARCHAR", default="e"),
        ),
        ("id",),
    )
    ws.catalog = ws.catalog.with_spec(longer)
    with pytest.raises(SchemaMismatch) as failure:
        ensure(ws, "p", "VALIDATE")
    assert all(word in str(failure.value) for word in ("widen", "missing", "length"))
    ensure(ws, "p", "UPDATE")
    assert rows(ws.table("p")) == [(1, "abc", "e"), (2, "d", "e")]
    ws.insert("p").values({"id": 3}).execute()
    assert rows(ws.table("p"))[2] == (3, None, "e")
    ensure(ws, "p", "UPDATE")
    assert ws.table("p").count() == 3
    ensure(ws, "c", "CREATE_DROP")
    ws.close()
    assert ws.store.exists("p") and not ws.store.exists("c")
    with pytest.raises(ValueError, match="policy"):
        ensure(ws, "p", "SOMETIMES")


def _files(spark, ws, name):
    return sorted(spark.read.table(ws.store.full(name)).inputFiles())


def test_evolution_in_the_declaration_alone(ws, spark, monkeypatch):
    ensure_all(ws, "CREATE")
    ws.insert("p").values([{"id": 1, "name": "a'\\b"}, {"id": 2}]).execute()
    before = _files(spark, ws, "p")
    statements, sql = [], spark.sql
    monkeypatch.setattr(ws.store.spark, "sql", lambda text, *a, **k: (statements.append(text), sql(text, *a, **k))[1])
    more = (Column("extra", "VARCHAR", default="e'x", comment="it's new"), Column("n", "DECIMAL", precision=8, scale=2, default=1.5),
            Column("day", "DATE"))
    columns = (Column("id", "INTEGER"), Column("name", "VARCHAR", length=4, comment="the name"))
    ws.catalog = ws.catalog.with_spec(TableSpec("p", (*columns, *more), ("id",)))
    ensure(ws, "p", "UPDATE")
    assert not any(s.startswith(("DROP", "CREATE")) for s in statements)
    assert _files(spark, ws, "p") == before
    from decimal import Decimal

    assert rows(ws.table("p")) == [(1, "a'\\b", "e'x", Decimal("1.50"), None), (2, None, "e'x", Decimal("1.50"), None)]
    assert spark.table(ws.store.full("p")).schema["extra"].metadata["comment"] == "it's new"
    assert spark.table(ws.store.full("p")).schema["name"].metadata["comment"] == "the name"
    ws.insert("p").values([{"id": 3, "extra": "own"}]).execute()
    wide = TableSpec("p", (Column("id", "BIGINT"), *columns[1:], *more), ("id",))
    ws.catalog = ws.catalog.with_spec(wide)
    files = _files(spark, ws, "p")
    ensure(ws, "p", "UPDATE")
    assert _files(spark, ws, "p") == files
    ws.insert("p").values([{"id": 2**40, "extra": None}]).execute()
    assert [(r[0], r[2]) for r in rows(ws.table("p"))] == [(1, "e'x"), (2, "e'x"), (3, "own"), (2**40, "e'x")]
    ensure(ws, "p", "VALIDATE")
    ws.apply(ws.delete("p").filter(eq("id", 1)).plan())
    assert [(r[0], r[2]) for r in rows(ws.table("p"))] == [(2, "e'x"), (3, "own"), (2**40, "e'x")]


def test_evolution_that_must_write(ws, spark):
    ensure_all(ws, "CREATE")
    ws.insert("p").values([{"id": 1, "name": None}, {"id": 2, "name": "x"}]).execute()
    before = _files(spark, ws, "p")
    strict = TableSpec(
        "p", (Column("id", "INTEGER"), Column("name", "VARCHAR", nullable=False, default="?"), Column("v", "INTEGER")), ("id",)
    )
    ws.catalog = ws.catalog.with_spec(strict)
    ensure(ws, "p", "UPDATE")
    assert rows(ws.table("p")) == [(1, "?", None), (2, "x", None)]
    assert not set(_files(spark, ws, "p")) & set(before)


def test_truncate_and_export(ws, spark, tmp_path):
    ensure_all(ws, "CREATE")
    ws.insert("p").values([{"id": 1, "name": "体育"}, {"id": 2}]).execute()
    for kind in ("parquet", "json", "csv"):
        path = str(tmp_path / f"out_{kind}")
        ws.store.export("p", path, kind)
        back = spark.read.format(kind).schema(PARENT.struct()).load(path)
        assert rows(back) == [(1, "体育"), (2, None)]
    ws.store.truncate("p")
    assert ws.table("p").count() == 0 and ws.table("p").columns == ["id", "name"]


def test_evolve_refuses_and_fills(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id bigint, name string")
    narrow = TableSpec("p", (Column("id", "INTEGER"), Column("name", "VARCHAR")))
    with pytest.raises(SchemaMismatch, match="does not fit"):
        evolve(df, narrow)
    strict = TableSpec("p", (Column("id", "BIGINT"), Column("name", "VARCHAR", nullable=False)))
    with pytest.raises(Exception, match="must not be null"):
        evolve(df, strict).collect()
    filled = TableSpec(
        "p",
        (Column("name", "VARCHAR", nullable=False, default="?", comment="shown"), Column("id", "BIGINT")),
    )
    out = evolve(df.withColumn("more", F.lit(1)), filled)
    assert out.columns == ["name", "id", "more"] and rows(out) == [("?", 1, 1), ("x", 2, 1)]
    assert out.schema["name"].metadata == {"comment": "shown"}


# ---- checks --------------------------------------------------------------------------------


def test_key_checks(spark):
    df = spark.createDataFrame(
        [(1, 1), (1, 1), (1, None), (None, None), (None, None), (2, 3)], "a int, b int"
    )
    assert rows(checks.check_primary_key(df, ("a", "b"))) == [
        (1, 1, 2), (1, None, 1), (None, None, 2),
    ]
    assert rows(checks.check_unique(df, ("a", "b"))) == [(1, 1, 2)]
    parent = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    fk = ForeignKey(("a", "b"), "parent", ("x", "y"))
    assert rows(checks.check_foreign_key(df, parent, fk)) == [(2, 3, 1)]


def test_value_checks(spark):
    spec = TableSpec(
        "t",
        (
            Column("s", "VARCHAR", length=3, nullable=False),
            Column("d", "DECIMAL", precision=4, scale=1),
            Column("u", "INTEGER", unsigned=True),
            Column("b", "BINARY", length=2),
        ),
    )
    df = spark.createDataFrame(
        [("体育文章", 999.9, -1, b"abc"), (None, 1000.0, 5, b"ab"), ("abc", None, None, None)],
        "s string, d double, u int, b binary",
    )
    assert rows(checks.check_not_null(df, spec)) == [("s", 1)]
    assert rows(checks.check_domains(df, spec)) == [("b", 1), ("d", 1), ("s", 1), ("u", 1)]
    report = {(r["column"], r["problem"]) for r in checks.schema_diff(df, spec).collect()}
    assert report == {("s", "length"), ("s", "nulls"), ("d", "type"), ("u", "widen")}


# ---- ids -----------------------------------------------------------------------------------


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5000).alias("k"))
    out = ids.identity_ids(df, "n", start=5, interval=3, order=[F.col("k")])
    assert out.where(F.col("n") != 5 + 3 * F.col("k")).count() == 0
    unordered = ids.identity_ids(df, "n")
    assert rows(unordered.agg(F.min("n"), F.max("n"), F.count_distinct("n"))) == [(0, 4999, 5000)]
    assert ids.identity_ids(df.limit(0), "n").count() == 0
    with pytest.raises(Exception, match="no id left"):
        ids.identity_ids(df, "n", maximum=4998).collect()


def test_sequence_blocks(spark):
    df = spark.range(0, 1000, 1, 7)
    out = ids.sequence_ids(df, "n", start_with=1, cache=50).cache()
    assert out.select("n").distinct().count() == 1000
    assert out.agg(F.max("n")).first()[0] <= 7 * 150 and out.agg(F.min("n")).first()[0] == 1
    with pytest.raises(Exception, match="no id left"):
        ids.sequence_ids(df, "n", max_value=999, cache=1).collect()


def test_auto_increment_on_empty_table(spark):
    fresh = spark.createDataFrame([("a",), ("b",)], "name string")
    empty = spark.createDataFrame([], "id bigint, name string")
    assert rows(ids.auto_increment(fresh, empty, "id", [F.col("name")])) == [("a", 1), ("b", 2)]


# ---- session and sources -------------------------------------------------------------------


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    random = spark.range(100).withColumn("r", F.rand())
    kept = settle(random)
    assert kept.exceptAll(kept).count() == 0 and kept.inputFiles()[0].startswith("file:")
    assert shared_dir(spark) in kept.inputFiles()[0]


def test_jdbc_options():
    source = JdbcSource("jdbc:x://h/db", "a.Driver", "me", "pw")
    assert source.options("t")["dbtable"] == "t" and source.options("t")["user"] == "me"
    split = source.split_options("id", 1, 900, 8)
    assert split == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": "8",
    }


# ---- streams -------------------------------------------------------------------------------

EVENT = TableSpec(
    "event",
    (
        Column("id", "BIGINT", auto_increment=True),
        Column("eventId", "BIGINT", nullable=False),
        Column("kind", "VARCHAR", default="none"),
    ),
)


def test_stream_survives_a_failure(spark, tmp_path, monkeypatch):
    from tablewright.streaming import ingest as module

    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    data = spark.range(100).select(
        F.col("id").alias("eventId"), F.when(F.col("id") % 2 == 0, "even").alias("kind")
    )
    for i in range(5):
        data.where(F.col("eventId") % 5 == i).coalesce(1).write.mode("append").parquet(source)
    ws = Workspace(spark, Catalog(EVENT), None)
    align, calls, looked = module.align, [], []

    def failing(spec, batch, existing, **given):
        def watched():
            looked.append(1)
            return existing()

        calls.append(1)
        if len(calls) == 3:
            # the batch has written its rows, and dies before the stream notes it
            align(spec, batch, watched, **given).withColumnsRenamed(spec.to_physical).write.mode(
                "overwrite"
            ).parquet(f"{path}/batch_id=2")
            raise RuntimeError("executor lost")
        return align(spec, batch, watched, **given)

    monkeypatch.setattr(module, "align", failing)

    def run():
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = ingest(stream, ws, "event", path, progress)
        writer.trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="executor lost"):
        run()
    run()
    run()
    out = read_ingested(spark, path)
    assert out.columns == ["id", "event_id", "kind"]
    assert rows(out.select("event_id", "kind")) == [
        (i, "even" if i % 2 == 0 else "none") for i in range(100)
    ]
    assert sorted(r.id for r in out.collect()) == list(range(1, 101))
    assert looked == [1]  # only the first batch, which has none before it


def test_ids_go_on_without_a_scan(spark, tmp_path, monkeypatch):
    ws = Workspace.over_tables(spark, Catalog(EVENT), "i_" + tmp_path.name, str(tmp_path))
    ensure_all(ws, "CREATE")
    events = spark.range(10).select(F.col("id").alias("eventId"))
    ws.insert("event").values(events).execute()
    assert ws.store.last_id("event", "id") == 10
    with monkeypatch.context() as patched:
        patched.setattr(Workspace, "table", lambda *a: pytest.fail("the table was read"))
        ws.insert("event").values(events).execute()
    assert sorted(r.id for r in ws.table("event").collect()) == list(range(1, 21))
    assert ws.apply(ws.update("event").filter(eq("id", 20)).set("id", 50).plan()) == {"event": 1}
    assert ws.store.last_id("event", "id") is None  # an update may have changed it
    ws.insert("event").values(events.limit(1)).execute()
    assert ws.store.last_id("event", "id") == 51
    ws.close()


def test_scratch_goes_when_a_workspace_closes(spark, tmp_path, monkeypatch):
    folder = tmp_path / "run"
    monkeypatch.setattr("tablewright.session.run_folder", lambda spark: str(folder))
    ws = Workspace.over_tables(spark, Catalog(EVENT), "s_" + tmp_path.name, str(tmp_path / "tables"))
    settle(spark.range(3))
    assert any(folder.iterdir())
    ws.close(scratch=True)
    assert not folder.exists()
