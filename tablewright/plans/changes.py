"""Inserts, updates, deletes, cascades. Results are the new tables, or affected rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    and_,
    between,
    eq,
    field,
    gt,
    gte,
    is_null,
    lt,
    multiply,
    ne,
    ne_property,
    or_,
)
from tablewright.operators.query import Query
from tablewright.plans.registry import query
from tablewright.schema import Catalog, Column, TableSpec
from tablewright.session import fresh_path
from tablewright.sources.tables import Conflict
from tablewright.streaming.ingest import ingest, read_ingested
from tablewright.workspace import Workspace


def scratch(ws, *specs: TableSpec) -> Workspace:
    """New empty tables in the shared folder, next to the given ones."""
    path = fresh_path(ws.spark, "tables")
    name = "tables_" + path[-12:]
    target = Workspace.over_tables(ws.spark, Catalog(*specs), name, path)
    for spec in specs:
        by = [spec.column(p).column_name for p in spec.partition_by]
        target.store.create(spec.name, spec.struct(physical=True), by)
    return target


def with_actions(ws, table: str, props: tuple[str, ...], **actions) -> Workspace:
    """The same tables, with other actions declared on one foreign key."""
    spec = ws.spec(table)
    keys = tuple(
        replace(fk, **actions) if fk.props == props else fk for fk in spec.foreign_keys
    )
    defaults = tuple(
        replace(c, default=0) if c.prop in props else c for c in spec.columns
    )
    changed = replace(spec, foreign_keys=keys, columns=defaults)
    return Workspace(ws.spark, ws.catalog.with_spec(changed), ws.store)


NOTE = TableSpec(
    "note",
    (
        Column("docId", "BIGINT"),
        Column("lang", "VARCHAR", nullable=False, length=8),
        Column("nChars", "BIGINT"),
        Column("status", "VARCHAR", nullable=False, default="new"),
        Column("score", "DOUBLE"),
    ),
    primary_key=("docId",),
)


@query(
    """
    SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score
    FROM documents WHERE n_chars > 200
    """
)
def insert_select(ws):
    target = scratch(ws, NOTE)
    source = ws.query("documents").filter(gt("nChars", 200)).columns("docId", "lang", "nChars")
    target.insert("note").values_from(source).execute()
    return target.store.read("note")


@query(
    """
    SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents
    WHERE lang <> 'en' GROUP BY source
    """
)
def create_as(ws):
    target = scratch(ws)
    report = (
        ws.query("documents")
        .filter(ne("lang", "en"))
        .group("source")
        .column("source")
        .rows("n")
        .max("nChars", "longest")
    )
    target.store.create_as("report", report.frame())
    return target.store.read("report")


# Ids are generated, a given status wins over the default, and `score` is left out on purpose.
@query(
    """
    SELECT row_number() OVER (ORDER BY event_id) AS id, user_id,
           coalesce(CASE WHEN event_type = 'error' THEN 'bad' END, 'new') AS status,
           round(value::DECIMAL(18, 4), 1)::DECIMAL(10, 1) AS price, NULL::DOUBLE AS score
    FROM events
    """
)
def insert_rows(ws):
    sale = TableSpec(
        "sale",
        (
            Column("id", "BIGINT", auto_increment=True),
            Column("userId", "BIGINT", nullable=False),
            Column("status", "VARCHAR", default="new"),
            Column("price", "DECIMAL", precision=10, scale=1),
            Column("score", "DOUBLE"),
        ),
        primary_key=("id",),
    )
    rows = ws.table("events").select(
        F.col("user_id").alias("userId"),
        F.when(F.col("event_type") == "error", "bad").alias("status"),
        F.col("value").cast("decimal(18, 4)").alias("price"),
        F.col("value").alias("score"),
        "event_id",
    )
    target = scratch(ws, sale)
    target.insert("sale").values(rows, exclude=["score"]).in_order(F.col("event_id")).execute()
    return target.store.read("sale")


# All events arrive as a stream and are inserted batch by batch, each row once.
@query(
    """
    SELECT event_id, ts, user_id, event_type, coalesce(value, 0) AS value, props FROM events
    """
)
def batch_insert(ws):
    folder = ws.store.folder
    schema = ws.store.read("events").schema
    stream = ws.spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    path = fresh_path(ws.spark, "ingested")
    writer = ingest(stream, ws, "events", path, fresh_path(ws.spark, "progress"), 10_000)
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_ingested(ws.spark, path)


@query(
    """
    SELECT 'before' AS moment, count(*) AS n FROM documents UNION ALL SELECT 'after', 0
    """
)
def truncate(ws):
    target = scratch(ws)
    target.store.create_as("filled", ws.query("documents").column("docId", "doc_id").frame())
    count = F.count(F.lit(1)).alias("n")
    before = target.store.read("filled").agg(count).select(F.lit("before").alias("moment"), "n")
    target.store.truncate("filled")
    after = target.store.read("filled").agg(count).select(F.lit("after").alias("moment"), "n")
    return before.union(after)


@query(
    """
    SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score
    FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 10
    """
)
def page_into(ws):
    target = scratch(ws, NOTE)
    page = (
        ws.query("documents")
        .columns("docId", "lang", "nChars")
        .desc("nChars")
        .asc("docId")
        .limit(10, 30)
    )
    target.insert("note").values_from(page).execute()
    return target.store.read("note")


@query(
    """
    SELECT row_number() OVER (ORDER BY s_name) AS id FROM supplier WHERE s_acctbal > 3000
    """
)
def save_with_keys(ws):
    firm = TableSpec(
        "firm",
        (Column("id", "BIGINT", auto_increment=True), Column("name", "VARCHAR")),
        primary_key=("id",),
    )
    target = scratch(ws, firm)
    rows = ws.query("supplier").filter(gt("s_acctbal", 3000)).column("s_name", "name").frame()
    return target.insert("firm").values(rows).in_order(F.col("name")).execute_returning()


# ---- updates -------------------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END
             AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    """
)
def update_value(ws):
    return (
        ws.update("orders")
        .filter(gt("o_totalprice", 400000))
        .set("o_orderstatus", "X")
        .plan()
        .frame("orders")
    )


# Right sides read the old row: `p_retailprice` uses the size before it changes.
@query(
    """
    SELECT p_partkey, p_name, p_brand, p_type,
           CASE WHEN p_type = 'SMALL' THEN p_size + 100 ELSE p_size END AS p_size,
           round(CASE WHEN p_type = 'SMALL' THEN p_retailprice * p_size ELSE p_retailprice END, 4)
             AS p_retailprice
    FROM part
    """
)
def update_multi(ws):
    change = (
        ws.update("part")
        .filter(eq("p_type", "SMALL"))
        .set("p_size", add("p_size", 100))
        .set("p_retailprice", multiply("p_retailprice", "p_size"))
        .plan()
    )
    return change.frame("part").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query(
    """
    SELECT page_id, url, CASE WHEN url LIKE 'https%' THEN url ELSE html END AS html FROM pages
    """
)
def update_property(ws):
    return (
        ws.update("pages")
        .filter(F.col("url").startswith("https"))
        .set_property("html", "url")
        .plan()
        .frame("pages")
    )


@query(
    """
    SELECT c.c_custkey, c.c_name, c.c_nationkey,
           CASE WHEN c.c_mktsegment = 'BUILDING' THEN round(s.total, 2) ELSE c.c_acctbal END
             AS c_acctbal, c.c_mktsegment
    FROM customer c LEFT JOIN
      (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 450000
       GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey
    """
)
def update_subquery(ws):
    totals = (
        ws.query("orders")
        .filter(gt("o_totalprice", 450000))
        .group("o_custkey")
        .column("o_custkey")
        .column(F.round(F.sum("o_totalprice"), 2), "total")
    )
    return (
        ws.update("customer")
        .filter(eq("c_mktsegment", "BUILDING"))
        .set_from("c_acctbal", totals, [("c_custkey", "o_custkey")], "total")
        .plan()
        .frame("customer")
    )


@query(
    """
    SELECT s_suppkey, s_name, s_nationkey,
           CASE WHEN s_acctbal < 0 THEN (SELECT max(c_acctbal) FROM customer) ELSE s_acctbal END
             AS s_acctbal
    FROM supplier
    """
)
def update_scalar_subquery(ws):
    richest = ws.query("customer").max("c_acctbal", "v")
    return (
        ws.update("supplier")
        .filter(lt("s_acctbal", 0))
        .set("s_acctbal", richest)
        .plan()
        .frame("supplier")
    )


# Changes come from the orders: a status for every customer with one, a balance only for some.
CHANGES_SQL = """
    changes AS (
      SELECT o_custkey, 'BUYER' AS seg, CASE WHEN count(*) > 12 THEN count(*)::DOUBLE END AS bal
      FROM orders WHERE o_totalprice > 480000 OR o_orderpriority = '1-URGENT' GROUP BY o_custkey)
"""


def _changes(ws):
    return (
        ws.table("orders")
        .where("o_totalprice > 480000 or o_orderpriority = '1-URGENT'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "c_custkey",
            F.lit("BUYER").alias("c_mktsegment"),
            F.when(F.col("n") > 12, F.col("n").cast("double")).alias("c_acctbal"),
        )
    )


@query(
    f"""
    WITH {CHANGES_SQL}
    SELECT c_custkey, c_name, c_nationkey, coalesce(bal, c_acctbal) AS c_acctbal,
           coalesce(seg, c_mktsegment) AS c_mktsegment
    FROM customer LEFT JOIN changes ON c_custkey = o_custkey
    """
)
def update_by_key(ws):
    return ws.update_by_key("customer", _changes(ws)).frame("customer")


@query(
    f"""
    WITH {CHANGES_SQL}
    SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM changes)
    """
)
def update_by_key_affected(ws):
    return ws.update_by_key("customer", _changes(ws)).affected("customer").select("c_custkey")


# ---- deletes -------------------------------------------------------------------------------


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 25)")
def delete_where(ws):
    condition = and_(eq("l_returnflag", "R"), lt("l_quantity", 25))
    return ws.delete("lineitem").filter(condition).plan().frame("lineitem")


# The condition is NULL for some rows, and those rows stay.
@query(
    """
    SELECT event_id, user_id FROM events
    WHERE NOT coalesce(nullif(value, round(value)) > 50, FALSE)
    """
)
def delete_where_null(ws):
    value = F.nullif("value", F.round("value"))
    return (
        ws.delete("events").filter(value > 50).plan().frame("events").select("event_id", "user_id")
    )


@query(
    """
    SELECT * FROM documents d WHERE NOT EXISTS
      (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)
    """
)
def delete_join(ws):
    poor = ws.query("labels").filter(eq("quality", 0))
    stay = (
        ws.delete("documents", "d")
        .inner_join(poor, "l", [("d.docId", "l.doc_id")])
        .plan()
        .frame("documents")
    )
    return ws.physical("documents", stay)


@query(
    """
    SELECT doc_id AS "docId" FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    """
)
def delete_left_join(ws):
    removal = (
        ws.delete("documents", "d")
        .left_join("labels", "l", [("d.docId", "l.doc_id")])
        .filter(is_null("l.doc_id"))
    )
    return removal.plan().frame("documents").select("docId")


# Three tables in the delete: customers with an order that holds a large, discounted line.
@query(
    """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN
      (SELECT o.o_custkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
       WHERE l.l_quantity = 50 AND l.l_discount >= 0.05)
    """
)
def delete_join_chain(ws):
    removal = (
        ws.delete("customer", "c")
        .inner_join("orders", "o", [("c.c_custkey", "o.o_custkey")])
        .inner_join("lineitem", "l", [("o.o_orderkey", "l.l_orderkey")])
        .filter(eq("l.l_quantity", 50))
        .filter(gte("l.l_discount", 0.05))
    )
    return removal.plan().frame("customer").select("c_custkey")


# A row goes if another of the same source is larger, so no row meets its whole group.
@query(
    """
    SELECT doc_id AS "docId", source FROM documents d
    WHERE n_chars = (SELECT max(n_chars) FROM documents i WHERE i.source = d.source)
    """
)
def delete_join_other_rows(ws):
    largest = (
        ws.query("documents").group("source").column("source").max("nChars", "largest")
    )
    stay = (
        ws.delete("documents", "d")
        .inner_join(
            largest, "m", [("d.source", "m.source"), ne_property("d.nChars", "m.largest")]
        )
        .plan()
        .frame("documents")
    )
    return stay.select("docId", "source")


@query(
    """
    SELECT * FROM orders WHERE o_orderkey NOT IN
      (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)
    """
)
def delete_by_key(ws):
    keys = ws.query("lineitem").filter(eq("l_quantity", 50)).column("l_orderkey", "o_orderkey")
    return ws.delete_by_key("orders", keys.frame()).frame("orders")


# Deleting a region's nations takes customers, suppliers, orders and lineitems with it.
@query(
    """
    WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1),
         s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n)),
         c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)),
         o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c))
    SELECT 'nation' AS tbl, count(*) AS n_left FROM nation WHERE n_nationkey NOT IN (SELECT k FROM n)
    UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM s)
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM o)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT k FROM o) AND l_suppkey NOT IN (SELECT k FROM s)
    """
)
def cascade_delete(ws):
    change = ws.delete("nation").filter(eq("n_regionkey", 1)).cascade()
    return _row_counts(change, lambda part: part.frame, "n_left")


def _row_counts(change, pick, label):
    counts = None
    for name, part in change.parts.items():
        one = pick(part).agg(F.count(F.lit(1)).alias(label))
        one = one.select(F.lit(name).alias("tbl"), label)
        counts = one if counts is None else counts.union(one)
    return counts


@query(
    """
    SELECT * FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
                             (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
    """
)
def cascade_delete_rows(ws):
    return ws.delete("customer").filter(lt("c_acctbal", 0)).cascade().frame("lineitem")


# ---- foreign key actions -------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
                            THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice
    FROM orders
    """
)
def fk_set_null(ws):
    changed = with_actions(ws, "orders", ("o_custkey",), on_delete="SET_NULL")
    change = changed.delete("customer").filter(lt("c_acctbal", 0)).with_actions()
    return change.frame("orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
                            THEN 0 ELSE o_custkey END AS o_custkey
    FROM orders
    """
)
def fk_set_default(ws):
    changed = with_actions(ws, "orders", ("o_custkey",), on_delete="SET_DEFAULT")
    change = changed.delete("customer").filter(gt("c_acctbal", 9000)).with_actions()
    return change.frame("orders").select("o_orderkey", "o_custkey")


# Documents without a label may go: nothing refers to them, so the default action allows it.
@query(
    """
    SELECT doc_id AS "docId" FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    """
)
def fk_no_action(ws):
    removal = (
        ws.delete("documents", "d")
        .left_join("labels", "l", [("d.docId", "l.doc_id")])
        .filter(is_null("l.doc_id"))
    )
    return removal.with_actions().frame("documents").select("docId")


@query(
    """
    SELECT l.l_orderkey + CASE WHEN o.o_orderstatus = 'P' THEN 1000000000 ELSE 0 END AS l_orderkey,
           l.l_linenumber, l.l_partkey
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    """
)
def fk_update_cascade(ws):
    changed = with_actions(ws, "lineitem", ("l_orderkey",), on_update="CASCADE")
    change = (
        changed.update_keys("orders")
        .set("o_orderkey", add("o_orderkey", 1000000000))
        .filter(eq("o_orderstatus", "P"))
        .plan()
    )
    return change.frame("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


# A planned change is written, and the tables are switched to it.
@query(
    """
    SELECT doc_id, lang, n_chars, CASE WHEN lang = 'en' THEN 'read' ELSE 'new' END AS status,
           NULL::DOUBLE AS score
    FROM documents WHERE n_chars <= 2000
    """
)
def apply_changes(ws):
    target = scratch(ws, NOTE)
    target.insert("note").values_from(_notes(ws)).execute()
    target.apply(target.update("note").filter(eq("lang", "en")).set("status", "read").plan())
    target.apply(target.delete("note").filter(gt("nChars", 2000)).plan())
    return target.store.read("note")


def _notes(ws) -> Query:
    return ws.query("documents").columns("docId", "lang", "nChars")


# The same on a table partitioned by language: only the partitions with affected rows are
# written anew. Spanish is deleted as a whole, French in part, English is updated.
@query(
    """
    SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN 'read' ELSE 'new' END AS status,
           NULL::DOUBLE AS score, lang
    FROM documents WHERE lang <> 'es' AND NOT (lang = 'fr' AND n_chars > 1000)
    """
)
def apply_to_partitions(ws):
    target = scratch(ws, replace(NOTE, partition_by=("lang",)))
    target.insert("note").values_from(_notes(ws)).execute()
    target.apply(target.update("note").filter(eq("lang", "en")).set("status", "read").plan())
    long_french = and_(eq("lang", "fr"), gt("nChars", 1000))
    target.apply(target.delete("note").filter(or_(eq("lang", "es"), long_french)).plan())
    return target.store.read("note")


# Two changes planned on the same table: the second one is refused once the first is applied, and
# planned anew, so neither undoes the other.
@query(
    """
    SELECT doc_id, lang, n_chars, CASE WHEN lang = 'en' THEN 'read' ELSE 'new' END AS status,
           NULL::DOUBLE AS score
    FROM documents WHERE lang <> 'fr'
    """
)
def apply_two_plans(ws):
    target = scratch(ws, NOTE)
    target.insert("note").values_from(_notes(ws)).execute()
    update = target.update("note").filter(eq("lang", "en")).set("status", "read")
    removal = target.delete("note").filter(eq("lang", "fr"))
    first, second = update.plan(), removal.plan()
    target.apply(first)
    try:
        target.apply(second)
    except Conflict:
        target.apply(removal.plan())
    return target.store.read("note")


@query(
    """
    SELECT * FROM customer c WHERE NOT EXISTS (
      SELECT 1 FROM supplier s WHERE c.c_acctbal BETWEEN s.s_acctbal AND s.s_acctbal + 20)
    """
)
def delete_range_join(ws):
    near = between("c.c_acctbal", field("s.s_acctbal"), add("s.s_acctbal", 20))
    return ws.delete("customer", "c").inner_join("supplier", "s", near).plan().frame("customer")


PARTED = replace(NOTE, name="parted", partition_by=("lang",))


def _parted(ws) -> Workspace:
    """The documents as notes, a partition per language."""
    target = scratch(ws, PARTED)
    target.insert("parted").values_from(_notes(ws)).execute()
    return target


@query(
    "SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score FROM documents WHERE lang <> 'fr'"
)
def delete_partition(ws):
    """All rows of a partition go, and rows of other partitions are not read."""
    target = _parted(ws)
    target.apply(target.delete("parted").filter(eq("lang", "fr")).plan())
    return target.table("parted").withColumnsRenamed(PARTED.to_physical)


@query(
    """
    SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score FROM documents WHERE lang = 'de'
    """
)
def truncate_partitioned(ws):
    """Rows that come in after a truncate are the only ones."""
    target = _parted(ws)
    target.store.truncate("parted")
    german = ws.query("documents").filter(eq("lang", "de")).columns("docId", "lang", "nChars")
    target.insert("parted").values_from(german).execute()
    return target.table("parted").withColumnsRenamed(PARTED.to_physical)


@query("SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score FROM documents")
def update_none(ws):
    """A change that hits no row leaves all of them."""
    target = _parted(ws)
    target.apply(target.update("parted").filter(eq("docId", -1)).set("status", "read").plan())
    return target.table("parted").withColumnsRenamed(PARTED.to_physical)


@query("SELECT doc_id, lang, n_chars, 'new' AS status, NULL::DOUBLE AS score FROM documents")
def export_and_read(ws):
    target = scratch(ws, NOTE)
    target.insert("note").values_from(_notes(ws)).execute()
    path = fresh_path(ws.spark, "export")
    target.store.export("note", path, "orc")
    return ws.spark.read.orc(path)


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def create_table_as(ws):
    target = scratch(ws)
    kept = ws.query("documents").filter(ne("lang", "en"))
    target.store.create_as("kept", kept.column("docId", "doc_id").column("lang").frame())
    return target.store.read("kept")


STAMPED = TableSpec(
    "stamped",
    (
        Column("guid", "VARCHAR", generator="guid"),
        Column("docId", "BIGINT"),
        Column("madeAt", "TIMESTAMP", generator="now"),
    ),
    ("guid",),
)


@query("SELECT count(*) AS n, count(*) AS guids, 1::BIGINT AS times FROM documents")
def generated_values(ws):
    target = scratch(ws, STAMPED)
    target.insert("stamped").values_from(ws.query("documents").columns("docId")).execute()
    return (
        target.query("stamped")
        .rows("n")
        .count("guid", "guids", distinct=True)
        .count("madeAt", "times", distinct=True)
    )
