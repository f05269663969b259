"""Constraint checks, schema differences, evolution and generated ids."""

from dataclasses import replace

from pyspark.sql import functions as F

from tablewright.functions import func, gte, lt
from tablewright.operators import checks, ids
from tablewright.operators.evolve import ensure, evolve
from tablewright.operators.generators import fill_default
from tablewright.plans.changes import scratch
from tablewright.plans.registry import query
from tablewright.schema import Catalog, Column, ForeignKey
from tablewright.workspace import Workspace


# Lineitem repeats (order, line) pairs, so this key is violated.
@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def check_pk(ws):
    return checks.check_primary_key(ws.table("lineitem"), ("l_orderkey", "l_linenumber"))


@query(
    """
    SELECT k, p_size, count(*) AS n
    FROM (SELECT nullif(p_brand, 'Brand#4') AS k, p_size FROM part) t
    WHERE k IS NOT NULL AND p_size IS NOT NULL GROUP BY k, p_size HAVING count(*) > 1
    """
)
def check_unique(ws):
    df = (
        ws.query("part")
        .column(func("nullif", "'p_brand'", "Brand#4"), "k")
        .column("p_size")
        .frame()
    )
    return checks.check_unique(df, ("k", "p_size"))


# The parent is cut to customers with a positive balance, so some orders become orphans.
@query(
    """
    SELECT o_custkey, count(*) AS n
    FROM (SELECT nullif(o_custkey, 3) AS o_custkey FROM orders) o
    WHERE o_custkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal >= 0)
    GROUP BY o_custkey
    """
)
def check_fk(ws):
    child = ws.table("orders").withColumn("o_custkey", F.nullif("o_custkey", F.lit(3)))
    parent = ws.query("customer").filter(gte("c_acctbal", 0)).frame()
    fk = ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    return checks.check_foreign_key(child, parent, fk)


@query(
    """
    SELECT * FROM
      (SELECT 'docId' AS property, count(*) FILTER (lang = 'de') AS n FROM documents UNION ALL
       SELECT 'lang', count(*) FILTER (lang = 'es') FROM documents) t WHERE n > 0
    """
)
def check_not_null(ws):
    spec = ws.spec("documents")
    columns = tuple(replace(c, nullable=c.prop not in ("lang", "source")) for c in spec.columns)
    df = ws.table("documents").select(
        F.when(F.col("lang") != "de", F.col("docId")).alias("docId"),
        "text",
        F.nullif("lang", F.lit("es")).alias("lang"),
        "source",
        "nChars",
    )
    return checks.check_not_null(df, replace(spec, columns=columns))


@query(
    """
    SELECT * FROM
      (SELECT 'text' AS property, count(*) FILTER (length(text) > 4000) AS n FROM documents UNION ALL
       SELECT 'source', count(*) FILTER (length(source) > 4) FROM documents) t WHERE n > 0
    """
)
def check_length(ws):
    limits = {"text": 4000, "lang": 2, "source": 4}
    spec = ws.spec("documents")
    columns = tuple(replace(c, length=limits.get(c.prop)) for c in spec.columns)
    return checks.check_domains(ws.table("documents"), replace(spec, columns=columns))


@query(
    """
    SELECT 'c_acctbal' AS property, count(*) FILTER (c_acctbal < 0) AS n FROM customer
    """
)
def check_unsigned(ws):
    spec = ws.spec("customer")
    columns = tuple(replace(c, unsigned=c.prop == "c_acctbal") for c in spec.columns)
    return checks.check_domains(ws.table("customer"), replace(spec, columns=columns))


# Declared against found: a new column, a wider and a narrower type, and text that is too long.
@query(
    """
    SELECT 'p_weight' AS "column", 'missing' AS problem, 'double' AS declared, '' AS found
    UNION ALL SELECT 'p_size', 'widen', 'bigint', 'int'
    UNION ALL SELECT 'p_partkey', 'type', 'int', 'bigint'
    UNION ALL SELECT 'p_name', 'length', '8', max(length(p_name))::VARCHAR FROM part
    """
)
def schema_diff(ws):
    return checks.schema_diff(ws.found("part"), _next_part(ws, p_partkey="INTEGER"))


def _next_part(ws, **types):
    spec = ws.spec("part")
    types = {"p_size": "BIGINT", **types}
    columns = [replace(c, type=types.get(c.prop, c.type)) for c in spec.columns]
    columns = [replace(c, length=8) if c.prop == "p_name" else c for c in columns]
    return replace(spec, columns=(*columns, Column("p_weight", "DOUBLE", "p_weight", default=1.5)))


@query(
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice,
           1.5::DOUBLE AS p_weight
    FROM part
    """
)
def schema_evolve(ws):
    return evolve(ws.found("part"), _next_part(ws))


@query(
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice,
           1.5::DOUBLE AS p_weight
    FROM part
    """
)
def policy_update(ws):
    """A table of an older declaration is brought up to the next one, and no row is written for it."""
    target = scratch(ws, ws.spec("part"))
    target.insert("part").values(ws.table("part")).execute()
    later = _next_part(ws)
    target = Workspace(ws.spark, Catalog(later), target.store)
    ensure(target, "part", "UPDATE")
    return target.table("part")


@query(
    """
    SELECT o_orderkey, (100 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1))::BIGINT
             AS id
    FROM orders
    """
)
def identity_ids(ws):
    df = ws.table("orders").select("o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return ids.identity_ids(df, "id", start=100, interval=5, order=order).drop("o_orderdate")


@query(
    """
    SELECT event_id, (1000 - 2 * (row_number() OVER (ORDER BY user_id, event_id) - 1))::BIGINT AS id
    FROM events
    """
)
def sequence_ids(ws):
    df = ws.table("events").select("event_id", "user_id")
    return ids.sequence_ids(
        df,
        "id",
        start_with=1000,
        increment_by=-2,
        min_value=-(10**12),
        cache=1,
        order=[F.col("user_id"), F.col("event_id")],
    ).drop("user_id")


@query(
    """
    SELECT s_name AS c_name,
           (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name) AS c_custkey
    FROM supplier WHERE s_acctbal < 5000
    """
)
def auto_increment(ws):
    fresh = ws.query("supplier").filter(lt("s_acctbal", 5000)).column("s_name", "c_name").frame()
    return ids.auto_increment(fresh, ws.table("customer"), "c_custkey", [F.col("c_name")])


@query(
    """
    SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '3-MEDIUM')
             AS o_orderpriority
    FROM orders
    """
)
def default_fill(ws):
    df = ws.table("orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority")
    )
    return fill_default(df, Column("o_orderpriority", "VARCHAR", default="3-MEDIUM"))
