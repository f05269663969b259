"""Scans, derived tables, projection and naming."""

import datetime as dt

from tablewright.functions import (
    and_,
    concat,
    count,
    eq,
    eq_property,
    func,
    gt,
    gte,
    literal,
    lt,
    multiply,
    pk,
    raw,
)
from tablewright.plans.registry import query


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_orderstatus = 'F'")
def scan_alias(ws):
    return (
        ws.query("orders", "o")
        .filter(eq("o.o_orderstatus", "F"))
        .columns("o.o_orderkey", "o.o_totalprice")
    )


@query(
    """
    SELECT d.o_custkey, round(d.spent, 2) AS spent
    FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) d
    WHERE d.spent > 3000000
    """
)
def derived_table(ws):
    spent = ws.query("orders").group("o_custkey").column("o_custkey").sum("o_totalprice", "spent")
    return (
        ws.query(spent, "d")
        .filter(gt("d.spent", 3000000))
        .column("d.o_custkey")
        .column(func("round", "'d.spent'", 2), "spent")
    )


@query(
    """
    SELECT c.c_name, n.n_name, d.orders
    FROM customer c, nation n,
         (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) d
    WHERE c.c_nationkey = n.n_nationkey AND d.o_custkey = c.c_custkey AND d.orders >= 12
    """
)
def comma_join(ws):
    per_customer = ws.query("orders").group("o_custkey").column("o_custkey").rows("orders")
    return (
        ws.query("customer", "c")
        .from_("nation", "n")
        .from_(per_customer, "d")
        .filter(
            and_(
                eq_property("c.c_nationkey", "n.n_nationkey"),
                eq_property("d.o_custkey", "c.c_custkey"),
                gte("d.orders", 12),
            )
        )
        .columns("c.c_name", "n.n_name", "d.orders")
    )


@query("SELECT p_name AS title, p_retailprice AS price FROM part WHERE p_size < 40")
def column_alias(ws):
    return (
        ws.query("part")
        .filter(lt("p_size", 40))
        .column("p_name", "title")
        .column("p_retailprice", "price")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber,
           round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag
    FROM lineitem WHERE l_linestatus = 'O'
    """
)
def column_field(ws):
    net = multiply("l_extendedprice", literal(1).subtract("l_discount"))
    return (
        ws.query("lineitem")
        .filter(eq("l_linestatus", "O"))
        .columns("l_orderkey", "l_linenumber")
        .column(func("round", net, 4), "net")
        .column(func("upper", "'l_returnflag'"), "flag")
    )


@query('SELECT doc_id AS "docId", lang, n_chars AS "nChars" FROM documents WHERE lang = \'en\'')
def columns_list(ws):
    return ws.query("documents").filter(eq("lang", "en")).columns("docId", "lang", "nChars")


@query(
    """
    SELECT doc_id AS "docId", text, lang, source, n_chars AS "nChars"
    FROM documents WHERE n_chars > 500
    """
)
def select_all(ws):
    return ws.query("documents").filter(gt("nChars", 500)).select_all()


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def select_subset(ws):
    return (
        ws.query("documents")
        .filter(eq("source", "src3"))
        .select_subset(included=["docId", "nChars"], as_property=False)
    )


@query(
    """
    SELECT c.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE n.n_name = 'NATION_3'
    """
)
def root_star(ws):
    return ws.query("customer", "c").relate("nation", "n").filter(eq("n.n_name", "NATION_3"))


@query("SELECT s_suppkey AS id, s_name FROM supplier WHERE s_acctbal > 0")
def pk_column(ws):
    return (
        ws.query("supplier", "s")
        .filter(gt("s_acctbal", 0))
        .column(pk("s"), "id")
        .column("s_name")
    )


@query(
    """
    SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
    WHERE n.n_regionkey = 1
    """
)
def qualified_col(ws):
    return (
        ws.query("supplier", "s")
        .inner_join("nation", "n", [("s.s_nationkey", "n.n_nationkey")])
        .filter(eq("n.n_regionkey", 1))
        .columns("s.s_name", "n.n_name")
    )


@query("SELECT DISTINCT p_brand AS brand, p_type FROM part WHERE p_size > 10")
def select_distinct(ws):
    return (
        ws.query("part").filter(gt("p_size", 10)).distinct("p_brand", "brand").column("p_type")
    )


@query(
    """
    SELECT n_nationkey, 7 AS num, 1.5::DOUBLE AS frac, 'it''s' AS txt,
           TIMESTAMP '1998-09-02 10:30:00' AS moment, DATE '1998-09-02' AS day,
           n_regionkey + 1 AS next_region, NULL::VARCHAR AS nothing
    FROM nation WHERE n_regionkey <> 2
    """
)
def literals(ws):
    return (
        ws.query("nation")
        .filter(raw("n_regionkey <> 2"))
        .column("n_nationkey")
        .column(literal(7), "num")
        .column(literal(1.5), "frac")
        .column(literal("it's"), "txt")
        .column(literal(dt.datetime(1998, 9, 2, 10, 30)), "moment")
        .column(literal(dt.date(1998, 9, 2)), "day")
        .column(raw("n_regionkey + 1"), "next_region")
        .column(raw("cast(NULL as string)"), "nothing")
    )


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def get_by_id(ws):
    return ws.get("orders", 77)


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 250000")
def first_scalar(ws):
    return ws.query("orders").filter(gt("o_totalprice", 250000)).column(count("o_orderkey"), "n")


@query(
    """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 100000 AND 300000
    GROUP BY o_orderpriority
    """
)
def sql_params(ws):
    return ws.sql(
        """
        SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
        WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high
        GROUP BY o_orderpriority
        """,
        {"status": "O", "low": 100000, "high": 300000},
    )


@query(
    """
    SELECT concat(p_brand, ' / ', p_name) AS shown FROM part WHERE p_size BETWEEN 5 AND 9
    """
)
def named_query(ws):
    small = ws.query("part").filter(raw("p_size BETWEEN 5 AND 9")).columns("p_brand", "p_name")
    small.cache("small parts")
    return ws.named("small parts").column(concat("p_brand", literal(" / "), "p_name"), "shown")


@query(
    """
    SELECT a.o_custkey, a.n, b.total FROM
      (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) a
      JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders
            GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey
    """
)
def cached_result(ws):
    per_customer = (
        ws.query("orders")
        .group("o_custkey")
        .column("o_custkey")
        .rows("n")
        .sum("o_totalprice", "total")
    )
    kept = per_customer.cache_as("orders per customer")
    again = per_customer.cache_as("orders per customer")
    return (
        ws.query(kept, "a")
        .inner_join(again.withColumnRenamed("o_custkey", "key"), "b", [("a.o_custkey", "b.key")])
        .filter(gt("a.n", 10))
        .columns("a.o_custkey", "a.n")
        .column(func("round", "'b.total'", 2), "total")
    )
