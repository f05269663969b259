"""Joins."""

from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    between,
    eq,
    eq_property,
    field,
    func,
    gt,
    gt_property,
    gte,
    is_null,
    lt,
    lt_property,
    lte_property,
    ne_property,
)
from tablewright.plans.registry import query


@query(
    """
    SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE c.c_mktsegment = 'BUILDING'
    """
)
def join_inner(ws):
    return (
        ws.query("orders", "o")
        .inner_join("customer", "c", [("o.o_custkey", "c.c_custkey")])
        .filter(eq("c.c_mktsegment", "BUILDING"))
        .columns("o.o_orderkey", "c.c_name")
    )


@query(
    """
    SELECT d.doc_id, d.lang, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.n_chars > 300
    """
)
def join_left(ws):
    return (
        ws.query("documents", "d")
        .left_join("labels", "l", [("d.docId", "l.doc_id")])
        .filter(gt("d.nChars", 300))
        .column("d.docId", "doc_id")
        .columns("d.lang", "l.quality", "l.toxic")
    )


# Orders repeat a customer, so this is the outer join that must not depend on one hot key.
@query(
    """
    SELECT c.c_custkey, o.o_orderkey FROM customer c
    LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey
    """
)
def join_left_many(ws):
    large = ws.query("orders").filter(gt("o_totalprice", 300000))
    return (
        ws.query("customer", "c")
        .left_join(large, "o", [("c.c_custkey", "o.o_custkey")])
        .columns("c.c_custkey", "o.o_orderkey")
    )


@query(
    """
    SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment
    FROM (SELECT * FROM orders WHERE o_totalprice > 350000) o
    RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
    """
)
def join_right(ws):
    large = ws.query("orders").filter(gt("o_totalprice", 350000))
    return (
        ws.query(large, "o")
        .right_join("customer", "c", [("o.o_custkey", "c.c_custkey")])
        .columns("o.o_orderkey", "c.c_custkey", "c.c_mktsegment")
    )


@query(
    """
    SELECT c.c_custkey, o.o_orderkey, o.o_totalprice
    FROM (SELECT * FROM customer WHERE c_acctbal > 3000) c
    FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey
    """
)
def join_full(ws):
    rich = ws.query("customer").filter(gt("c_acctbal", 3000))
    large = ws.query("orders").filter(gt("o_totalprice", 300000))
    return (
        ws.query(rich, "c")
        .full_join(large, "o", [("c.c_custkey", "o.o_custkey")])
        .columns("c.c_custkey", "o.o_orderkey", "o.o_totalprice")
    )


@query(
    """
    SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r
    WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'
    """
)
def join_cross(ws):
    return (
        ws.query("nation", "n")
        .cross_join("region", "r", [("n.n_regionkey", "r.r_regionkey")])
        .filter(~eq("r.r_name", "ASIA"))
        .columns("n.n_name", "r.r_name")
    )


@query(
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey
    FROM lineitem l JOIN orders o
      ON l.l_orderkey = o.o_orderkey AND l.l_shipdate < o.o_orderdate
         AND l.l_extendedprice * 4 > o.o_totalprice
    """
)
def join_theta(ws):
    price = add("l.l_extendedprice", 0).multiply(4)
    return (
        ws.query("lineitem", "l")
        .inner_join(
            "orders",
            "o",
            [
                ("l.l_orderkey", "o.o_orderkey"),
                lt_property("l.l_shipdate", "o.o_orderdate"),
                gt_property(price, "o.o_totalprice"),
            ],
        )
        .columns("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "o.o_custkey")
    )


@query(
    """
    SELECT c.c_name, s.n, round(s.total, 2) AS total FROM customer c
    JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders
          GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey
    WHERE s.n >= 8
    """
)
def join_subquery(ws):
    summary = (
        ws.query("orders")
        .group("o_custkey")
        .column("o_custkey")
        .rows("n")
        .sum("o_totalprice", "total")
    )
    return (
        ws.query("customer", "c")
        .inner_join(summary, "s", [("c.c_custkey", "s.o_custkey")])
        .filter(gte("s.n", 8))
        .columns("c.c_name", "s.n")
        .column(func("round", "'s.total'", 2), "total")
    )


@query(
    """
    SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name, c.c_name, n.n_name
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    WHERE n.n_regionkey = 3 AND p.p_size < 20
    """
)
def join_chain(ws):
    return (
        ws.query("lineitem", "l")
        .inner_join("orders", "o", [("l.l_orderkey", "o.o_orderkey")])
        .inner_join("customer", "c", [("o.o_custkey", "c.c_custkey")])
        .inner_join("nation", "n", [("c.c_nationkey", "n.n_nationkey")])
        .inner_join("part", "p", [("l.l_partkey", "p.p_partkey")])
        .inner_join("supplier", "s", [("l.l_suppkey", "s.s_suppkey")])
        .filter(eq("n.n_regionkey", 3))
        .filter(lt("p.p_size", 20))
        .columns(
            "l.l_orderkey", "l.l_linenumber", "p.p_brand", "s.s_name", "c.c_name", "n.n_name"
        )
    )


@query(
    """
    SELECT a.c_custkey AS left_key, b.c_custkey AS right_key FROM customer a
    JOIN customer b ON a.c_custkey + 1 = b.c_custkey AND a.c_nationkey <> b.c_nationkey
    """
)
def join_self(ws):
    return (
        ws.query("customer", "a")
        .inner_join(
            "customer",
            "b",
            [eq_property(add("a.c_custkey", 1), "b.c_custkey"), ne_property("a.c_nationkey", "b.c_nationkey")],
        )
        .column("a.c_custkey", "left_key")
        .column("b.c_custkey", "right_key")
    )


@query(
    """
    SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_mktsegment
    """
)
def relate_fk(ws):
    return (
        ws.query("orders", "o")
        .relate("customer", "c")
        .group("c.c_mktsegment")
        .column("c.c_mktsegment")
        .rows("n")
        .column(F.round(F.sum("o.o_totalprice"), 2), "total")
    )


@query(
    """
    SELECT l.l_returnflag, count(*) AS n FROM lineitem l
    LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 40
    WHERE p.p_partkey IS NULL GROUP BY l.l_returnflag
    """
)
def join_left_on_filter(ws):
    return (
        ws.query("lineitem", "l")
        .left_join("part", "p", [("l.l_partkey", "p.p_partkey"), gt("p.p_size", 40)])
        .filter(is_null("p.p_partkey"))
        .group("l.l_returnflag")
        .column("l.l_returnflag")
        .rows("n")
    )


@query(
    """
    SELECT c.c_mktsegment, count(*) AS n, count(o.o_orderkey) AS orders, count(l.l_orderkey) AS lines,
           count(n.n_nationkey) AS nations, count(s.s_suppkey) AS suppliers
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
    LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
    LEFT JOIN nation n ON l.l_linenumber = n.n_regionkey
    LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey
    GROUP BY c.c_mktsegment
    """
)
def join_left_chain(ws):
    return (
        ws.query("customer", "c")
        .left_join("orders", "o", eq_property("c.c_custkey", "o.o_custkey"))
        .left_join("lineitem", "l", [("o.o_orderkey", "l.l_orderkey")])
        .left_join("nation", "n", [("l.l_linenumber", "n.n_regionkey")])
        .left_join("supplier", "s", [("n.n_nationkey", "s.s_nationkey")])
        .group("c.c_mktsegment")
        .column("c.c_mktsegment")
        .rows("n")
        .count("o.o_orderkey", "orders")
        .count("l.l_orderkey", "lines")
        .count("n.n_nationkey", "nations")
        .count("s.s_suppkey", "suppliers")
    )


# Joins without any equality: a band around a value, a value between two columns, overlapping intervals.
@query(
    """
    SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c
      ON s.s_acctbal < c.c_acctbal AND c.c_acctbal <= s.s_acctbal + 5
    """
)
def join_range(ws):
    near = [
        lt_property("s.s_acctbal", "c.c_acctbal"),
        lte_property("c.c_acctbal", add("s.s_acctbal", 5)),
    ]
    return ws.query("supplier", "s").inner_join("customer", "c", near).columns("s.s_suppkey", "c.c_custkey")


@query(
    """
    SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s
      ON c.c_acctbal BETWEEN s.s_acctbal AND s.s_acctbal + s.s_nationkey
    """
)
def join_between_columns(ws):
    end = add(field("s.s_acctbal"), field("s.s_nationkey"))
    inside = between("c.c_acctbal", field("s.s_acctbal"), end)
    return ws.query("customer", "c").inner_join("supplier", "s", inside).columns("c.c_custkey", "s.s_suppkey")


@query(
    """
    SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s
      ON c.c_acctbal <= s.s_acctbal + s.s_nationkey AND s.s_acctbal <= c.c_acctbal + c.c_nationkey
    """
)
def join_overlap(ws):
    both = [
        lte_property("c.c_acctbal", add(field("s.s_acctbal"), field("s.s_nationkey"))),
        lte_property("s.s_acctbal", add(field("c.c_acctbal"), field("c.c_nationkey"))),
    ]
    return ws.query("customer", "c").inner_join("supplier", "s", both).columns("c.c_custkey", "s.s_suppkey")


@query(
    """
    SELECT s.s_suppkey, c.c_custkey FROM supplier s LEFT JOIN customer c
      ON c.c_acctbal BETWEEN s.s_acctbal AND s.s_acctbal + 2 AND c.c_mktsegment = 'BUILDING'
    """
)
def join_range_left(ws):
    near = between("c.c_acctbal", field("s.s_acctbal"), add("s.s_acctbal", 2))
    return (
        ws.query("supplier", "s")
        .left_join("customer", "c", [near, eq("c.c_mktsegment", "BUILDING")])
        .columns("s.s_suppkey", "c.c_custkey")
    )
