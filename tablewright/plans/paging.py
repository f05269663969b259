"""Sorting and pages. Sort keys end with the primary key, so a page is the same every time."""

from pyspark.sql import functions as F

from tablewright.functions import add, eq, func, gt, multiply, sum_
from tablewright.plans.registry import query


@query(
    """
    SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_nationkey = 7
    ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey
    """
)
def order_multi(ws):
    return (
        ws.query("customer")
        .filter(eq("c_nationkey", 7))
        .columns("c_custkey", "c_mktsegment", "c_acctbal")
        .asc("c_mktsegment")
        .desc("c_acctbal")
        .asc("c_custkey")
    )


@query(
    """
    SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'
    ORDER BY length(p_name) DESC, p_size * p_retailprice, p_partkey
    """
)
def order_expr(ws):
    return (
        ws.query("part")
        .filter(eq("p_type", "PROMO"))
        .columns("p_partkey", "p_name")
        .order(func("length", "'p_name'"), descending=True)
        .order(multiply("p_size", "p_retailprice"))
        .asc("p_partkey")
    )


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
    """
)
def top_k(ws):
    return (
        ws.query("orders")
        .columns("o_orderkey", "o_totalprice")
        .desc("o_totalprice")
        .asc("o_orderkey")
        .limit(25)
    )


@query(
    """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20
    """
)
def top_k_grouped(ws):
    return (
        ws.query("orders")
        .group("o_custkey")
        .column("o_custkey")
        .rows("n")
        .column(func("round", sum_("o_totalprice"), 2), "total")
        .desc("n")
        .asc("o_custkey")
        .limit(20)
    )


@query(
    """
    SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey
    LIMIT 40 OFFSET 200
    """
)
def page(ws):
    return (
        ws.query("orders")
        .columns("o_orderkey", "o_orderdate")
        .asc("o_orderdate")
        .asc("o_orderkey")
        .limit(200, 40)
    )


# Pages whose ends lie beyond what one task should merge, and within the table.
@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
    LIMIT 20000 OFFSET 15000
    """
)
def page_deep(ws):
    return (
        ws.query("lineitem")
        .columns("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        .desc("l_extendedprice")
        .asc("l_orderkey")
        .asc("l_linenumber")
        .asc("l_partkey")
        .asc("l_suppkey")
        .limit(15_000, 20_000)
    )


@query(
    """
    SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders
    ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 9000 OFFSET 4000
    """
)
def page_deep_text(ws):
    return (
        ws.query("orders")
        .columns("o_orderkey", "o_orderpriority", "o_orderdate")
        .asc("o_orderpriority")
        .desc("o_orderdate")
        .asc("o_orderkey")
        .limit(4_000, 9_000)
    )


# Keys that differ only where a double no longer tells them apart.
@query(
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    ORDER BY CAST(4611686018427387904 AS BIGINT) + o_orderkey DESC LIMIT 9000 OFFSET 4000
    """
)
def page_deep_long(ws):
    return (
        ws.query("orders")
        .columns("o_orderkey", "o_orderpriority")
        .order(add("o_orderkey", 4611686018427387904), descending=True)
        .limit(4_000, 9_000)
    )


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY CAST(CAST(o_custkey AS DECIMAL(20, 0)) * 1000000000000 AS DECIMAL(38, 0)) + o_orderkey
    LIMIT 9000 OFFSET 4000
    """
)
def page_deep_decimal(ws):
    wide = F.col("o_custkey").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("o_orderkey")
    return (
        ws.query("orders").columns("o_orderkey", "o_totalprice").order(wide).limit(4_000, 9_000)
    )


# The next page after a known last row, without counting the rows before it.
@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000
    ORDER BY o_orderkey LIMIT 50
    """
)
def page_after(ws):
    return (
        ws.query("orders")
        .filter(gt("o_orderkey", 5000))
        .columns("o_orderkey", "o_totalprice")
        .asc("o_orderkey")
        .limit(50)
    )
