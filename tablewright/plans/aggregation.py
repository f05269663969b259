"""Aggregates, grouping and having."""

from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    aggregate,
    avg,
    count,
    divide,
    eq,
    func,
    gt,
    literal,
    lt,
    max_,
    min_,
    mod,
    multiply,
    rows,
    sum_,
)
from tablewright.functions.fields import Expr
from tablewright.plans.registry import query


def rounded(e: Expr, digits: int = 2) -> Expr:
    return func("round", e, digits)


@query(
    """
    SELECT max(o_totalprice) AS high, min(o_totalprice) AS low, round(avg(o_totalprice), 4) AS mean,
           round(sum(o_totalprice), 2) AS total, count(o_custkey) AS n
    FROM orders WHERE o_orderstatus = 'O'
    """
)
def agg_basic(ws):
    return (
        ws.query("orders")
        .filter(eq("o_orderstatus", "O"))
        .max("o_totalprice", "high")
        .min("o_totalprice", "low")
        .column(rounded(avg("o_totalprice"), 4), "mean")
        .column(rounded(sum_("o_totalprice")), "total")
        .count("o_custkey", "n")
    )


@query(
    """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS lines,
           round(avg(DISTINCT l_quantity), 6) AS mean, max(DISTINCT l_quantity) AS high,
           min(DISTINCT l_quantity) AS low
    FROM lineitem GROUP BY l_returnflag
    """
)
def agg_distinct(ws):
    return (
        ws.query("lineitem")
        .group("l_returnflag")
        .column("l_returnflag")
        .count("l_partkey", "parts", distinct=True)
        .sum("l_linenumber", "lines", distinct=True)
        .column(rounded(avg("l_quantity", distinct=True), 6), "mean")
        .max("l_quantity", "high", distinct=True)
        .min("l_quantity", "low", distinct=True)
    )


@query(
    """
    SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang
    """
)
def agg_rows(ws):
    return (
        ws.query("documents", "d")
        .left_join("labels", "l", [("d.docId", "l.doc_id")])
        .group("d.lang")
        .column("d.lang")
        .rows("documents")
        .rows("labelled", "l")
    )


@query(
    """
    SELECT count(*) AS n FROM
      (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000) t
    """
)
def rows_of_query(ws):
    big = (
        ws.query("orders")
        .group("o_custkey")
        .column("o_custkey")
        .having(gt(sum_("o_totalprice"), 2000000))
    )
    return ws.query(big).rows("n")


@query(
    """
    SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
           round(avg(l_extendedprice / l_quantity), 4) AS unit, max(l_quantity + l_tax) AS high
    FROM lineitem GROUP BY l_linestatus
    """
)
def agg_expr(ws):
    net = multiply("l_extendedprice", literal(1).subtract("l_discount"))
    return (
        ws.query("lineitem")
        .group("l_linestatus")
        .column("l_linestatus")
        .column(rounded(sum_(net)), "net")
        .column(rounded(avg(divide("l_extendedprice", "l_quantity")), 4), "unit")
        .column(max_(add("l_quantity", "l_tax")), "high")
    )


@query(
    """
    SELECT p_type, round(stddev_samp(p_retailprice), 6) AS spread, bool_and(p_size > 0) AS positive,
           bit_or(p_size) AS bits
    FROM part GROUP BY p_type
    """
)
def agg_named(ws):
    return (
        ws.query("part")
        .group("p_type")
        .column("p_type")
        .column(rounded(aggregate("stddev_samp", "p_retailprice"), 6), "spread")
        .column(aggregate("bool_and", gt_expr()), "positive")
        .column(aggregate("bit_or", "p_size"), "bits")
    )


def gt_expr() -> Expr:
    return Expr(lambda scope: scope.resolve("p_size") > 0)


@query(
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderstatus, o_orderpriority
    """
)
def group_by(ws):
    return (
        ws.query("orders")
        .group("o_orderstatus")
        .group("o_orderpriority")
        .columns("o_orderstatus", "o_orderpriority")
        .rows("n")
        .column(rounded(sum_("o_totalprice")), "total")
    )


# Grouped by a computed field, with a function of the group in the output.
@query(
    """
    SELECT year(o_orderdate)::INTEGER AS year, left(o_orderpriority, 1) AS level, count(*) AS n
    FROM orders GROUP BY year(o_orderdate), o_orderpriority
    """
)
def group_by_expr(ws):
    year = func("year", "'o_orderdate'")
    return (
        ws.query("orders")
        .group(year, "o_orderpriority")
        .column(year, "year")
        .column(func("left", "'o_orderpriority'", 1), "level")
        .rows("n")
    )


@query(
    """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey HAVING count(*) > 8 AND sum(o_totalprice) > 2500000
    """
)
def having(ws):
    return (
        ws.query("orders")
        .group("o_custkey")
        .column("o_custkey")
        .rows("n")
        .column(rounded(sum_("o_totalprice")), "total")
        .having(gt(rows(), 8))
        .having(gt(sum_("o_totalprice"), 2500000))
    )


@query(
    """
    SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue,
           min(l_shipdate) AS first_day, max(l_shipdate) AS last_day
    FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07
    """
)
def agg_global(ws):
    return (
        ws.query("lineitem")
        .filter(lt("l_quantity", 24))
        .filter(F.col("l_discount").between(0.05, 0.07))
        .rows("n")
        .column(rounded(sum_(multiply("l_extendedprice", "l_discount"))), "revenue")
        .column(min_("l_shipdate"), "first_day")
        .column(max_("l_shipdate"), "last_day")
    )


# Best value per group with a shortened title.
@query(
    """
    SELECT left(source, 4) AS title, lang, max(n_chars) AS longest, count(text) AS n
    FROM documents GROUP BY source, lang
    """
)
def group_max_function(ws):
    return (
        ws.query("documents")
        .group("source", "lang")
        .column(func("left", "'source'", 4), "title")
        .column("lang")
        .max("nChars", "longest")
        .column(count("text"), "n")
    )


@query(
    """
    SELECT l_partkey % 7 AS slot, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
           count(DISTINCT l_orderkey) AS orders
    FROM lineitem GROUP BY l_partkey % 7
    """
)
def agg_distinct_several(ws):
    slot = mod("l_partkey", 7)
    return (
        ws.query("lineitem")
        .group(slot)
        .column(slot, "slot")
        .rows("n")
        .count("l_suppkey", "suppliers", distinct=True)
        .count("l_orderkey", "orders", distinct=True)
    )
