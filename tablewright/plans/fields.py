"""Computed fields."""

from tablewright.functions import (
    add,
    bit_and,
    bit_or,
    bit_xor,
    concat,
    divide,
    eq,
    field,
    func,
    literal,
    mod,
    multiply,
    subtract,
    template,
)
from tablewright.plans.registry import query


@query(
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 4) AS added,
           round(l_extendedprice - l_quantity, 4) AS less,
           round((l_quantity + l_tax) * l_discount, 6) AS product,
           round(l_extendedprice / l_quantity, 6) AS unit,
           round(l_quantity / nullif(l_discount, 0), 6) AS ratio
    FROM lineitem
    """
)
def math_basic(ws):
    def rounded(e, digits):
        return func("round", e, digits)

    return (
        ws.query("lineitem")
        .columns("l_orderkey", "l_linenumber")
        .column(rounded(add("l_extendedprice", "l_tax"), 4), "added")
        .column(rounded(subtract("l_extendedprice", "l_quantity"), 4), "less")
        .column(rounded(multiply(add("l_quantity", "l_tax"), "l_discount"), 6), "product")
        .column(rounded(divide("l_extendedprice", "l_quantity"), 6), "unit")
        .column(rounded(divide("l_quantity", "l_discount"), 6), "ratio")
    )


@query(
    """
    SELECT o_orderkey, o_orderkey % 7 AS slot, (o_custkey - 500) % 9 AS signed,
           o_custkey % nullif(o_orderkey % 3, 0) AS by_row
    FROM orders
    """
)
def math_mod(ws):
    return (
        ws.query("orders")
        .column("o_orderkey")
        .column(mod("o_orderkey", 7), "slot")
        .column(subtract("o_custkey", 500).modulo(9), "signed")
        .column(mod("o_custkey", mod("o_orderkey", 3)), "by_row")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey & l_suppkey AS both, l_partkey | l_suppkey AS any_bit,
           xor(l_partkey, l_suppkey) AS differing
    FROM lineitem
    """
)
def math_bits(ws):
    return (
        ws.query("lineitem")
        .columns("l_orderkey", "l_linenumber")
        .column(bit_and("l_partkey", "l_suppkey"), "both")
        .column(bit_or("l_partkey", "l_suppkey"), "any_bit")
        .column(bit_xor("l_partkey", "l_suppkey"), "differing")
    )


@query(
    """
    SELECT p_partkey, p_brand || ' ' || p_type AS shown, p_name || nullif(p_type, 'PROMO') AS gap
    FROM part
    """,
    "concat",
)
def concat_text(ws):
    return (
        ws.query("part")
        .column("p_partkey")
        .column(field("p_brand").concat(literal(" ")).concat("p_type"), "shown")
        .column(concat("p_name", func("nullif", "'p_type'", "PROMO")), "gap")
    )


@query(
    """
    SELECT page_id, upper(left(url, 5)) AS scheme, length(html)::INTEGER AS size,
           strpos(html, '<body')::INTEGER AS body_at, replace(url, 'http:', 'https:') AS secure
    FROM pages
    """
)
def func_named(ws):
    return (
        ws.query("pages")
        .column("page_id")
        .column(func("upper", func("left", "'url'", 5)), "scheme")
        .column(func("length", "'html'"), "size")
        .column(func("instr", "'html'", "<body"), "body_at")
        .column(func("replace", "'url'", "http:", "https:"), "secure")
    )


@query(
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large?' ELSE o_orderpriority END AS size,
           o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus = 'F' AS inside
    FROM orders
    """,
    "template",
)
def template_slots(ws):
    return (
        ws.query("orders")
        .column("o_orderkey")
        .column(
            template(
                r"CASE WHEN ? > ? THEN 'large\?' ELSE ? END",
                "'o_totalprice'",
                250000,
                "'o_orderpriority'",
            ),
            "size",
        )
        .column(
            template(
                "? BETWEEN ? AND ? AND ? = ?",
                "'o_totalprice'",
                1000,
                200000,
                "'o_orderstatus'",
                "F",
            ),
            "inside",
        )
    )


@query(
    """
    SELECT event_id, user_id * 10 + length(event_type) AS mixed, NULL::VARCHAR AS nothing
    FROM events WHERE event_type = 'click'
    """
)
def argument_kinds(ws):
    return (
        ws.query("events")
        .filter(eq("event_type", "click"))
        .column("event_id")
        .column(multiply("user_id", 10).add(func("length", "'event_type'")), "mixed")
        .column(func("concat", "'event_type'", None), "nothing")
    )
