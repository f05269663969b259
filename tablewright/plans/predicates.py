"""Filters: comparisons, boolean trees, NULL tests, LIKE, examples."""

import datetime as dt

from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    and_,
    between,
    by_example,
    by_identity,
    eq,
    false,
    func,
    gt,
    gt_property,
    gte,
    in_,
    is_not_null,
    is_null,
    like,
    lt,
    lte,
    multiply,
    ne,
    ne_property,
    not_,
    op,
    or_,
    param,
    text,
    true,
)
from tablewright.plans.registry import query

COMPARISONS = {
    "cmp_eq": (eq, "="),
    "cmp_ne": (ne, "<>"),
    "cmp_lt": (lt, "<"),
    "cmp_gt": (gt, ">"),
    "cmp_lte": (lte, "<="),
    "cmp_gte": (gte, ">="),
}


def _comparison(name, compare, symbol):
    @query(f"SELECT p_partkey, p_size FROM part WHERE p_size {symbol} 25", name)
    def run(ws):
        return ws.query("part").filter(compare("p_size", 25)).columns("p_partkey", "p_size")


for _name, (_compare, _symbol) in COMPARISONS.items():
    _comparison(_name, _compare, _symbol)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_partkey > l_orderkey AND l_suppkey <> l_linenumber
    """
)
def cmp_property(ws):
    return (
        ws.query("lineitem")
        .filter(gt_property("l_partkey", "l_orderkey"))
        .filter(ne_property("l_suppkey", "l_linenumber"))
        .columns("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_quantity * 2000 < l_extendedprice + 1000 AND length(l_returnflag) = 1
    """
)
def cmp_expr(ws):
    return (
        ws.query("lineitem")
        .filter(lt(multiply("l_quantity", 2000), add("l_extendedprice", 1000)))
        .filter(eq(func("length", "'l_returnflag'"), 1))
        .columns("l_orderkey", "l_linenumber")
    )


@query(
    """
    SELECT o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT (o_orderpriority = '5-LOW')
    """
)
def logic_tree(ws):
    status = eq("o_orderstatus", "F").or_(gt("o_totalprice", 400000)).wrap()
    return (
        ws.query("orders")
        .filter(status.and_(not_(eq("o_orderpriority", "5-LOW"))))
        .columns("o_orderkey")
    )


@query(
    """
    SELECT n_nationkey, n_name FROM nation WHERE (1 = 1 AND n_regionkey = 2) OR 1 <> 1
    """
)
def const_pred(ws):
    return (
        ws.query("nation")
        .filter(or_(and_(true(), eq("n_regionkey", 2)), false()))
        .columns("n_nationkey", "n_name")
    )


@query(
    """
    SELECT p_partkey FROM part
    WHERE (p_size > 10 AND p_retailprice < 990 AND p_type <> 'PROMO')
       OR p_brand = 'Brand#4' OR p_brand = 'Brand#8'
    """
)
def logic_nary(ws):
    return (
        ws.query("part")
        .filter(
            or_(
                and_(gt("p_size", 10), lt("p_retailprice", 990), ne("p_type", "PROMO")),
                eq("p_brand", "Brand#4"),
                eq("p_brand", "Brand#8"),
            )
        )
        .columns("p_partkey")
    )


@query(
    """
    SELECT doc_id, quality FROM
      (SELECT d.doc_id, l.quality, nullif(d.lang, 'fr') AS lang
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t
    WHERE quality IS NULL AND lang IS NOT NULL
    """
)
def null_test(ws):
    labelled = (
        ws.query("documents", "d")
        .left_join("labels", "l", [("d.docId", "l.doc_id")])
        .column("d.docId", "doc_id")
        .column("l.quality", "quality")
        .column(func("nullif", "'d.lang'", "fr"), "lang")
    )
    return (
        ws.query(labelled)
        .filter(is_null("quality"))
        .filter(is_not_null("lang"))
        .columns("doc_id", "quality")
    )


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 200000
      AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
    """,
    "between",
)
def between_values(ws):
    return (
        ws.query("orders")
        .filter(between("o_totalprice", 100000, 200000))
        .filter(between("o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1996, 12, 31)))
        .columns("o_orderkey", "o_totalprice")
    )


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#4', 'Brand#8', 'Brand#9')")
def in_list(ws):
    return (
        ws.query("part")
        .filter(in_("p_brand", ["Brand#4", "Brand#8", "Brand#9"]))
        .columns("p_partkey", "p_brand")
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def like_start(ws):
    return ws.query("part").filter(like("p_name", "red", "START")).columns("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gear'")
def like_end(ws):
    return ws.query("part").filter(like("p_name", "gear", "END")).columns("p_partkey", "p_name")


@query("SELECT doc_id, n_chars FROM documents WHERE text LIKE '%the%and%'")
def like_any(ws):
    return (
        ws.query("documents")
        .filter(like("text", "the%and"))
        .column("docId", "doc_id")
        .column("nChars", "n_chars")
    )


@query(
    """
    SELECT doc_id, n_chars FROM documents
    WHERE text LIKE '%!_%' ESCAPE '!' OR text LIKE '%!%%' ESCAPE '!'
    """
)
def like_escape(ws):
    return (
        ws.query("documents")
        .filter(or_(like("text", "!_", escape="!"), like("text", "!%", escape="!")))
        .column("docId", "doc_id")
        .column("nChars", "n_chars")
    )


@query("SELECT p_partkey, p_size FROM part WHERE p_size between 10 and 20 AND p_size % 2 = 0")
def text_pred(ws):
    return (
        ws.query("part")
        .filter(text("p_size", "between 10 and 20"))
        .filter(text("p_size", "% 2 = 0"))
        .columns("p_partkey", "p_size")
    )


@query(
    """
    SELECT p_partkey FROM part
    WHERE p_size IS DISTINCT FROM 10 AND p_retailprice >= 950 AND p_name NOT LIKE 'red%'
    """
)
def simple_op(ws):
    return (
        ws.query("part")
        .filter(op("p_size", "is distinct from", 10))
        .filter(op("p_retailprice", ">=", 950))
        .filter(op("p_name", "not like", "red%"))
        .columns("p_partkey")
    )


# The example frame is derived from the table: brand and type of the cheapest parts, with the
# type left open for small ones.
@query(
    """
    WITH examples AS (
      SELECT DISTINCT p_brand AS b, CASE WHEN p_size >= 25 THEN p_type END AS t
      FROM part WHERE p_retailprice < 900.5)
    SELECT p.* FROM part p
    WHERE EXISTS (SELECT 1 FROM examples e WHERE e.b = p.p_brand AND (e.t IS NULL OR e.t = p.p_type))
      AND p.p_type <> 'PROMO'
    """
)
def by_example_frame(ws):
    examples = (
        ws.query("part")
        .filter(lt("p_retailprice", 900.5))
        .column("p_brand")
        .column(F.when(F.col("p_size") >= 25, F.col("p_type")), "p_type")
    )
    return ws.by_examples("part", examples.frame()).filter(ne("p_type", "PROMO"))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", "by_example")
def by_example_row(ws):
    example = {
        "o_orderkey": None,
        "o_orderstatus": "F",
        "o_orderpriority": "1-URGENT",
        "o_totalprice": 0,
    }
    condition = by_example(ws.spec("orders"), example, selector="NON_NULL_OR_ZERO")
    return ws.query("orders").filter(condition)


@query("SELECT * FROM conversations WHERE conv_id = 5 AND turn = 3", "by_identity")
def by_identity_row(ws):
    row = {"conv_id": 5, "turn": 3}
    return ws.query("conversations").filter(by_identity(ws.spec("conversations"), row))


@query(
    """
    SELECT o_orderkey FROM orders
    WHERE o_orderstatus = 'P' AND o_totalprice > 100000 AND o_orderdate < TIMESTAMP '1997-01-01'
    """
)
def filter_chain(ws):
    return (
        ws.query("orders")
        .filter(eq("o_orderstatus", "P"))
        .filter(gt("o_totalprice", 100000))
        .filter(lt("o_orderdate", dt.datetime(1997, 1, 1)))
        .columns("o_orderkey")
    )


@query(
    """
    SELECT l_orderkey, count(*) AS n FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity = 10
    GROUP BY l_orderkey
    """
)
def typed_params(ws):
    return (
        ws.query("lineitem")
        .filter(gte("l_shipdate", param("1999-01-01", "TIMESTAMP")))
        .filter(eq("l_quantity", param("10", "DOUBLE")))
        .group("l_orderkey")
        .column("l_orderkey")
        .rows("n")
    )
