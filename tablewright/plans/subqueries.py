"""Filters on subqueries."""

from pyspark.sql import functions as F

from tablewright.functions import (
    add,
    and_,
    avg,
    eq,
    eq_property,
    gt,
    gte,
    gte_property,
    lt,
    lt_property,
    lte,
    multiply,
    ne,
    ne_property,
    or_,
    rows,
    subtract,
)
from tablewright.operators.subqueries import (
    exists,
    gt_all,
    gt_any,
    gte_all,
    gte_any,
    in_query,
    lt_all,
    lt_any,
    lte_all,
    lte_any,
    ne_all,
    ne_any,
    not_exists,
    not_in_query,
)
from tablewright.plans.registry import query

SCALAR = {
    "scalar_sub_eq": (eq, "=", "max"),
    "scalar_sub_ne": (ne, "<>", "min"),
    "scalar_sub_lt": (lt, "<", "avg"),
    "scalar_sub_gt": (gt, ">", "avg"),
    "scalar_sub_lte": (lte, "<=", "avg"),
    "scalar_sub_gte": (gte, ">=", "avg"),
}


def _scalar(name, compare, symbol, aggregate):
    @query(
        f"SELECT p_partkey, p_size FROM part "
        f"WHERE p_size {symbol} (SELECT {aggregate}(p_size) FROM part WHERE p_type = 'SMALL')",
        name,
    )
    def run(ws):
        small = ws.query("part").filter(eq("p_type", "SMALL"))
        one = getattr(small, aggregate)("p_size", "v")
        return ws.query("part", "p").filter(compare("p_size", one)).columns("p_partkey", "p_size")


for _name, _parts in SCALAR.items():
    _scalar(_name, *_parts)


@query(
    """
    SELECT o.o_orderkey, o.o_totalprice FROM orders o
    WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i
                            WHERE i.o_custkey = o.o_custkey)
    """
)
def scalar_sub_correlated(ws):
    mean = (
        ws.query("orders", "i")
        .filter(eq_property("i.o_custkey", "o.o_custkey"))
        .column(multiply(avg("i.o_totalprice"), 1.5), "v")
    )
    return (
        ws.query("orders", "o")
        .filter(gt("o.o_totalprice", mean))
        .columns("o.o_orderkey", "o.o_totalprice")
    )


@query(
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                  AND o.o_totalprice > 490000)
    """,
    "exists",
)
def exists_by_keys(ws):
    large = ws.query("orders").filter(gt("o_totalprice", 490000)).columns("o_custkey")
    return (
        ws.query("customer", "c")
        .filter(exists(large, on=[("c_custkey", "o_custkey")]))
        .columns("c_custkey", "c_name")
    )


@query(
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                  AND o.o_totalprice > 480000 AND o.o_orderstatus = 'P')
    """
)
def exists_correlated(ws):
    linked = (
        ws.query("orders", "o")
        .relate_outer("customer", "c")
        .filter(gt("o_totalprice", 480000))
        .filter(eq("o_orderstatus", "P"))
    )
    return ws.query("customer", "c").filter(exists(linked)).columns("c_custkey", "c_name")


@query(
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_totalprice > 400000)
    """,
    "not_exists",
)
def not_exists_by_keys(ws):
    large = ws.query("orders").filter(gt("o_totalprice", 400000)).columns("o_custkey")
    return (
        ws.query("customer", "c")
        .filter(not_exists(large, on=[("c_custkey", "o_custkey")]))
        .columns("c_custkey", "c_name")
    )


@query(
    """
    SELECT p_partkey FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_tax > 0.06)
    """
)
def in_sub(ws):
    bulk = (
        ws.query("lineitem").filter(eq("l_quantity", 50)).filter(gt("l_tax", 0.06))
    ).columns("l_partkey")
    return ws.query("part").filter(in_query("p_partkey", bulk)).columns("p_partkey")


@query(
    """
    SELECT p_partkey FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)
    """
)
def not_in_sub(ws):
    bulk = ws.query("lineitem").filter(eq("l_quantity", 50)).columns("l_partkey")
    return ws.query("part").filter(not_in_query("p_partkey", bulk)).columns("p_partkey")


@query(
    """
    SELECT p_partkey FROM part
    WHERE p_size > 45 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)
    """
)
def in_sub_nested(ws):
    bulk = ws.query("lineitem").filter(eq("l_quantity", 50)).columns("l_partkey")
    return (
        ws.query("part")
        .filter(or_(gt("p_size", 45), in_query("p_partkey", bulk)))
        .columns("p_partkey")
    )


# One filter per comparison over the same two tables; the sets are chosen so that each keeps some
# customers and drops others.
QUANTIFIED = {
    "gt_any": (gt_any, "> ANY", "s_acctbal > 5000"),
    "lt_any": (lt_any, "< ANY", "s_acctbal < 5000"),
    "gte_any": (gte_any, ">= ANY", "s_acctbal > 6000"),
    "lte_any": (lte_any, "<= ANY", "s_acctbal < 4000"),
    "gt_all": (gt_all, "> ALL", "s_acctbal < 5000"),
    "lt_all": (lt_all, "< ALL", "s_acctbal > 5000"),
    "gte_all": (gte_all, ">= ALL", "s_acctbal < 4000"),
    "lte_all": (lte_all, "<= ALL", "s_acctbal > 6000"),
}


def _quantified(name, compare, symbol, restricted):
    @query(
        f"SELECT c_custkey, c_acctbal FROM customer "
        f"WHERE c_acctbal {symbol} (SELECT s_acctbal FROM supplier WHERE {restricted})",
        name,
    )
    def run(ws):
        balances = ws.query("supplier").filter(F.expr(restricted)).columns("s_acctbal")
        return (
            ws.query("customer")
            .filter(compare("c_acctbal", balances))
            .columns("c_custkey", "c_acctbal")
        )


for _name, _parts in QUANTIFIED.items():
    _quantified(_name, *_parts)


@query(
    """
    SELECT p_partkey, p_size FROM part
    WHERE p_size <> ANY (SELECT max(p_size) FROM part) AND p_size > 20
    """,
    "ne_any",
)
def ne_any_value(ws):
    largest = ws.query("part").max("p_size", "v")
    return (
        ws.query("part")
        .filter(and_(ne_any("p_size", largest), gt("p_size", 20)))
        .columns("p_partkey", "p_size")
    )


@query(
    """
    SELECT p_partkey, p_size FROM part
    WHERE p_size <> ALL (SELECT p_size FROM part WHERE p_retailprice > 999)
    """,
    "ne_all",
)
def ne_all_values(ws):
    sizes = ws.query("part").filter(gt("p_retailprice", 999)).columns("p_size")
    return ws.query("part").filter(ne_all("p_size", sizes)).columns("p_partkey", "p_size")


@query(
    """
    SELECT c_custkey FROM customer
    WHERE NOT (c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal < 5000))
      AND NOT (c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 2000))
    """
)
def not_quantified(ws):
    low = ws.query("supplier").filter(lt("s_acctbal", 5000)).columns("s_acctbal")
    lower = ws.query("supplier").filter(lt("s_acctbal", 2000)).columns("s_acctbal")
    return (
        ws.query("customer")
        .filter(~gt_all("c_acctbal", low))
        .filter(~lt_any("c_acctbal", lower))
        .columns("c_custkey")
    )


def _orders_of(ws):
    return ws.query("orders", "o").filter(eq_property("o.o_custkey", "c.c_custkey"))


def _customers(ws, condition):
    return ws.query("customer", "c").filter(condition).columns("c_custkey", "c_name")


BUSY = """
    SELECT c_custkey, c_name FROM customer c WHERE {} EXISTS (
      SELECT o.o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey
      GROUP BY o.o_orderstatus HAVING count(*) > 5)
"""


@query(BUSY.format(""))
def exists_having(ws):
    busy = _orders_of(ws).group("o.o_orderstatus").having(gt(rows(), 5))
    return _customers(ws, exists(busy))


@query(BUSY.format("NOT"))
def not_exists_having(ws):
    busy = _orders_of(ws).group("o.o_orderstatus").having(gt(rows(), 5))
    return _customers(ws, not_exists(busy))


@query(
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) > 12
      AND EXISTS (SELECT 1 FROM region LIMIT 1)
      AND NOT EXISTS (SELECT 1 FROM region LIMIT 0)
    """
)
def exists_limit(ws):
    beyond = _orders_of(ws).columns("o.o_orderkey").limit(12, 5)
    one, none = ws.query("region").limit(1), ws.query("region").limit(0)
    return _customers(ws, and_(exists(beyond), exists(one), not_exists(none)))


@query(
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT max(o_totalprice) FROM orders o
                  WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'none')
    """
)
def exists_aggregate(ws):
    return _customers(
        ws, exists(_orders_of(ws).filter(eq("o.o_orderstatus", "none")).max("o.o_totalprice", "m"))
    )


def _lines(ws):
    linked = ws.query("lineitem", "l").filter(eq_property("l.l_orderkey", "o.o_orderkey"))
    return linked.filter(gt("l.l_tax", 0.05)).columns("l.l_extendedprice")


@query(
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
    WHERE l.l_linenumber IN (SELECT m.l_linenumber + 1 FROM lineitem m
                             WHERE m.l_orderkey = l.l_orderkey AND m.l_quantity > 45)
    """
)
def in_sub_correlated(ws):
    before = (
        ws.query("lineitem", "m")
        .filter(eq_property("m.l_orderkey", "l.l_orderkey"))
        .filter(gt("m.l_quantity", 45))
        .column(add("m.l_linenumber", 1), "v")
    )
    return (
        ws.query("lineitem", "l")
        .filter(in_query("l.l_linenumber", before))
        .columns("l.l_orderkey", "l.l_linenumber", "l.l_partkey")
    )


@query(
    """
    SELECT o.o_orderkey FROM orders o
    WHERE o.o_orderstatus NOT IN (SELECT l.l_linestatus FROM lineitem l
                                  WHERE l.l_orderkey = o.o_orderkey AND l.l_tax > 0.05)
    """
)
def not_in_sub_correlated(ws):
    linked = ws.query("lineitem", "l").filter(eq_property("l.l_orderkey", "o.o_orderkey"))
    states = linked.filter(gt("l.l_tax", 0.05)).columns("l.l_linestatus")
    return ws.query("orders", "o").filter(not_in_query("o.o_orderstatus", states)).columns("o.o_orderkey")


@query(
    """
    SELECT o.o_orderkey FROM orders o
    WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_tax > 0.05
                  AND o.o_totalprice > l.l_extendedprice)
    """
)
def gt_any_correlated(ws):
    return ws.query("orders", "o").filter(gt_any("o.o_totalprice", _lines(ws))).columns("o.o_orderkey")


@query(
    """
    SELECT o.o_orderkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_tax > 0.05
                      AND o.o_totalprice >= l.l_extendedprice)
    """
)
def lt_all_correlated(ws):
    return ws.query("orders", "o").filter(lt_all("o.o_totalprice", _lines(ws))).columns("o.o_orderkey")


# Tied to the enclosing row by a comparison alone: one smallest or largest value decides.
@query(
    """
    SELECT s_suppkey FROM supplier s
    WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_acctbal < s.s_acctbal - 9000)
    """
)
def exists_inequality(ws):
    poorer = (
        ws.query("customer", "c")
        .filter(eq("c.c_mktsegment", "BUILDING"))
        .filter(lt_property("c.c_acctbal", subtract("s.s_acctbal", 9000)))
    )
    return ws.query("supplier", "s").filter(exists(poorer)).columns("s.s_suppkey")


@query(
    """
    SELECT c_custkey FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal >= c.c_acctbal)
      AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal < c.c_acctbal - 10000)
    """
)
def not_exists_inequality(ws):
    richer = (
        ws.query("supplier", "s")
        .filter(eq_property("s.s_nationkey", "c.c_nationkey"))
        .filter(gte_property("s.s_acctbal", "c.c_acctbal"))
    )
    far = ws.query("supplier", "s").filter(lt_property("s.s_acctbal", subtract("c.c_acctbal", 10_000)))
    return (
        ws.query("customer", "c")
        .filter(not_exists(richer))
        .filter(not_exists(far))
        .columns("c.c_custkey")
    )


@query(
    """
    SELECT DISTINCT l_orderkey FROM lineitem l
    WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey)
    """
)
def exists_other(ws):
    other = (
        ws.query("lineitem", "m")
        .filter(eq_property("m.l_orderkey", "l.l_orderkey"))
        .filter(ne_property("m.l_suppkey", "l.l_suppkey"))
    )
    return ws.query("lineitem", "l").filter(exists(other)).column("l.l_orderkey").distinct()


# The first rows of each key, and one aggregate per key.
@query(
    """
    WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
    SELECT o_orderkey FROM orders o WHERE o.o_orderpriority NOT IN (
      SELECT r.o_orderpriority FROM r WHERE r.o_custkey = o.o_custkey AND r.n BETWEEN 2 AND 3)
    """
)
def not_in_sub_correlated_limit(ws):
    return ws.query("orders", "o").filter(not_in_query("o.o_orderpriority", _largest(ws, 1, 2))).columns("o.o_orderkey")


@query(
    """
    WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
    SELECT o_orderkey FROM orders o WHERE o.o_orderpriority IN (
      SELECT r.o_orderpriority FROM r WHERE r.o_custkey = o.o_custkey AND r.n <= 3)
    """
)
def in_sub_correlated_limit(ws):
    return ws.query("orders", "o").filter(in_query("o.o_orderpriority", _largest(ws, 0, 3))).columns("o.o_orderkey")


def _largest(ws, offset: int, count: int):
    return (
        ws.query("orders", "p")
        .filter(eq_property("p.o_custkey", "o.o_custkey"))
        .columns("p.o_orderpriority")
        .desc("p.o_totalprice")
        .asc("p.o_orderkey")
        .limit(offset, count)
    )


@query(
    """
    WITH r AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (
        PARTITION BY l_orderkey ORDER BY l_extendedprice) AS n FROM lineitem)
    SELECT o_orderkey FROM orders o WHERE EXISTS (
      SELECT 1 FROM r WHERE r.l_orderkey = o.o_orderkey AND r.n BETWEEN 2 AND 3 AND o.o_totalprice > r.l_extendedprice)
    """
)
def gt_any_correlated_limit(ws):
    cheap = (
        ws.query("lineitem", "l")
        .filter(eq_property("l.l_orderkey", "o.o_orderkey"))
        .columns("l.l_extendedprice")
        .asc("l.l_extendedprice")
        .limit(1, 2)
    )
    return ws.query("orders", "o").filter(gt_any("o.o_totalprice", cheap)).columns("o.o_orderkey")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
    WHERE l.l_quantity IN (SELECT max(m.l_quantity) FROM lineitem m
                           WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = 'R')
    """
)
def in_sub_correlated_max(ws):
    most = (
        ws.query("lineitem", "m")
        .filter(eq_property("m.l_orderkey", "l.l_orderkey"))
        .filter(eq("m.l_returnflag", "R"))
        .max("m.l_quantity", "v")
    )
    return (
        ws.query("lineitem", "l")
        .filter(in_query("l.l_quantity", most))
        .columns("l.l_orderkey", "l.l_linenumber", "l.l_partkey")
    )


@query(
    """
    SELECT c_custkey FROM customer c
    WHERE c.c_nationkey >= ALL (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey)
      AND c.c_nationkey NOT IN (SELECT count(*) FROM orders o
                                WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    """
)
def gte_all_correlated_count(ws):
    finished = _orders_of(ws).filter(eq("o.o_orderstatus", "F")).rows("n")
    return (
        ws.query("customer", "c")
        .filter(gte_all("c.c_nationkey", _orders_of(ws).rows("n")))
        .filter(not_in_query("c.c_nationkey", finished))
        .columns("c.c_custkey")
    )
