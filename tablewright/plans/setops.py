"""Set operations."""

from tablewright.functions import eq, gt, gte, lt
from tablewright.operators.subqueries import in_query
from tablewright.plans.registry import query


@query(
    """
    SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
    UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000
    """
)
def set_union(ws):
    rich = ws.query("customer").filter(gt("c_acctbal", 9000)).column("c_nationkey", "nation")
    poor = ws.query("supplier").filter(lt("s_acctbal", 1000)).column("s_nationkey", "nation")
    return rich.union(poor)


@query(
    """
    SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000
    UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000
    """
)
def set_union_all(ws):
    customers = ws.query("customer").column("c_name", "name").column("c_acctbal", "balance")
    suppliers = ws.query("supplier").column("s_name", "name").column("s_acctbal", "balance")
    return customers.filter(gt("c_acctbal", 5000)).union_all(
        suppliers.filter(gt("s_acctbal", 5000))
    )


@query(
    """
    SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R'
    INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'
    """
)
def set_intersect(ws):
    pairs = ws.query("lineitem").column("l_partkey", "part").column("l_suppkey", "supplier")
    return pairs.filter(eq("l_returnflag", "R")).intersect(pairs.filter(eq("l_returnflag", "A")))


@query(
    """
    SELECT l_partkey AS part FROM lineitem WHERE l_quantity >= 40
    EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09
    """
)
def set_minus(ws):
    parts = ws.query("lineitem").column("l_partkey", "part")
    return parts.filter(gte("l_quantity", 40)).minus(parts.filter(gt("l_discount", 0.09)))


@query(
    """
    SELECT p_partkey, p_name FROM part WHERE p_partkey IN
      ((SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50
        INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)
       UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 1 AND l_discount > 0.09)
    """
)
def set_nested(ws):
    parts = ws.query("lineitem").column("l_partkey", "part")
    returned = parts.filter(eq("l_returnflag", "R")).filter(eq("l_quantity", 50))
    taxed = parts.filter(gt("l_tax", 0.07))
    single = parts.filter(eq("l_quantity", 1)).filter(gt("l_discount", 0.09))
    wanted = returned.intersect(taxed).union(single)
    return (
        ws.query("part").filter(in_query("p_partkey", wanted)).columns("p_partkey", "p_name")
    )
