"""Declarations of the test tables. Property names differ from column names for `documents`,
which is mapped by the snake-case rule."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.schema import Catalog, Column, ForeignKey, TableSpec
from tablewright.workspace import Workspace


def _columns(**types) -> tuple[Column, ...]:
    return tuple(Column(name, t, name=name) for name, t in types.items())


CATALOG = Catalog(
    TableSpec(
        "region",
        _columns(r_regionkey="INTEGER", r_name="VARCHAR"),
        primary_key=("r_regionkey",),
        unique={"region_name": ("r_name",)},
    ),
    TableSpec(
        "nation",
        _columns(n_nationkey="INTEGER", n_name="VARCHAR", n_regionkey="INTEGER"),
        primary_key=("n_nationkey",),
        foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),),
    ),
    TableSpec(
        "supplier",
        _columns(s_suppkey="BIGINT", s_name="VARCHAR", s_nationkey="INTEGER", s_acctbal="DOUBLE"),
        primary_key=("s_suppkey",),
        foreign_keys=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
    ),
    TableSpec(
        "customer",
        _columns(
            c_custkey="BIGINT",
            c_name="VARCHAR",
            c_nationkey="INTEGER",
            c_acctbal="DOUBLE",
            c_mktsegment="VARCHAR",
        ),
        primary_key=("c_custkey",),
        foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
    ),
    TableSpec(
        "part",
        _columns(
            p_partkey="BIGINT",
            p_name="VARCHAR",
            p_brand="VARCHAR",
            p_type="VARCHAR",
            p_size="INTEGER",
            p_retailprice="DOUBLE",
        ),
        primary_key=("p_partkey",),
    ),
    TableSpec(
        "orders",
        _columns(
            o_orderkey="BIGINT",
            o_custkey="BIGINT",
            o_orderstatus="VARCHAR",
            o_totalprice="DOUBLE",
            o_orderdate="TIMESTAMP",
            o_orderpriority="VARCHAR",
        ),
        primary_key=("o_orderkey",),
        foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
    ),
    TableSpec(
        "lineitem",
        _columns(
            l_orderkey="BIGINT",
            l_partkey="BIGINT",
            l_suppkey="BIGINT",
            l_linenumber="INTEGER",
            l_quantity="DOUBLE",
            l_extendedprice="DOUBLE",
            l_discount="DOUBLE",
            l_tax="DOUBLE",
            l_returnflag="VARCHAR",
            l_linestatus="VARCHAR",
            l_shipdate="TIMESTAMP",
        ),
        foreign_keys=(
            ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),
            ForeignKey(("l_partkey",), "part", ("p_partkey",)),
            ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",)),
        ),
    ),
    TableSpec(
        "events",
        _columns(
            event_id="BIGINT",
            ts="TIMESTAMP",
            user_id="BIGINT",
            event_type="VARCHAR",
            value="DOUBLE",
            props="VARCHAR",
        ),
        primary_key=("event_id",),
    ),
    TableSpec(
        "documents",
        (
            Column("docId", "BIGINT"),
            Column("text", "VARCHAR"),
            Column("lang", "VARCHAR"),
            Column("source", "VARCHAR"),
            Column("nChars", "BIGINT"),
        ),
        primary_key=("docId",),
    ),
    TableSpec(
        "labels",
        _columns(doc_id="BIGINT", quality="INTEGER", toxic="INTEGER"),
        primary_key=("doc_id",),
        foreign_keys=(ForeignKey(("doc_id",), "documents", ("docId",)),),
    ),
    TableSpec(
        "conversations",
        _columns(conv_id="BIGINT", turn="BIGINT", role="VARCHAR", text="VARCHAR"),
        primary_key=("conv_id", "turn"),
    ),
    TableSpec("pages", _columns(page_id="BIGINT", url="VARCHAR", html="VARCHAR"), ("page_id",)),
    TableSpec("benchmark", _columns(item_id="BIGINT", text="VARCHAR"), ("item_id",)),
    TableSpec(
        "embeddings",
        _columns(vec_id="BIGINT", embedding="array<float>", label="INTEGER"),
        primary_key=("vec_id",),
    ),
)


def workspace(spark: SparkSession, folder: str) -> Workspace:
    return Workspace.over_files(spark, CATALOG, folder)
