"""Aggregates over properties or computed fields. All have partial forms in Spark, so rows are
combined before the shuffle and a hot group costs one partial row per task."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.fields import Expr, as_field


def max_(prop) -> Expr:
    f = as_field(prop)
    return Expr(lambda scope: F.max(f.build(scope)), aggregate=True)


def min_(prop) -> Expr:
    f = as_field(prop)
    return Expr(lambda scope: F.min(f.build(scope)), aggregate=True)


def sum_(prop, distinct: bool = False) -> Expr:
    f = as_field(prop)
    agg = F.sum_distinct if distinct else F.sum
    return Expr(lambda scope: agg(f.build(scope)), aggregate=True)


def count(prop, distinct: bool = False) -> Expr:
    f = as_field(prop)
    if distinct:
        return Expr(lambda scope: F.count_distinct(f.build(scope)), aggregate=True)
    return Expr(lambda scope: F.count(f.build(scope)), aggregate=True, counted=(f,))


def avg(prop, distinct: bool = False) -> Expr:
    f = as_field(prop)
    if not distinct:
        return Expr(lambda scope: F.avg(f.build(scope)), aggregate=True)
    return Expr(
        lambda scope: F.try_divide(
            F.sum_distinct(f.build(scope)), F.count_distinct(f.build(scope))
        ),
        aggregate=True,
    )


def rows(alias: str | None = None) -> Expr:
    """Number of rows, or the number in which the aliased side of an outer join exists."""
    if alias is None:
        return Expr(lambda scope: F.count(F.lit(1)), aggregate=True, counted=(None,))

    def build(scope):
        source = scope.sources[alias]
        if source.spec and source.spec.primary_key:
            return F.count(scope.qualified(alias, source.spec.primary_key[0]))
        present = F.coalesce(
            *[F.when(scope.qualified(alias, p).isNotNull(), F.lit(1)) for p in source.props]
        )
        return F.count(present)

    return Expr(build, aggregate=True)


def aggregate(name: str, prop) -> Expr:
    """Any aggregate Spark knows by name."""
    f = as_field(prop)
    return Expr(lambda scope: F.call_function(name, f.build(scope)), aggregate=True)
