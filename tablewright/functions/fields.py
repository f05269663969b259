"""Fields: property names, literals, arithmetic, text and named functions.

A field is written before the query that uses it is known, so it is kept as a function of the
query's name scope and becomes a plain Spark column when the query is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.scope import Scope
from tablewright.schema import spark_type

NUMBERS = (int, float, Decimal)
DATES = (dt.date, dt.datetime)


class Expr:
    """A column that still has to be looked up in a scope. `prop` is the property it stands for,
    if it is no more than that; `aggregate` tells that it combines rows, and `counted` what it counts, if it
    is a plain count: a field, or None within a tuple for rows."""

    def __init__(
        self,
        build: Callable[[Scope], Column],
        label: str | None = None,
        prop: str = "",
        aggregate: bool = False,
        counted: tuple | None = None,
    ):
        self.build = build
        self.label = label
        self.prop = prop
        self.aggregate = aggregate
        self.counted = counted

    def as_(self, label: str) -> Expr:
        return Expr(self.build, label, self.prop, self.aggregate, self.counted)

    def _with(self, other: Any, combine: Callable[[Column, Column], Column]) -> Expr:
        return Expr(
            lambda scope: combine(self.build(scope), to_col(other, scope)),
            aggregate=self.aggregate,
        )

    def add(self, other) -> Expr:
        return self._with(other, lambda a, b: a + b)

    def subtract(self, other) -> Expr:
        return self._with(other, lambda a, b: a - b)

    def multiply(self, other) -> Expr:
        return self._with(other, lambda a, b: a * b)

    def divide(self, other) -> Expr:
        """Division by zero gives NULL, not an error that ends the whole job."""
        return self._with(other, F.try_divide)

    def modulo(self, other) -> Expr:
        return self._with(other, F.try_mod)

    def bit_and(self, other) -> Expr:
        return self._with(other, lambda a, b: a.bitwiseAND(b))

    def bit_or(self, other) -> Expr:
        return self._with(other, lambda a, b: a.bitwiseOR(b))

    def bit_xor(self, other) -> Expr:
        return self._with(other, lambda a, b: a.bitwiseXOR(b))

    def concat(self, other) -> Expr:
        return self._with(other, F.concat)

    def __radd__(self, other) -> Expr:
        return self._with(other, lambda a, b: b + a)

    def __rsub__(self, other) -> Expr:
        return self._with(other, lambda a, b: b - a)

    def __rmul__(self, other) -> Expr:
        return self._with(other, lambda a, b: b * a)

    __add__ = add
    __sub__ = subtract
    __mul__ = multiply
    __truediv__ = divide
    __mod__ = modulo
    __and__ = bit_and
    __or__ = bit_or
    __xor__ = bit_xor


def lit(value: Any) -> Column:
    """A value as a column. A date-time without a zone is a wall-clock time, as in the tables,
    whatever zone the session or this machine has."""
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def to_col(value: Any, scope: Scope) -> Column:
    """Operand of an arithmetic or comparison field: a name is a property, the rest a value."""
    if isinstance(value, Expr):
        return value.build(scope)
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return scope.resolve(value)
    return lit(value)


def argument(value: Any, scope: Scope) -> Column:
    """Argument of a named function: text in single quotes is a property, other text a literal."""
    if value is None:
        return F.lit(None)
    if isinstance(value, Expr | Column):
        return to_col(value, scope)
    if isinstance(value, str):
        name = quoted_property(value)
        return F.lit(value) if name is None else scope.resolve(name)
    if isinstance(value, NUMBERS + DATES):
        return lit(value)
    raise TypeError(f"unsupported argument type {type(value).__name__}")


def quoted_property(value: str) -> str | None:
    quoted = len(value) > 2 and value.startswith("'") and value.endswith("'")
    return value[1:-1] if quoted else None


def field(name: str) -> Expr:
    return Expr(lambda scope: scope.resolve(name), name.rpartition(".")[2], name)


def outer(name: str) -> Expr:
    """A property of the enclosing query. Any alias the subquery does not have itself is looked
    up there, so the two must use different aliases."""

    def build(scope: Scope) -> Column:
        alias, _ = scope.split(name)
        if alias is None or (alias in scope.sources and not scope.enclosing):
            raise ValueError(f"{name!r} does not name an alias of the enclosing query")
        return scope.resolve(name)

    return Expr(build, prop=name)


def pk(alias: str | None = None) -> Expr:
    """First primary-key column of an aliased table (the root by default)."""

    def build(scope: Scope) -> Column:
        return scope.qualified(alias or scope.root, scope.spec(alias).primary_key[0])

    return Expr(build)


def literal(value: Any) -> Expr:
    return Expr(lambda scope: lit(value))


def param(value: Any, declared: Any) -> Expr:
    """A value with a type of its own, given as a type code, a Python type or a Spark type."""
    return Expr(lambda scope: lit(value).cast(spark_type(declared)))


def raw(text: str) -> Expr:
    return Expr(lambda scope: F.expr(text))


def add(prop, other) -> Expr:
    return as_field(prop).add(other)


def subtract(prop, other) -> Expr:
    return as_field(prop).subtract(other)


def multiply(prop, other) -> Expr:
    return as_field(prop).multiply(other)


def divide(prop, other) -> Expr:
    return as_field(prop).divide(other)


def mod(prop, other) -> Expr:
    return as_field(prop).modulo(other)


def bit_and(prop, other) -> Expr:
    return as_field(prop).bit_and(other)


def bit_or(prop, other) -> Expr:
    return as_field(prop).bit_or(other)


def bit_xor(prop, other) -> Expr:
    return as_field(prop).bit_xor(other)


def concat(prop, *others) -> Expr:
    """Joined text; NULL if any part is NULL."""
    parts = [as_field(prop), *others]
    return Expr(lambda scope: F.concat(*[to_col(p, scope) for p in parts]))


def func(name: str, *args) -> Expr:
    """Any function Spark knows by name, built in or registered."""
    combines = any(isinstance(a, Expr) and a.aggregate for a in args)
    return Expr(
        lambda scope: F.call_function(name, *[argument(a, scope) for a in args]),
        aggregate=combines,
    )


def template(pattern: str, *args) -> Expr:
    r"""SQL text with `?` slots for properties and values; `\?` stays a question mark.

    With more slots than arguments the last argument fills the remaining slots.
    """

    def build(scope: Scope) -> Column:
        values = [_slot(a, scope) for a in args]
        pieces, used = [], 0
        for i, part in enumerate(pattern.split("?")):
            if i == 0 or not values:
                pieces.append(part if i == 0 else "?" + part)
            elif pieces[-1].endswith("\\"):
                pieces[-1] = pieces[-1][:-1]
                pieces.append("?" + part)
            else:
                pieces.append(values[min(used, len(values) - 1)] + part)
                used += 1
        return F.expr("".join(pieces))

    return Expr(build)


def _slot(value: Any, scope: Scope) -> str:
    """SQL text for one template slot, with names and values quoted."""
    if isinstance(value, Expr) and value.prop:
        value = f"'{value.prop}'"
    if isinstance(value, str) and (name := quoted_property(value)) is not None:
        alias, prop = scope.split(name)
        alias = alias or scope.owner(prop)
        return f"`{alias}`.`{prop}`" if alias else f"`{prop}`"
    return sql_literal(value)


def sql_literal(value: Any) -> str:
    """A value as SQL text, quoted and escaped."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, NUMBERS):
        return str(value)
    raise TypeError(f"not a property or a plain value: {type(value).__name__}")


def as_field(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, str):
        return field(value)
    return Expr(lambda scope: to_col(value, scope))
