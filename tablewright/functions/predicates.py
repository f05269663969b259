"""Conditions with SQL's three-valued logic.

A filter keeps rows for which a condition is true, and `NOT` keeps those for which it is false;
with NULLs these are not complements. Each condition therefore carries both: `holds`, true
exactly where the condition is true, and `fails`, true exactly where it is false. Plain
comparisons get both from Spark. Subquery conditions state each one directly, in the form that
Spark can run as a semi join, an anti join or one pre-computed row (see `operators.subqueries`).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.fields import Expr, as_field, lit, to_col
from tablewright.functions.scope import Scope
from tablewright.schema import TableSpec

Build = Callable[[Scope], Column]

# Operators a free operator string may name.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
    "is distinct from": lambda a, b: ~a.eqNullSafe(b),
    "is not distinct from": lambda a, b: a.eqNullSafe(b),
    "like": F.like,
    "not like": lambda a, b: ~F.like(a, b),
    "rlike": F.rlike,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": F.try_divide,
    "%": F.try_mod,
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
    "||": F.concat,
}


class Condition:
    """`pair` names the two properties of an equality, `sides` are the two fields of one, `order` the fields
    and the symbol of a `<`, `<=`, `>`, `>=` or `<>`; `parts` are the conditions that AND ties together; `is_subquery` marks a bare EXISTS or IN, or its negation, which as a filter of its
    own is a semi or anti join."""

    def __init__(
        self, holds: Build, fails: Build | None = None, parts=None, is_subquery: bool = False
    ):
        self.holds = holds
        self.fails = fails or (lambda scope: ~holds(scope))
        self.pair: tuple[str, str] | None = None
        self.sides: tuple[Expr, Expr] | None = None
        self.order: tuple[Expr, str, Expr] | None = None
        self.is_subquery = is_subquery
        self.parts: tuple[Condition, ...] = parts or (self,)

    def __and__(self, other) -> Condition:
        b = as_condition(other)
        return Condition(
            lambda scope: self.holds(scope) & b.holds(scope),
            lambda scope: self.fails(scope) | b.fails(scope),
            parts=self.parts + b.parts,
        )

    def __or__(self, other) -> Condition:
        b = as_condition(other)
        return Condition(
            lambda scope: self.holds(scope) | b.holds(scope),
            lambda scope: self.fails(scope) & b.fails(scope),
        )

    def __invert__(self) -> Condition:
        return Condition(self.fails, self.holds, is_subquery=self.is_subquery)

    def and_(self, other) -> Condition:
        return self & other

    def or_(self, other) -> Condition:
        return self | other

    def not_(self) -> Condition:
        return ~self

    def wrap(self) -> Condition:
        """Parentheses: a condition is a tree and groups as written, so nothing changes."""
        return self


def as_condition(value: Any) -> Condition:
    if isinstance(value, Condition):
        return value
    if isinstance(value, Expr):
        return Condition(value.build)
    if isinstance(value, Column):
        return Condition(lambda scope: value)
    if isinstance(value, bool):
        return true() if value else false()
    raise TypeError(f"not a condition: {value!r}")


def _operand(value: Any, scope: Scope) -> Column:
    """Right side of a comparison: a subquery's one value, a field, or a bound value."""
    if isinstance(value, Expr | Column):
        return to_col(value, scope)
    return value.scalar(scope) if hasattr(value, "scalar") else lit(value)


def _compare(prop, value, apply: Callable[[Column, Column], Column]) -> Condition:
    left = as_field(prop)
    return Condition(lambda scope: apply(left.build(scope), _operand(value, scope)))


def _ordered(prop, symbol: str, value) -> Condition:
    compared = _compare(prop, value, OPERATORS[symbol])
    if isinstance(value, Expr):
        compared.order = (as_field(prop), symbol, value)
    return compared


def eq(prop, value) -> Condition:
    return _compare(prop, value, lambda a, b: a == b)


def ne(prop, value) -> Condition:
    return _ordered(prop, "<>", value)


def lt(prop, value) -> Condition:
    return _ordered(prop, "<", value)


def gt(prop, value) -> Condition:
    return _ordered(prop, ">", value)


def lte(prop, value) -> Condition:
    return _ordered(prop, "<=", value)


def gte(prop, value) -> Condition:
    return _ordered(prop, ">=", value)


def eq_property(prop, other) -> Condition:
    a, b = as_field(prop), as_field(other)
    equal = eq(a, b)
    equal.pair = (a.prop, b.prop) if a.prop and b.prop else None
    equal.sides = (a, b)
    return equal


def ne_property(prop, other) -> Condition:
    return ne(prop, as_field(other))


def lt_property(prop, other) -> Condition:
    return lt(prop, as_field(other))


def gt_property(prop, other) -> Condition:
    return gt(prop, as_field(other))


def lte_property(prop, other) -> Condition:
    return lte(prop, as_field(other))


def gte_property(prop, other) -> Condition:
    return gte(prop, as_field(other))


def is_null(prop) -> Condition:
    f = as_field(prop)
    return Condition(lambda scope: f.build(scope).isNull())


def is_not_null(prop) -> Condition:
    return ~is_null(prop)


def between(prop, low, high) -> Condition:
    return gte(prop, low) & lte(prop, high)


def in_(prop, values: Iterable) -> Condition:
    """Membership in a list of values. For a large set put the values in a table and use
    `operators.subqueries.in_query`."""
    f = as_field(prop)
    listed = [lit(v) for v in values]
    return Condition(lambda scope: f.build(scope).isin(listed))


def like(prop, pattern: str, mode: str = "ANY_WHERE", escape: str | None = None) -> Condition:
    """Text match. `START` anchors the pattern at the start, `END` at the end; the pattern's own
    `%` and `_` stay wildcards unless escaped."""
    f = as_field(prop)
    shapes = {"START": "{}%", "END": "%{}", "ANY_WHERE": "%{}%"}
    full = shapes[mode].format(pattern)
    char = F.lit(escape) if escape else None
    parts = [part for part in pattern.split("%") if part]
    if mode == "ANY_WHERE" and not escape and len(parts) > 1 and not set(pattern) & {"_", "\\"}:
        return Condition(lambda scope: _in_turn(f.build(scope), parts))
    return Condition(lambda scope: F.like(f.build(scope), F.lit(full), char))


def _in_turn(value: Column, parts: list[str]) -> Column:
    """The parts occur one after the other. Each is searched once from the end of the one before;
    the regular expression behind LIKE would go back over long texts for every occurrence."""
    found = F.position(F.lit(parts[0]), value)
    match = found > 0
    for before, part in zip(parts, parts[1:]):
        found = F.position(F.lit(part), value, found + len(before))
        match = match & (found > 0)
    return F.when(value.isNotNull(), match)


def text(prop: str, suffix: str) -> Condition:
    """A property followed by raw SQL text, e.g. `text("size", "in (1, 2)")`."""

    def build(scope: Scope) -> Column:
        alias, name = scope.split(prop)
        alias = alias or scope.owner(name)
        return F.expr(f"`{alias}`.`{name}` {suffix}" if alias else f"`{name}` {suffix}")

    return Condition(build)


def op(prop, operator: str, other) -> Condition:
    """Two operands joined by an operator given as text."""
    apply = OPERATORS.get(" ".join(operator.lower().split()))
    if apply is None:
        raise ValueError(f"unknown operator {operator!r}")
    return _compare(prop, other, apply)


def true() -> Condition:
    return Condition(lambda scope: F.lit(True))


def false() -> Condition:
    return Condition(lambda scope: F.lit(False))


def and_(*conditions) -> Condition:
    return functools.reduce(Condition.__and__, map(as_condition, conditions), true())


def or_(*conditions) -> Condition:
    if not conditions:
        return true()
    return functools.reduce(Condition.__or__, map(as_condition, conditions))


def not_(condition) -> Condition:
    return ~as_condition(condition)


# The selector names below.
def selected(value: Any, selector: str) -> bool:
    """Whether a property value of an example takes part: `ALL`, `NON_NULL`, or
    `NON_NULL_OR_ZERO`, which leaves out NULLs and zeros."""
    if selector == "ALL":
        return True
    if selector == "NON_NULL":
        return value is not None
    if selector == "NON_NULL_OR_ZERO":
        is_number = isinstance(value, int | float) and not isinstance(value, bool)
        return value is not None and not (is_number and value == 0)
    raise ValueError(f"unknown selector {selector!r}")


def by_example(
    spec: TableSpec,
    example: Mapping[str, Any],
    exclude: Iterable[str] = (),
    selector: str = "NON_NULL",
    alias: str | None = None,
) -> Condition:
    """Rows like the example: by primary key if the example has all of it, else by every
    selected property."""
    prefix = f"{alias}." if alias else ""
    if spec.primary_key and all(example.get(p) is not None for p in spec.primary_key):
        return by_identity(spec, example, alias)
    skipped = set(exclude)
    conditions = []
    for prop in spec.props:
        value = example.get(prop)
        if prop not in skipped and selected(value, selector):
            name = prefix + prop
            conditions.append(is_null(name) if value is None else eq(name, value))
    return and_(*conditions)


def by_identity(spec: TableSpec, example: Mapping[str, Any], alias: str | None = None) -> Condition:
    """The row with the example's primary key."""
    missing = [p for p in spec.primary_key if example.get(p) is None]
    if missing or not spec.primary_key:
        raise ValueError(f"{spec.name}: no identity, key properties {missing} are null")
    prefix = f"{alias}." if alias else ""
    return and_(*[eq(prefix + p, example[p]) for p in spec.primary_key])
