"""Updates as rewrites of a table: every right side reads the old row, rows for which the
condition is not true stay as they are."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tablewright.functions.fields import Expr, as_field, lit, to_col
from tablewright.functions.predicates import Condition, and_, as_condition
from tablewright.functions.scope import Scope, Source
from tablewright.operators.change import Change, TableChange, planned
from tablewright.operators.checks import require_keys
from tablewright.operators.filters import flagged, join_flags, where
from tablewright.operators.joins import apart
from tablewright.schema import TableSpec
from tablewright.session import settle
from tablewright.sources.tables import HIT


@dataclass(frozen=True)
class Lookup:
    """New values from a subquery, by equal keys."""

    prop: str
    query: Any
    on: tuple[tuple[str, str], ...]
    value: str


@dataclass(frozen=True)
class Update:
    tables: Any
    spec: TableSpec
    alias: str
    conditions: tuple[Condition, ...] = ()
    sets: dict[str, Any] = field(default_factory=dict)
    lookups: tuple[Lookup, ...] = ()

    def filter(self, condition) -> Update:
        return replace(self, conditions=(*self.conditions, as_condition(condition)))

    def set(self, prop: str, value: Any) -> Update:
        """Set to a value, a field, or the one value of a subquery."""
        return replace(self, sets={**self.sets, prop: value})

    def set_property(self, prop: str, other: str) -> Update:
        return self.set(prop, as_field(other))

    def set_from(self, prop: str, query, on: Sequence[tuple[str, str]], value: str) -> Update:
        """Set to the subquery's `value` for the row's key, `on=[(property, label), ...]`; NULL
        without a match, an error with several."""
        lookup = Lookup(prop, query, tuple(on), value)
        return replace(self, lookups=(*self.lookups, lookup))

    def plan(self) -> Change:
        target = self.tables.table(self.spec.name).alias(self.alias)
        scope = Scope(self.alias, {self.alias: Source(tuple(target.columns), self.spec)})
        condition = and_(*self.conditions)
        values = replace(scope, flags=[])
        new = {prop: self._value(v, values) for prop, v in self.sets.items()}
        joined, hit = flagged(join_flags(target, values), condition, scope)
        for i, lookup in enumerate(self.lookups):
            joined, new[lookup.prop] = self._looked_up(joined, lookup, i, scope)
        columns = []
        for f in target.schema:
            old = scope.resolve(f.name)
            if f.name in new:
                fresh = new[f.name].cast(f.dataType)
                old = F.when(hit, fresh).otherwise(old)
            columns.append(old.alias(f.name))
        marked = joined.select(*columns, F.coalesce(hit, F.lit(False)).alias(HIT))
        affected = where(target, condition, scope).select(f"{self.alias}.*")
        part = TableChange(marked.drop(HIT), affected, frozenset(new), marked)
        return planned(self.tables, {self.spec.name: part})

    @staticmethod
    def _value(value: Any, scope: Scope) -> Column:
        if isinstance(value, Expr | Column):
            return to_col(value, scope)
        return value.scalar(scope) if hasattr(value, "scalar") else lit(value)

    def _looked_up(self, joined: DataFrame, lookup: Lookup, i: int, scope: Scope):
        frame, source = self.tables.source(lookup.query)
        keys = [F.col(f"`{label}`").alias(f"_k{j}") for j, (_, label) in enumerate(lookup.on)]
        names = [F.col(f"_k{j}") for j in range(len(keys))]
        value = F.col(f"`{lookup.value}`")
        if source.covers_key(label for _, label in lookup.on):
            values = frame.select(*keys, value.alias("_v"), F.lit(1).alias("_n"))
            values = apart(values, *names) if source.grouped else values
        else:
            counted = F.count(F.lit(1)).alias("_n")
            values = frame.groupBy(*keys).agg(F.any_value(value).alias("_v"), counted)
            values = apart(values, *names)
        found = f"_found{i}"
        on = [
            scope.resolve(prop) == F.col(f"{found}._k{j}")
            for j, (prop, _) in enumerate(lookup.on)
        ]
        several = F.raise_error(F.lit(f"more than one value for {lookup.prop}"))
        result = F.when(F.col(f"{found}._n") > 1, several).otherwise(F.col(f"{found}._v"))
        condition = functools.reduce(Column.__and__, on)
        return joined.join(values.alias(found), condition, "left"), result


def update_by_key(
    tables,
    spec: TableSpec,
    changes: DataFrame,
    exclude: Sequence[str] = (),
    selector: str = "NON_NULL",
) -> Change:
    """Update rows from a frame of changed rows, matched by primary key.

    The selected properties of a change replace the old ones; a change without a row does
    nothing; a NULL or repeated key in the changes is an error. The changes are written once,
    since they are read for the check, the count and the new table.
    """
    key = list(spec.primary_key)
    skipped = {*exclude, *key}
    props = [p for p in changes.columns if p not in skipped and p in spec.props]
    changes = settle(changes.select(*[f"`{p}`" for p in (*key, *props)]), "changes")
    require_keys(changes, spec)
    target = tables.table(spec.name).alias("t")
    fresh = changes.select(*key, *props, F.lit(True).alias("_matched")).alias("c")
    on = functools.reduce(Column.__and__, [F.col(f"t.`{k}`") == F.col(f"c.`{k}`") for k in key])
    columns = []
    for f in target.schema:
        old, new = F.col(f"t.`{f.name}`"), F.col(f"c.`{f.name}`")
        if f.name in props:
            new = new.cast(f.dataType)
            if selector == "ALL":
                old = F.when(F.col("c._matched"), new).otherwise(old)
            elif selector == "NON_NULL":
                old = F.coalesce(new, old)
            elif selector == "NON_NULL_OR_ZERO":
                numeric = isinstance(f.dataType, NumericType)
                old = F.coalesce(F.nullif(new, F.lit(0)) if numeric else new, old)
            else:
                raise ValueError(f"unknown selector {selector!r}")
        columns.append(old.alias(f.name))
    hit = F.coalesce("c._matched", F.lit(False)).alias(HIT)
    marked = target.join(fresh, on, "left").select(*columns, hit)
    affected = target.join(fresh, on, "left_semi")
    part = TableChange(marked.drop(HIT), affected, frozenset(props), marked)
    return planned(tables, {spec.name: part})
