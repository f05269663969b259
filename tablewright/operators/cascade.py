"""Deletes and key changes, and what they do to the tables that refer to the changed one.

Doomed rows and changed keys stay DataFrames throughout. A table on the way down gives its
children only the columns they refer to; those are unique by declaration, so children join them
without repeated keys, and a child key held by a large share of rows is on the side that adaptive
plans split.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.fields import Expr, to_col
from tablewright.functions.predicates import Condition, and_, as_condition
from tablewright.functions.scope import Scope, Source
from tablewright.operators.change import Change, TableChange, planned
from tablewright.operators.filters import flagged, has_subquery, where
from tablewright.operators.generators import default_value
from tablewright.operators.joins import apart, lookup, thin
from tablewright.schema import ForeignKey, TableSpec
from tablewright.session import settle


class ForeignKeyViolation(ValueError):
    pass


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return functools.reduce(
        Column.__and__, [a == b for a, b in zip(left, right, strict=True)]
    )


def _cols(props: Sequence[str]) -> list[Column]:
    return [F.col(f"`{p}`") for p in props]


def _refs(parent_rows: DataFrame, fk: ForeignKey) -> DataFrame:
    """The referred key values as `_ref0`, `_ref1`, ..."""
    return parent_rows.select(
        *[F.col(f"`{p}`").alias(f"_ref{i}") for i, p in enumerate(fk.ref_props)]
    )


def _referring(child: DataFrame, fk: ForeignKey, parent_rows: DataFrame, how: str) -> DataFrame:
    on = _same(_cols(fk.props), [F.col(f"_ref{i}") for i in range(len(fk.props))])
    return child.join(_refs(parent_rows, fk), on, how)


@dataclass(frozen=True)
class Delete:
    tables: Any
    spec: TableSpec
    alias: str
    conditions: tuple[Condition, ...] = ()
    joins: tuple[tuple[Any, str, Any, str], ...] = ()
    keys: DataFrame | None = None

    def filter(self, condition) -> Delete:
        return replace(self, conditions=(*self.conditions, as_condition(condition)))

    def join(self, source, alias: str, on, how: str = "inner") -> Delete:
        return replace(self, joins=(*self.joins, (source, alias, on, how)))

    def inner_join(self, source, alias: str, on) -> Delete:
        return self.join(source, alias, on)

    def cross_join(self, source, alias: str, on) -> Delete:
        return self.join(source, alias, on)

    def left_join(self, source, alias: str, on) -> Delete:
        return self.join(source, alias, on, "left")

    def right_join(self, source, alias: str, on) -> Delete:
        return self.join(source, alias, on, "right")

    def full_join(self, source, alias: str, on) -> Delete:
        return self.join(source, alias, on, "full")

    def matching(self, keys: DataFrame) -> Delete:
        """Only rows whose primary key is in the frame."""
        return replace(self, keys=keys)

    # ---- which rows go -------------------------------------------------------------------

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """The rows that stay and the rows that go."""
        target = self.tables.table(self.spec.name)
        if self.keys is not None:
            return self._split_by_keys(target, self.keys)
        if not self.joins:
            return self._split_by_filter(target.alias(self.alias), self._scope(target))
        if len(self.joins) == 1 and self.joins[0][3] == "inner":
            split = self._split_by_match(target)
            if split:
                return split
        query = self.tables.query(self.spec.name, self.alias)
        alone = len(self.joins) == 1 and not self.conditions
        for source, alias, on, how in self.joins:
            query = query.met(source, alias, on) if alone and how == "inner" else query.join(source, alias, on, how)
        for condition in self.conditions:
            query = query.filter(condition)
        key = [F.col(f"{self.alias}.`{p}`") for p in self._key()]
        hits = query.rows_frame().select(*key).where(key[0].isNotNull())
        return self._split_by_keys(target, hits)

    def _split_by_filter(self, target: DataFrame, scope: Scope):
        condition, own = and_(*self.conditions), f"{self.alias}.*"
        go = where(target, condition, scope).select(own)
        marked, hit = flagged(target, condition, scope)
        return marked.where(~F.coalesce(hit, F.lit(False))).select(own), go

    def _scope(self, target: DataFrame) -> Scope:
        return Scope(self.alias, {self.alias: Source(tuple(target.columns), self.spec)})

    def _key(self) -> tuple[str, ...]:
        if not self.spec.primary_key:
            raise ValueError(f"{self.spec.name} has no primary key to delete by")
        return self.spec.primary_key

    def _split_by_keys(self, target: DataFrame, keys: DataFrame):
        names = [f"_key{i}" for i in range(len(self._key()))]
        hits = thin(keys, *[F.col(f"`{p}`").alias(n) for p, n in zip(self._key(), names)])
        on = _same(_cols(self._key()), _cols(names))
        return target.join(hits, on, "left_anti"), target.join(hits, on, "left_semi")

    def _split_by_match(self, target: DataFrame):
        """One inner join: a row goes if it has a partner, so no pair is ever produced.

        Not for conditions beyond equal keys against a side that repeats them, if each row here
        has keys of its own: then the pairs are no more than that side's rows, and joining them
        lets a hot key be split.
        """
        source, alias, on, _ = self.joins[0]
        frame, described = self.tables.source(source)
        scope = Scope(self.alias, {**self._scope(target).sources, alias: described})
        parts = list(on) if isinstance(on, list | tuple) else [on]
        pairs = [p for p in parts if isinstance(p, tuple)]
        more = [as_condition(p) for p in parts if not isinstance(p, tuple)]
        more += self.conditions
        if not pairs and not any(p.sides for c in more for p in c.parts):
            return None  # tied by a range alone: the pairs are found first, and the rows by their keys
        if any(has_subquery(c, scope) for c in more):
            return None  # a semi or anti join of its own, which is no part of another's condition
        here, there = [[scope.split(p[i])[1] for p in pairs] for i in (0, 1)]
        repeats = not described.covers_key(there)
        if more and repeats and pairs and self.spec.covers_key(here):
            return None
        left = target.alias(self.alias)
        if pairs and not more:
            right = lookup(frame, described, *there)
            tests = [scope.resolve(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)]
        else:
            if pairs and described.grouped:
                frame = apart(frame, *_cols(there))
            right = frame.alias(alias)
            tests = [scope.resolve(a) == scope.resolve(b) for a, b in pairs]
            tests += [c.holds(scope) for c in more]
        condition = functools.reduce(Column.__and__, tests)
        return left.join(right, condition, "left_anti"), left.join(right, condition, "left_semi")

    # ---- what happens to other tables ----------------------------------------------------

    def plan(self) -> Change:
        """Only this table."""
        stay, go = self._split()
        return planned(self.tables, {self.spec.name: TableChange(stay, go)})

    def cascade(self) -> Change:
        """Also all rows that refer to a deleted row, at every level, whatever the declared
        action is."""
        return self._walk(forced="CASCADE")

    def with_actions(self) -> Change:
        """Also what the foreign keys declare for a delete."""
        return self._walk(forced=None)

    def _walk(self, forced: str | None) -> Change:
        catalog, root = self.tables.catalog, self.spec.name
        reached = _reached(catalog, root)
        if reached is None:
            if forced != "CASCADE":
                raise ValueError(f"foreign keys below {root} form a cycle: use cascade()")
            return _cascade_cycle(self)
        stay, go = self._split()
        gone = {root: _kept_for_children(self.tables, self.spec, go)}
        parts = {root: TableChange(stay, go)}
        for name in reached[1:]:
            spec = catalog[name]
            keys = [fk for fk in spec.foreign_keys if fk.ref_table in gone]
            child = self.tables.table(name)
            taken, changed = [], []
            remaining = child
            actions = {fk: forced or fk.on_delete for fk in keys}
            for fk in keys:
                if actions[fk] == "CASCADE":
                    doomed = gone[fk.ref_table]
                    taken.append(_referring(remaining, fk, doomed, "left_semi"))
                    remaining = _referring(remaining, fk, doomed, "left_anti")
            for fk in keys:
                if actions[fk] in ("SET_NULL", "SET_DEFAULT"):
                    changed.append(_referring(remaining, fk, gone[fk.ref_table], "left_semi"))
                    parent = catalog[fk.ref_table]
                    doomed = gone[fk.ref_table]
                    remaining = _reset(remaining, spec, parent, fk, doomed, actions[fk])
                elif actions[fk] == "NO_ACTION":
                    left = _referring(remaining, fk, gone[fk.ref_table], "left_semi")
                    if not left.isEmpty():
                        raise ForeignKeyViolation(f"{name}{fk.props} refers to deleted rows")
            if not taken and not changed:
                continue
            affected = functools.reduce(DataFrame.union, taken + changed)
            reset = {p for fk in keys if actions[fk].startswith("SET") for p in fk.props}
            parts[name] = TableChange(remaining, affected, frozenset(reset))
            if taken:
                removed = functools.reduce(DataFrame.union, taken)
                gone[name] = _kept_for_children(self.tables, spec, removed)
        return planned(self.tables, parts)


def _below(catalog, root: str) -> set[str]:
    """The root and all tables that refer to it, by others too."""
    below: set[str] = set()
    todo = [root]
    while todo:
        name = todo.pop()
        if name not in below:
            below.add(name)
            todo += [spec.name for spec, _ in catalog.children(name)]
    return below


def _reached(catalog, root: str) -> list[str] | None:
    """The root and all tables below it, parents first; None if they form a cycle."""
    below = _below(catalog, root)
    order: list[str] = []
    while len(order) < len(below):
        ready = [
            n
            for n in catalog.specs
            if n in below
            and n not in order
            and all(
                fk.ref_table in order or fk.ref_table not in below
                for fk in catalog[n].foreign_keys
            )
        ]
        if not ready:
            return None
        order += ready
    return order


def _kept_for_children(tables, spec: TableSpec, go: DataFrame) -> DataFrame:
    """The deleted rows' columns that children refer to. Written once if there are children,
    since each of them reads it."""
    children = tables.catalog.children(spec.name)
    if not children:
        return go
    wanted = dict.fromkeys(p for _, fk in children for p in fk.ref_props)
    return settle(go.select(*_cols(list(wanted))), f"gone-{spec.name}")


def _reset(
    child: DataFrame,
    spec: TableSpec,
    parent: TableSpec,
    fk: ForeignKey,
    doomed: DataFrame,
    action: str,
) -> DataFrame:
    """Put NULL or the declared default where the child refers to a doomed row."""
    marked = _refs(doomed, fk).withColumn("_reset", F.lit(True))
    if not parent.covers_key(fk.ref_props):
        marked = apart(marked.distinct(), F.col("_ref0"))
    on = _same(_cols(fk.props), [F.col(f"_ref{i}") for i in range(len(fk.props))])
    joined = child.join(marked, on, "left")
    columns = []
    for f in child.schema:
        value = F.col(f"`{f.name}`")
        if f.name in fk.props:
            fresh = default_value(spec.column(f.name)) if action == "SET_DEFAULT" else F.lit(None)
            fresh = fresh.cast(f.dataType)
            value = F.when(F.col("_reset"), fresh).otherwise(value).alias(f.name)
        columns.append(value)
    return joined.select(*columns)


def _cascade_cycle(delete: Delete) -> Change:
    """Cascade over foreign keys that form a cycle. If every table refers to one other, or to itself, a
    row's references are a chain, which is followed by doubling. Else follow references from the
    newly doomed rows until a round finds none. Each round is written out, so the plan does not
    grow with the number of rounds."""
    tables, catalog = delete.tables, delete.tables.catalog
    below = _below(catalog, delete.spec.name)
    upward = {n: [fk for fk in catalog[n].foreign_keys if fk.ref_table in below] for n in sorted(below)}
    if all(len(keys) <= 1 for keys in upward.values()):
        return _cascade_chains(delete, {n: keys[0] for n, keys in upward.items() if keys})
    _, go = delete._split()

    def handles(spec: TableSpec, rows: DataFrame) -> DataFrame:
        if not spec.primary_key:
            raise ValueError(f"{spec.name} is on a cycle and needs a primary key")
        referred = [p for _, fk in catalog.children(spec.name) for p in fk.ref_props]
        return rows.select(*_cols(list(dict.fromkeys([*spec.primary_key, *referred]))))

    frontier = {delete.spec.name: settle(handles(delete.spec, go), "doomed")}
    doomed = dict(frontier)
    while frontier:
        found: dict[str, list[DataFrame]] = {}
        for parent, rows in frontier.items():
            for spec, fk in catalog.children(parent):
                hits = _referring(tables.table(spec.name), fk, rows, "left_semi")
                found.setdefault(spec.name, []).append(handles(spec, hits))
        frontier = {}
        for name, frames in found.items():
            key = list(catalog[name].primary_key)
            fresh = functools.reduce(DataFrame.union, frames).dropDuplicates(key)
            if name in doomed:
                fresh = fresh.join(doomed[name].select(*_cols(key)), key, "left_anti")
            fresh = settle(fresh.select(*handles(catalog[name], fresh).columns), "doomed")
            if not fresh.isEmpty():
                frontier[name] = fresh
        for name, fresh in frontier.items():
            doomed[name] = doomed[name].union(fresh) if name in doomed else fresh
    parts = {}
    for name, rows in doomed.items():
        key = list(catalog[name].primary_key)
        table, gone = tables.table(name), rows.select(*_cols(key))
        parts[name] = TableChange(
            table.join(gone, key, "left_anti").select(*table.columns),
            table.join(gone, key, "left_semi").select(*table.columns),
        )
    return planned(delete.tables, parts)


def _node(spec: TableSpec, values: Sequence[Column]) -> Column:
    """A row's table and primary key as text; NULL if a part of the key is."""
    if not spec.primary_key:
        raise ValueError(f"{spec.name} is on a cycle and needs a primary key")
    kinds = [spec.column(p).data_type for p in spec.primary_key]
    key = F.to_json(F.struct(*[v.cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))]))
    known = functools.reduce(Column.__and__, [v.isNotNull() for v in values])
    return F.when(known, F.concat(F.lit(f"{spec.name}:"), key))


def _cascade_chains(delete: Delete, upward: dict[str, ForeignKey]) -> Change:
    """Every row points to the row it refers to. A round lets each row that is not doomed look at the row
    it points to, take over its doom, and point to where that one points: after n rounds a row has
    looked 2^n references up. When a round dooms none, no row is left that has a doomed one above it. Rows
    that point nowhere any more drop out."""
    tables, catalog = delete.tables, delete.tables.catalog
    _, go = delete._split()
    root = delete.spec
    pointers = []
    for name, fk in upward.items():
        spec, parent = catalog[name], catalog[fk.ref_table]
        rows = tables.table(name)
        node = _node(spec, _cols(spec.primary_key)).alias("node")
        if set(fk.ref_props) == set(parent.primary_key):
            at = dict(zip(fk.ref_props, fk.props, strict=True))
            pointers.append(rows.select(node, _node(parent, _cols([at[p] for p in parent.primary_key])).alias("up")))
            continue
        referred = tables.table(fk.ref_table)
        keys = referred.select(
            *[F.col(f"`{p}`").alias(f"_ref{i}") for i, p in enumerate(fk.ref_props)],
            _node(parent, _cols(parent.primary_key)).alias("_up"),
        )
        own = [c.alias(f"_own{i}") for i, c in enumerate(_cols(fk.props))]
        on = _same([F.col(f"_own{i}") for i in range(len(own))], [F.col(f"_ref{i}") for i in range(len(own))])
        pointers.append(rows.select(node, *own).join(keys, on).select("node", F.col("_up").alias("up")))
    first = go.select(_node(root, _cols(root.primary_key)).alias("node")).distinct()
    first = settle(first, "doomed")
    links = functools.reduce(DataFrame.union, pointers).where("up IS NOT NULL")
    links = links.join(first, "node", "left_anti").withColumn("doomed", F.lit(False))
    ends = first.select("node", F.lit(None).cast("string").alias("up"), F.lit(True).alias("doomed"))
    state, found, more = settle(ends.unionByName(links), "chains"), first.count(), True
    while more:
        above = state.toDF("_node", "_up", "_doomed")
        state = settle(
            state.join(above, F.col("up") == F.col("_node"), "left")
            .select(
                "node",
                F.when(F.coalesce("_doomed", F.lit(False)), None).otherwise(F.col("_up")).alias("up"),
                (F.col("doomed") | F.coalesce("_doomed", F.lit(False))).alias("doomed"),
            )
            .where("doomed OR up IS NOT NULL"),
            "chains",
        )
        hits = state.where("doomed").count()
        more, found = hits > found, hits
    doomed = state.where("doomed").select(F.col("node").alias("_node"))
    hit = {r[0] for r in doomed.select(F.substring_index("_node", ":", 1)).distinct().collect()}  # tables
    parts = {}
    for name in dict.fromkeys([root.name, *(n for n in upward if n.partition(":")[0] in hit)]):
        spec, table = catalog[name], tables.table(name)
        on = _node(spec, _cols(spec.primary_key)) == F.col("_node")
        parts[name] = TableChange(table.join(doomed, on, "left_anti"), table.join(doomed, on, "left_semi"))
    return planned(tables, parts)


@dataclass(frozen=True)
class KeyUpdate:
    """New values for columns that other tables refer to."""

    tables: Any
    spec: TableSpec
    sets: dict[str, Any] = field(default_factory=dict)
    conditions: tuple[Condition, ...] = ()

    def set(self, prop: str, value: Any) -> KeyUpdate:
        return replace(self, sets={**self.sets, prop: value})

    def filter(self, condition) -> KeyUpdate:
        return replace(self, conditions=(*self.conditions, as_condition(condition)))

    def plan(self) -> Change:
        target = self.tables.table(self.spec.name).alias("t")
        scope = Scope("t", {"t": Source(tuple(target.columns), self.spec)})
        condition = and_(*self.conditions)
        marked, hit = flagged(target, condition, scope)
        new = {
            p: (to_col(v, scope) if isinstance(v, Expr | Column) else F.lit(v)).cast(
                target.schema[p].dataType
            )
            for p, v in self.sets.items()
        }
        changed = {p: F.when(hit, c).otherwise(scope.resolve(p)) for p, c in new.items()}
        frame = marked.select(
            *[changed.get(c, scope.resolve(c)).alias(c) for c in target.columns]
        )
        affected = where(target, condition, scope).select("t.*")
        moved = affected.alias("t").select(
            "*", *[c.alias(f"_new_{p}") for p, c in new.items()]
        )
        parts = {self.spec.name: TableChange(frame, affected, frozenset(new))}
        self._propagate(self.spec, moved, set(new), parts, (self.spec.name,))
        return planned(self.tables, parts)

    def _propagate(self, spec: TableSpec, moved: DataFrame, props: set[str], parts, path) -> None:
        """Apply the `on_update` actions below `spec`, given its changed rows with the new value
        of each changed property `p` as `_new_p`."""
        catalog = self.tables.catalog
        for child_spec, fk in catalog.children(spec.name):
            if not props & set(fk.ref_props):
                continue
            if child_spec.name in path:
                raise ValueError(f"key changes of {path} reach {child_spec.name} again")
            remap = settle(self._remap(moved, fk, props), f"moved-{spec.name}")
            name = child_spec.name
            child = parts[name].frame if name in parts else self.tables.table(name)
            on = _same(_cols(fk.props), [F.col(f"_ref{i}") for i in range(len(fk.props))])
            touched = child.join(remap, on, "left_semi")
            if fk.on_update == "NO_ACTION":
                if not touched.isEmpty():
                    raise ForeignKeyViolation(f"{name}{fk.props} refers to changed keys")
                continue
            joined = child.join(remap, on, "left")
            values = {p: self._child_value(child_spec, fk, i) for i, p in enumerate(fk.props)}
            frame = joined.select(
                *[
                    values[f.name].cast(f.dataType).alias(f.name)
                    if f.name in values
                    else F.col(f"`{f.name}`")
                    for f in child.schema
                ]
            )
            affected, changed = touched, frozenset(fk.props)
            if name in parts:
                affected = parts[name].affected.union(touched)
                changed |= parts[name].changed
            parts[name] = TableChange(frame, affected, changed)
            below = child.join(remap, on, "inner").select(
                *_cols(child.columns), *[v.alias(f"_new_{p}") for p, v in values.items()]
            )
            self._propagate(child_spec, below, set(fk.props), parts, (*path, name))

    @staticmethod
    def _remap(moved: DataFrame, fk: ForeignKey, props: set[str]) -> DataFrame:
        """Old and new referred values as `_ref0`, `_to0`, ..., for keys that really change."""
        old = [F.col(f"`{p}`") for p in fk.ref_props]
        new = [F.col(f"_new_{p}") if p in props else F.col(f"`{p}`") for p in fk.ref_props]
        differs = functools.reduce(
            Column.__or__, [~a.eqNullSafe(b) for a, b in zip(old, new, strict=True)]
        )
        return moved.where(differs).select(
            *[c.alias(f"_ref{i}") for i, c in enumerate(old)],
            *[c.alias(f"_to{i}") for i, c in enumerate(new)],
            F.lit(True).alias("_moved"),
        )

    @staticmethod
    def _child_value(spec: TableSpec, fk: ForeignKey, i: int) -> Column:
        prop = fk.props[i]
        if fk.on_update == "CASCADE":
            fresh = F.col(f"_to{i}")
        else:
            set_default = fk.on_update == "SET_DEFAULT"
            fresh = default_value(spec.column(prop)) if set_default else F.lit(None)
        return F.when(F.col("_moved"), fresh).otherwise(F.col(f"`{prop}`"))
