"""Composable queries over declared tables.

A `Query` is immutable. It holds a DataFrame of the joined tables plus what has been asked of it,
and `frame()` states that as one DataFrame plan: join, filter, group, having, order, project,
page. Nothing runs until the frame does.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tablewright.functions import aggregates
from tablewright.functions.fields import Expr, as_field, outer, to_col
from tablewright.functions.predicates import Condition, as_condition, eq_property
from tablewright.functions.scope import Scope, Source
from tablewright.operators import setops
from tablewright.operators.counted import ROWS, Link, counted
from tablewright.operators.filters import where
from tablewright.operators.joins import (
    apart,
    completed,
    split_outer_join,
    thin,
    without_partner,
    written,
)
from tablewright.operators.paging import Sort, page
from tablewright.operators.ranges import met_rows, range_join, reaches
from tablewright.operators.subqueries import linked_value

if TYPE_CHECKING:
    from tablewright.workspace import Workspace

ROOT = "this"

@dataclass(frozen=True)
class Order:
    field: Any
    descending: bool = False
    nulls: str | None = None  # "first" or "last"; None leaves Spark's placement

    def apply(self, column: Column) -> Column:
        direction = "desc" if self.descending else "asc"
        suffix = f"_nulls_{self.nulls}" if self.nulls else ""
        return getattr(column, direction + suffix)()

    def by(self, column: str) -> Sort:
        first = self.nulls == "first" if self.nulls else not self.descending
        return Sort(column, self.descending, first)


# Each comparison with its sides exchanged.
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _tied(scope: Scope, conditions) -> set[frozenset]:
    """Pairs of aliases that an equality among the conditions ties, each side naming one alias."""
    ties = set()
    for part in [p for c in conditions for p in as_condition(c).parts if p.sides]:
        named = []
        for side in part.sides:
            watched = scope.watched()
            side.build(watched)
            named.append(watched.aliases)
        if [len(n) for n in named] == [1, 1] and named[0] != named[1]:
            ties.add(frozenset(named[0] | named[1]))
    return ties


@dataclass(frozen=True)
class Query:
    tables: Workspace
    base: DataFrame
    scope: Scope
    conditions: tuple[Condition, ...] = ()
    items: tuple[tuple[Expr, str | None], ...] = ()
    groups: tuple[Any, ...] = ()
    havings: tuple[Condition, ...] = ()
    orders: tuple[Order, ...] = ()
    is_distinct: bool = False
    frames: tuple[tuple[str, DataFrame], ...] = ()  # by alias, for the keys a table may hold
    loose: tuple[str, ...] = ()  # tables in FROM that filters must tie to the others
    ties: tuple[frozenset, ...] = ()  # aliases that joins tie by an equality
    links: tuple[Link, ...] = ()  # joins by equal keys alone
    page: tuple[int, int] | None = None  # offset, limit

    # ---- sources -------------------------------------------------------------------------

    @staticmethod
    def over(tables: Workspace, source, alias: str = ROOT) -> Query:
        """A query over a declared table (by name), another query, or any DataFrame."""
        frame, described = tables.source(source)
        root = frame.alias(alias)
        return Query(tables, root, Scope(alias, {alias: described}), frames=((alias, root),))

    @staticmethod
    def over_frame(tables: Workspace, frame: DataFrame, described: Source) -> Query:
        root = frame.alias(ROOT)
        return Query(tables, root, Scope(ROOT, {ROOT: described}), frames=((ROOT, root),))

    def from_(self, source, alias: str) -> Query:
        """One more table in FROM. A filter must tie it to the others by an equality of two
        properties; without, the query is refused, since all pairs of two tables are never what is
        wanted at scale."""
        frame, described = self.tables.source(source)
        more = frame.alias(alias)
        return replace(
            self,
            base=self.base.join(more),
            scope=self._scope_with(alias, described),
            frames=(*self.frames, (alias, more)),
            loose=(*self.loose, alias),
        )

    def _scope_with(self, alias: str, described: Source) -> Scope:
        if alias in self.scope.sources:
            raise ValueError(f"alias {alias!r} is taken")
        return Scope(self.scope.root, {**self.scope.sources, alias: described})

    # ---- joins ---------------------------------------------------------------------------

    def join(self, source, alias: str, on, how: str = "inner", split: bool = True) -> Query:
        """Join a table, query or frame. `on` is a condition, or a list of key pairs
        `("left_prop", "alias.prop")` and conditions. An equality of two properties is a key pair
        however it is spelt. Without any, the conditions must compare a property of each side by
        `<`, `<=`, `>` or `>=`, and rows meet in bins of these values, see `operators.ranges`; a join
        without either compares all pairs and is refused.

        A left join to a side that can repeat its key becomes an inner join to that side, completed
        by a row of NULLs for each key it lacks, which Spark can split at a hot key on either side
        and which reads a table of a chain once more for its keys. A right or full join, and one with
        further conditions, is split into matched and unmatched rows; in a chain, the rows
        joined so far are written once for it. `split=False` leaves it all to Spark.
        """
        frame, described = self.tables.source(source)
        scope = self._scope_with(alias, described)
        pairs, rest = self._key_pairs(list(on) if isinstance(on, list | tuple) else [on], alias)
        ties = {frozenset((self._alias_of(a), alias)) for a, _ in pairs} | _tied(scope, rest)
        if not any(alias in tie for tie in ties):
            return self._range_join(frame.alias(alias), alias, scope, rest, how)
        how = "inner" if how == "met" else how
        if described.grouped and not self._left_once(scope, pairs):
            frame = apart(frame, *[F.col(f"`{scope.split(b)[1]}`") for _, b in pairs])
        right = frame.alias(alias)
        equal = [scope.resolve(a) == scope.resolve(b) for a, b in pairs]
        more = [as_condition(p).holds(scope) for p in rest]
        condition = functools.reduce(Column.__and__, equal + more)
        right_once = described.covers_key(scope.split(b)[1] for _, b in pairs)
        left_once = self._left_once(scope, pairs)
        owners = [self._alias_of(a) for a, _ in pairs]
        # with each key once on the null-extended sides, Spark can split the plain join
        plain = (right_once or how == "right") and (left_once or how == "left")
        if how == "inner" or not split or plain or not pairs:
            joined = self.base.join(right, condition, how)
        elif how == "left" and not more and len(set(owners)) == 1:
            owner = dict(self.frames)[owners[0]]
            keys = owner.select(*[scope.resolve(a) for a, _ in pairs])
            joined = completed(
                self.base,
                frame,
                alias,
                [scope.resolve(a) for a, _ in pairs],
                keys,
                [scope.split(b)[1] for _, b in pairs],
            )
        else:
            base, own = self.base, [scope.resolve(a) for a, _ in pairs]
            if len(self.scope.sources) > 1:
                base = written(base, {a: s.props for a, s in self.scope.sources.items()})
                # there an alias is a struct, and stays one where only its keys are wanted
                own = [
                    F.struct(*[scope.resolve(a).alias(scope.split(a)[1]) for a, _ in pairs
                               if self._alias_of(a) == o]).alias(o)
                    for o in dict.fromkeys(owners)
                ]
            left_lookup, right_lookup = base, right
            if not more:
                left_lookup = thin(base, *own)
                right_lookup = thin(right, *[scope.resolve(b) for _, b in pairs])
            joined = split_outer_join(
                base,
                right,
                condition,
                how,
                left_lookup,
                right_lookup,
                left_once,
                right_once,
            )
        links = self.links
        if not more and split and len(set(owners)) == 1 and owners[0] in self.scope.sources:
            sides = tuple((scope.resolve(a), scope.resolve(b)) for a, b in pairs)
            links = (*links, Link(alias, owners[0], sides, how, right_once))
        return replace(
            self,
            base=joined,
            scope=scope,
            frames=(*self.frames, (alias, right)),
            ties=(*self.ties, *ties),
            links=links,
        )

    def _range_join(self, right: DataFrame, alias: str, scope: Scope, conditions, how: str) -> Query:
        """A join whose conditions compare the two sides without any equality. Rows that an outer join
        keeps are numbered and written first, so that those without a partner are found by number. For `met`
        rows only the joined ones of this query matter: where they can be told without pairs, they come
        without columns of the other side, and once or twice each."""
        parts = [p for c in conditions for p in as_condition(c).parts]
        compared = [c for c in parts if c.order and c.order[1] in _TURNED]
        ties, aliases = [], set()
        for c in compared:
            a, symbol, b = c.order
            sides = []
            for field in (a, b):
                watched = scope.watched()
                field.build(watched)
                sides.append(watched.aliases)
            if sides[0] == {alias} and sides[1] and alias not in sides[1]:
                a, symbol, b, sides = b, _TURNED[symbol], a, sides[::-1]
            if sides[1] == {alias} and sides[0] and alias not in sides[0]:
                one, two = a.build(scope), b.build(scope)
                kinds = [df.select(v.alias("v")).schema["v"].dataType for df, v in ((self.base, one), (right, two))]
                kinds = ["number" if isinstance(k, NumericType) else k.simpleString() for k in kinds]
                if kinds[0] == kinds[1]:
                    ties.append((one, symbol, two, kinds[0]))
                    aliases |= sides[0]
        if not ties:
            raise ValueError(f"the join of {alias!r} needs an equality or comparison of two properties of one type")
        condition = functools.reduce(Column.__and__, [as_condition(c).holds(scope) for c in conditions])
        found = met_rows(self.base, right, ties) if how == "met" and len(ties) == len(parts) else None
        if found is not None:
            return replace(self, base=found)
        base, keeps = self.base, {"left": (True, False), "right": (False, True), "full": (True, True)}
        left_kept, right_kept = keeps.get(how, (False, False))
        if left_kept:
            base = written(base, {a: s.props for a, s in self.scope.sources.items()}, f"_row_{alias}_l")
        if right_kept:
            right = written(right, {alias: scope.sources[alias].props}, f"_row_{alias}_r")
        found = [
            range_join(base, right, reach, condition if own is None else condition & own)
            for reach, own in reaches(ties)
        ]
        inner = functools.reduce(DataFrame.unionAll, found)
        joined = inner
        if left_kept:
            number = F.col(f"_row_{alias}_l")
            met = inner.select(number.alias("_met")).distinct()
            joined = joined.union(without_partner(base, met, number == F.col("_met"), right, front=False))
        if right_kept:
            number = F.col(f"_row_{alias}_r")
            met = inner.select(number.alias("_met")).distinct()
            joined = joined.union(without_partner(right, met, number == F.col("_met"), base, front=True))
        if left_kept or right_kept:
            joined = joined.drop(f"_row_{alias}_l", f"_row_{alias}_r")
        return replace(
            self,
            base=joined,
            scope=scope,
            frames=(*self.frames, (alias, right)),
            ties=(*self.ties, *[frozenset((a, alias)) for a in aliases]),
        )

    def _alias_of(self, name: str) -> str:
        alias, prop = self.scope.split(name)
        return alias or self.scope.owner(prop) or self.scope.root

    def _key_pairs(self, parts, alias: str) -> tuple[list[tuple[str, str]], list]:
        """Pairs of an own property and one of the joined table, and the other conditions."""
        pairs, rest = [], []
        for part in parts:
            if isinstance(part, tuple):
                pairs.append(part)
                continue
            for c in as_condition(part).parts:
                there = [name.startswith(f"{alias}.") for name in c.pair or ()]
                known = [self.scope.split(n)[0] in (None, *self.scope.sources) for n in c.pair or ()]
                if sorted(there) == [False, True] and known[there.index(False)]:
                    pairs.append((c.pair[there.index(False)], c.pair[there.index(True)]))
                else:
                    rest.append(c)
        return pairs, rest

    def _left_once(self, scope: Scope, pairs) -> bool:
        if len(self.scope.sources) > 1:
            return False
        root = self.scope.sources[self.scope.root]
        return root.covers_key(scope.split(a)[1] for a, _ in pairs)

    def met(self, source, alias: str, on) -> Query:
        """An inner join of which only this query's rows are wanted, however often each."""
        return self.join(source, alias, on, "met")

    def inner_join(self, source, alias: str, on) -> Query:
        return self.join(source, alias, on, "inner")

    def left_join(self, source, alias: str, on) -> Query:
        return self.join(source, alias, on, "left")

    def right_join(self, source, alias: str, on) -> Query:
        return self.join(source, alias, on, "right")

    def full_join(self, source, alias: str, on) -> Query:
        return self.join(source, alias, on, "full")

    def cross_join(self, source, alias: str, on) -> Query:
        """A cross join always comes with an equality, which makes it an inner join."""
        return self.join(source, alias, on, "inner")

    def relate(self, table: str, alias: str, how: str = "inner") -> Query:
        """Join the parent table along the declared foreign key(s) of the root table to it."""
        return self.join(table, alias, self._relation_pairs(table, alias), how)

    def relate_outer(self, table: str, alias: str) -> Query:
        """In a subquery: tie the root table to its parent in the enclosing query."""
        query = self
        for own, parent in self._relation_pairs(table, alias):
            query = query.filter(eq_property(own, outer(parent)))
        return query

    def _relation_pairs(self, table: str, alias: str) -> list[tuple[str, str]]:
        child = self.scope.spec()
        keys = self.tables.catalog.relations(child.name, table)
        if not keys:
            raise ValueError(f"{child.name} has no foreign key to {table}")
        return [
            (f"{self.scope.root}.{own}", f"{alias}.{ref}")
            for fk in keys
            for own, ref in zip(fk.props, fk.ref_props, strict=True)
        ]

    # ---- clauses -------------------------------------------------------------------------

    def filter(self, condition) -> Query:
        return replace(self, conditions=(*self.conditions, as_condition(condition)))

    def column(self, prop, label: str | None = None) -> Query:
        f = as_field(prop)
        return replace(self, items=(*self.items, (f, label or f.label)))

    def columns(self, *props) -> Query:
        query = self
        for p in props:
            query = query.column(p)
        return query

    def select_all(self, alias: str | None = None) -> Query:
        """Every declared property of a table, labelled by property."""
        return self.select_subset(alias)

    def select_subset(
        self, alias: str | None = None, included=None, as_property: bool = True
    ) -> Query:
        """Some or all properties of a table, under property names or physical names."""
        alias = alias or self.scope.root
        spec = self.scope.spec(alias)
        query = self
        for c in spec.columns:
            if included is None or c.prop in included:
                label = c.prop if as_property else c.column_name
                query = query.column(f"{alias}.{c.prop}", label)
        return query

    def star(self, alias: str | None = None) -> Query:
        """`alias.*`"""
        alias = alias or self.scope.root
        return self.columns(*[f"{alias}.{p}" for p in self.scope.sources[alias].props])

    def distinct(self, prop=None, label: str | None = None) -> Query:
        query = self.column(prop, label) if prop is not None else self
        return replace(query, is_distinct=True)

    def max(self, prop, label: str, distinct: bool = False) -> Query:
        return self.column(aggregates.max_(prop), label)

    def min(self, prop, label: str, distinct: bool = False) -> Query:
        return self.column(aggregates.min_(prop), label)

    def avg(self, prop, label: str, distinct: bool = False) -> Query:
        return self.column(aggregates.avg(prop, distinct), label)

    def sum(self, prop, label: str, distinct: bool = False) -> Query:
        return self.column(aggregates.sum_(prop, distinct), label)

    def count(self, prop, label: str, distinct: bool = False) -> Query:
        return self.column(aggregates.count(prop, distinct), label)

    def rows(self, label: str, alias: str | None = None) -> Query:
        return self.column(aggregates.rows(alias), label)

    def group(self, *fields) -> Query:
        return replace(self, groups=(*self.groups, *fields))

    def having(self, condition) -> Query:
        return replace(self, havings=(*self.havings, as_condition(condition)))

    def asc(self, prop, nulls: str | None = None) -> Query:
        return replace(self, orders=(*self.orders, Order(prop, False, nulls)))

    def desc(self, prop, nulls: str | None = None) -> Query:
        return replace(self, orders=(*self.orders, Order(prop, True, nulls)))

    def order(self, field, descending: bool = False) -> Query:
        return replace(self, orders=(*self.orders, Order(field, descending)))

    def limit(self, *bounds: int) -> Query:
        """`limit(n)` or `limit(offset, n)`."""
        offset, count = bounds if len(bounds) == 2 else (0, bounds[0])
        if offset < 0 or count < 0:
            raise ValueError("offset and limit must not be negative")
        return replace(self, page=(offset, count))

    # ---- set operations ------------------------------------------------------------------

    def union(self, other) -> Query:
        return self._combined(setops.union, other)

    def union_all(self, other) -> Query:
        return self._combined(setops.union_all, other, grouped=False)

    def intersect(self, other) -> Query:
        return self._combined(setops.intersect, other)

    def minus(self, other) -> Query:
        return self._combined(setops.minus, other)

    def _combined(self, operation, other, grouped: bool = True) -> Query:
        frame, _ = self.tables.source(other)
        combined = operation(self.frame(), frame)
        labels = tuple(combined.columns)
        described = Source(labels, None, (labels,) if grouped else (), grouped)
        return Query.over_frame(self.tables, combined, described)

    # ---- the plan ------------------------------------------------------------------------

    def rows_frame(self) -> DataFrame:
        """The joined and filtered rows, before projection."""
        self._check_ties()
        df = self.base
        for condition in self.conditions:
            df = where(df, condition, self.scope)
        return df

    def _check_ties(self) -> None:
        """Every table in FROM is reached from the first by equalities of properties."""
        if not self.loose:
            return
        ties = [*self.ties, *_tied(self.scope, self.conditions)]
        reached, size = {self.scope.root}, 0
        while len(reached) > size:
            size = len(reached)
            reached = reached.union(*[tie for tie in ties if tie & reached])
        if missing := set(self.loose) - reached:
            raise ValueError(f"no equality ties {sorted(missing)} in FROM to the other tables")

    def frame(self) -> DataFrame:
        return self._grouped() if self.groups else self._plain()

    def _selected(self) -> list[Column]:
        props = self.scope.sources[self.scope.root].props
        if not self.items and len(set(props)) < len(props):  # equal labels: by place only
            return [F.col(f"{self.scope.root}.*")]
        items = self.items or self.star().items
        columns = []
        for f, label in items:
            c = f.build(self.scope)
            columns.append(c.alias(label) if label else c)
        return columns

    def _plain(self) -> DataFrame:
        if self.havings:
            raise ValueError("having needs a group")
        df = self.rows_frame()
        if self.is_distinct:
            df = df.select(*self._selected()).distinct()
            return self._paged(df, self._orders_by_label())
        if self.page is None:
            orders = [o.apply(self._order_column(o)) for o in self.orders]
            df = df.orderBy(*orders) if orders else df
            return df.select(*self._selected())
        names = [f"_o{i}" for i in range(len(self.orders))]
        keys = [self._order_column(o).alias(n) for o, n in zip(self.orders, names, strict=True)]
        sorts = [o.by(n) for o, n in zip(self.orders, names, strict=True)]
        return self._paged(df.select(*self._selected(), *keys), sorts).drop(*names)

    def _grouped(self) -> DataFrame:
        fields = [to_col(g, self.scope) for g in self.groups]
        keys = [c.alias(f"_g{i}") for i, c in enumerate(fields)]
        items = self._selected() if self.items else [
            c.alias(as_field(g).label or f"group_{i}")
            for i, (c, g) in enumerate(zip(fields, self.groups, strict=True))
        ]
        having = [
            h.holds(self.scope).alias(f"_h{i}") for i, h in enumerate(self.havings)
        ]
        labels = self.labels()
        sort_keys, sort = [], []
        for i, o in enumerate(self.orders):
            if isinstance(o.field, str) and o.field in labels:
                sort.append(o.by(o.field))
            else:
                sort_keys.append(to_col(o.field, self.scope).alias(f"_o{i}"))
                sort.append(o.by(f"_o{i}"))
        only = None if having or sort_keys else self._counts()
        if only:
            df, items = only[0].groupBy(*keys), only[1]
        else:
            df = self.rows_frame().groupBy(*keys)
        df = df.agg(*items, *having, *sort_keys)
        for i in range(len(having)):
            df = df.where(f"_h{i}")
        extra = [f"_g{i}" for i in range(len(keys))] + [f"_h{i}" for i in range(len(having))]
        helpers = [f"_o{i}" for i in range(len(self.orders))]
        df = df.drop(*extra)
        if self.is_distinct:
            return self._paged(df.drop(*helpers).distinct(), self._orders_by_label())
        return self._paged(df, sort).drop(*helpers)

    def _counts(self) -> tuple[DataFrame, list[Column]] | None:
        """The first table's rows with numbers of joined rows, and the items over them, where the query only
        counts per properties of that table what joins by equal keys multiply; see `operators.counted`."""
        hows = {link.how for link in self.links}
        chained = len(self.links) == len(self.frames) - 1 and hows in ({"left"}, {"inner"})
        if not chained or self.conditions or all(link.once for link in self.links):
            return None
        root, values, items = self.scope.root, {}, []
        named = [as_field(g).prop for g in self.groups]
        for i, (f, label) in enumerate(self.items):
            if f.counted is None:
                named.append(f.prop)
                items.append(f.build(self.scope))
            elif f.counted == (None,):
                items.append(F.sum(F.col(ROWS)))
            else:
                watched = self.scope.watched()
                value = f.counted[0].build(watched)
                if len(watched.aliases) != 1 or watched.outer_names:
                    return None
                values[f"_n{i}"] = (*watched.aliases, value)
                items.append(F.sum(F.col(f"_n{i}")))
            items[-1] = items[-1].alias(label) if label else items[-1]
        if len(named) == len(items) + len(self.groups) or not all(n and self._alias_of(n) == root for n in named):
            return None
        return counted(dict(self.frames), self.links, root, values), items

    def _order_column(self, o: Order) -> Column:
        """An order by label means the selected item, an order by name the property."""
        if isinstance(o.field, str):
            for f, label in self.items:
                if label == o.field:
                    return f.build(self.scope)
        return to_col(o.field, self.scope)

    def _orders_by_label(self) -> list[Sort]:
        return [o.by(as_field(o.field).label) for o in self.orders]

    def _paged(self, df: DataFrame, sorts: list[Sort]) -> DataFrame:
        if self.page is not None:
            return page(df, sorts, *self.page)
        return df.orderBy(*[s.apply() for s in sorts]) if sorts else df

    # ---- description ---------------------------------------------------------------------

    def labels(self) -> list[str]:
        if self.items:
            return [label for _, label in self.items]
        if self.groups:
            return [as_field(g).label or f"group_{i}" for i, g in enumerate(self.groups)]
        return list(self.scope.sources[self.scope.root].props)

    def only_label(self) -> str:
        labels = self.labels()
        if len(labels) != 1:
            raise ValueError(f"the subquery must select one column, not {labels}")
        return labels[0] or self.frame().columns[0]

    def described(self, frame: DataFrame) -> Source:
        """What an enclosing query may know of this one: its labels and what is unique."""
        labels = tuple(frame.columns)
        if self.is_distinct:
            return Source(labels, None, (labels,), True)
        by_prop = {f.prop.rpartition(".")[2]: label for f, label in self.items if f.prop}
        if not self.items:
            by_prop = {label: label for label in labels}
        if self.groups:
            keys = [[as_field(g).prop.rpartition(".")[2] for g in self.groups]]
        else:
            keys = self._root_keys()
        found = [tuple(by_prop.get(p) for p in key) for key in keys]
        unique = tuple(key for key in found if key and all(key))
        grouped = bool(self.groups) or any(s.grouped for s in self.scope.sources.values())
        return Source(labels, None, unique, grouped)

    def _root_keys(self) -> list[tuple[str, ...]]:
        """Keys of the one table this query reads, which hold for its rows too."""
        if len(self.scope.sources) > 1:
            return []
        root = self.scope.sources[self.scope.root]
        keys = list(root.unique)
        if root.spec:
            keys += [root.spec.primary_key, *root.spec.unique.values()]
        return [tuple(key) for key in keys if key]

    def scalar(self, scope: Scope | None = None) -> Column:
        """The query as one value; more than one row is an error when it runs."""
        linked = linked_value(self, scope) if scope and scope.flags is not None else None
        return self.frame().scalar() if linked is None else linked

    # ---- ends: these run the query and bring rows to the driver --------------------------

    def count_rows(self) -> int:
        return self.frame().count()

    def list(self, as_dict: bool = False) -> list:
        return [self._shape(r, as_dict) for r in self.frame().collect()]

    def iterator(self, as_dict: bool = False) -> Iterator:
        """Rows one partition at a time, for results that do not fit the driver."""
        return (self._shape(r, as_dict) for r in self.frame().toLocalIterator())

    def first(self, as_dict: bool = False):
        row = self.frame().first()
        return None if row is None else self._shape(row, as_dict)

    def one(self):
        """First column of the first row."""
        row = self.frame().first()
        return None if row is None else row[0]

    @staticmethod
    def _shape(row, as_dict: bool):
        return row.asDict() if as_dict else tuple(row)

    # ---- ends that stay in Spark ---------------------------------------------------------

    def into(self, table: str, included=None) -> int:
        """Insert the result into a declared table."""
        return self.tables.insert(table).values_from(self, included).execute()

    def create_as(self, name: str) -> int:
        """Create a new table from the result."""
        return self.tables.store.create_as(name, self.frame())

    def cache(self, name: str) -> Query:
        """Give the query a name, see `Workspace.named`."""
        self.tables.queries[name] = self
        return self

    def cache_as(self, name: str) -> DataFrame:
        """Keep the result under a name, see `Workspace.cached`."""
        return self.tables.cached(name, self.frame)
