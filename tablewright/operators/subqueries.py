"""Conditions on subqueries: EXISTS, IN, and comparisons with ANY or ALL of a column.

* EXISTS and IN are semi joins, their negations anti joins, against thinned keys.
* NOT IN must yield nothing for any row once the set holds a NULL. Spark's own null-aware anti
  join broadcasts the set, so here it is an ordinary anti join plus two counts of the set.
* ANY and ALL need the smallest and largest value of the set and how many values are NULL: one
  row, computed once and compared with every row.
* A subquery that names the enclosing row by equalities is grouped by its own side of them, and
  these groups are joined by key: its own GROUP BY, HAVING, aggregates and page then hold per key. An
  aggregate without a group is one value per key, also for a key without rows.
* EXISTS tied by one `<`, `<=`, `>`, `>=` or `<>` holds if it holds for the smallest or largest value: one
  row, or one per key. What ties it by more than that, and by no equality, is refused: it would
  compare all pairs of rows.

Each condition states when it is true and when it is false, see `functions.predicates`.
"""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.fields import as_field
from tablewright.functions.predicates import OPERATORS, Condition
from tablewright.functions.scope import Scope, Source
from tablewright.operators.joins import apart, lookup, thin

_flag_numbers = itertools.count()


def exists(query, on=None) -> Condition:
    """Rows for which the subquery has a row.

    The subquery may name aliases of the enclosing query in its filters, or be tied to it by
    `on=[("outer.prop", "label"), ...]`. If equalities are all that ties them, only the distinct
    keys of the subquery take part in the join.
    """
    if on is not None:
        return Condition(lambda scope: _key_match(query, on, scope), is_subquery=True)
    extremum = _extremum(query)
    if extremum is not None:
        return Condition(extremum)
    return Condition(lambda scope: _related_match(query, scope), is_subquery=True)


def not_exists(query, on=None) -> Condition:
    return ~exists(query, on)


def _key_match(query, on, scope: Scope) -> Column:
    """A row of the query has the enclosing row's keys. NULL keys match nothing."""
    frame = query.frame()
    source = query.described(frame)
    values = [as_field(prop).build(scope) for prop, _ in on]
    labels = [label for _, label in on]
    if scope.flags is not None:
        return _flag(frame, source, labels, values, scope)
    return _matching(lookup(frame, source, *labels), values)


def _matching(keys: DataFrame, outer_values: list[Column]) -> Column:
    # Outer names are looked up inside the subquery first; the alias hides its inner names.
    matched = keys.alias("_keys")
    for i, value in enumerate(outer_values):
        matched = matched.where(F.col(f"_k{i}") == value.outer())
    return matched.exists()


def _flag(frame: DataFrame, source: Source, labels, values, scope: Scope) -> Column:
    """The match as a flag that the filter joins to the enclosing rows, once per key."""
    n = next(_flag_numbers)
    names = [f"_key{n}_{i}" for i in range(len(labels))]
    keys = frame.select(
        *[F.col(f"`{label}`").alias(k) for label, k in zip(labels, names, strict=True)]
    )
    if not source.covers_key(labels):
        keys = keys.distinct()
    if source.grouped or not source.covers_key(labels):
        keys = apart(keys, *[F.col(k) for k in names])
    scope.flags.append((keys.withColumn(f"_flag{n}", F.lit(True)), names, values))
    return F.coalesce(F.col(f"_flag{n}"), F.lit(False))


def _related_match(query, scope: Scope) -> Column:
    pairs, rest = _links(query)
    plain = not (query.groups or query.havings or query.page or _aggregates(query))
    more = _names_outer(query, rest)
    if not pairs and not more:
        rows = query.rows_frame() if plain else query.frame()
        return rows.select(F.lit(1)).exists()
    if not pairs:
        raise ValueError("a subquery needs an equality with the enclosing row")
    if more:
        if not plain:
            raise ValueError("a grouped or limited subquery is tied by equalities only")
        return query.rows_frame().select(F.lit(1)).exists()
    offset, count = query.page or (0, 1)
    if count == 0:
        return F.lit(False)
    if _aggregates(query) and not query.groups:
        return F.lit(offset == 0)  # one row, whatever it counts
    keys = _by_key(query, pairs, rest, with_items=offset > 0 and query.is_distinct)
    names = [f"_k{i}" for i in range(len(pairs))]
    if offset:
        keys = keys.distinct() if query.is_distinct else keys
        keys = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > offset)
    keys = keys.select(*names)
    values = [scope.resolve(name) for _, name in pairs]
    if scope.flags is not None:
        return _flag(keys, Source(tuple(keys.columns)), keys.columns, values, scope)
    return _matching(thin(keys, *[F.col(c) for c in keys.columns]), values)


def _extremum(query):
    """EXISTS of plain rows that one comparison ties to the enclosing row, with or without equalities:
    the test of the row against the subquery's smallest or largest value. None for any other."""
    if query.groups or query.havings or query.page or _aggregates(query):
        return None
    pairs, rest = _links(query)
    tying = [c for c in rest if _names_outer(query, [c], items=False)]
    if len(tying) != 1 or not tying[0].order or _names_outer(query, []):
        return None
    a, symbol, b = tying[0].order
    own = [_owners(query, side) for side in (a, b)]
    if own == [False, True]:
        a, b, symbol = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(symbol, symbol)
    elif own != [True, False]:
        return None
    inner = replace(query, conditions=tuple(c for c in rest if c is not tying[0]))

    def holds(scope: Scope) -> Column:
        value, x = a.build(query.scope), b.build(replace(scope, enclosing=True))
        packed = F.struct(F.min(value).alias("low"), F.max(value).alias("high"))
        rows = inner.rows_frame()
        if pairs:
            n = next(_flag_numbers)
            names = [f"_key{n}_{i}" for i in range(len(pairs))]
            keys = [query.scope.resolve(o).alias(k) for (o, _), k in zip(pairs, names, strict=True)]
            grouped = apart(rows.groupBy(*keys).agg(packed.alias(f"_value{n}")), *[F.col(k) for k in names])
            scope.flags.append((grouped, names, [scope.resolve(name) for _, name in pairs]))
            ends = F.col(f"_value{n}")
        else:
            ends = rows.agg(packed.alias("ends")).scalar()
        if symbol == "<>":
            hit = (ends["low"] != x) | (ends["high"] != x)
        else:
            hit = OPERATORS[symbol](ends["low" if symbol in ("<", "<=") else "high"], x)
        return F.coalesce(hit, F.lit(False))

    return holds


def _owners(query, side) -> bool | None:
    """Whether a field is made of the subquery's properties (True), of the enclosing row's (False)."""
    watched = query.scope.watched()
    side.build(watched)
    own = {alias in query.scope.sources for alias in watched.aliases}
    return own.pop() if len(own) == 1 else None


def _aggregates(query) -> bool:
    return any(f.aggregate for f, _ in query.items)


def _names_outer(query, conditions, items: bool = True) -> bool:
    """Whether anything in the conditions, or else in the subquery, names the enclosing row."""
    watched = query.scope.watched()
    for condition in (*conditions, *(query.havings if items else ())):
        condition.holds(watched)
    for f, _ in query.items if items else ():
        f.build(watched)
    return bool(watched.outer_names)


def _by_key(query, pairs, rest, with_items: bool) -> DataFrame:
    """The subquery's rows, or groups, for all keys at once: its own side of the equalities as
    `_k0`, `_k1`, ..., after its columns if they are wanted."""
    keys = tuple((as_field(own), f"_k{i}") for i, (own, _) in enumerate(pairs))
    own = tuple(name for name, _ in pairs)
    items = query.items if with_items else ()
    grouped = query.groups or _aggregates(query)
    return replace(
        query,
        conditions=tuple(rest),
        items=(*items, *keys),
        groups=(*own, *query.groups) if grouped else (),
        orders=(),
        page=None,
        is_distinct=False,
    ).frame()


def _values_by_key(query) -> tuple[list[tuple[str, str]], DataFrame | None]:
    """The equalities that tie a subquery of one column to the enclosing row, and its values by
    key: `_value`, `_k0`, ... No equalities and no frame for one that stands alone."""
    pairs, rest = _links(query)
    more = _names_outer(query, rest)
    if not pairs and not more:
        return [], None
    if more or not pairs:
        raise ValueError("a subquery for IN, ANY or ALL is tied to the enclosing row by equalities")
    label = query.only_label()
    names = [f"_k{i}" for i in range(len(pairs))]
    value = F.col(f"`{label}`").alias("_value")
    if not query.page:
        return pairs, _by_key(query, pairs, rest, with_items=True).select(value, *names)
    sorts = tuple((as_field(o.field), f"_o{i}") for i, o in enumerate(query.orders))
    by_label = [o.field == label for o in query.orders]
    shown = replace(query, items=(*query.items, *[s for s, own in zip(sorts, by_label, strict=True) if not own]))
    frame = _by_key(shown, pairs, rest, with_items=True)
    order = [
        o.apply(F.col(f"`{label}`" if own else s[1]))
        for o, s, own in zip(query.orders, sorts, by_label, strict=True)
    ]
    if query.is_distinct:
        frame = frame.distinct()
    # Each task keeps the first rows of a key before the rows of a key meet (WindowGroupLimit).
    offset, count = query.page
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*(order or [F.col(f"`{label}`")])))
    numbered = frame.withColumn("_nth", nth).where(F.col("_nth") <= offset + count)
    return pairs, numbered.where(F.col("_nth") > offset).select(value, *names)


def _one_value(query, scope: Scope) -> Column | None:
    """The value of an aggregate without a group that names the enclosing row: a set of one value,
    also where no row is counted. None for any other subquery, and for a page that shows no row."""
    if not _aggregates(query) or query.groups or not _links(query)[0]:
        return None
    offset, count = query.page or (0, 1)
    if offset or not count:
        return None
    if scope.flags is None:
        raise ValueError("a subquery that names the enclosing row cannot stand here")
    value = linked_value(replace(query, page=None, is_distinct=False, orders=()), scope)
    if value is None:
        raise ValueError("a subquery for IN, ANY or ALL is tied to the enclosing row by equalities")
    return value


def linked_value(query, scope: Scope) -> Column | None:
    """One aggregate of the subquery's rows with the enclosing row's keys, as a join that the
    filter adds: grouped by the keys once, and without a match the aggregate of no rows. None if
    the subquery is anything else."""
    if query.groups or query.is_distinct or query.page or len(query.items) != 1:
        return None
    item, _ = query.items[0]
    pairs, rest = _links(query)
    watched = query.scope.watched()
    item.build(watched)
    for condition in rest:
        condition.holds(watched)
    if not item.aggregate or not pairs or watched.outer_names:
        return None
    n = next(_flag_numbers)
    names = [f"_key{n}_{i}" for i in range(len(pairs))]
    rows = replace(query, conditions=tuple(rest)).rows_frame()
    keys = [query.scope.resolve(own).alias(k) for (own, _), k in zip(pairs, names, strict=True)]
    value = item.build(query.scope)
    grouped = rows.groupBy(*keys).agg(value.alias(f"_value{n}"), F.lit(True).alias(f"_flag{n}"))
    outer_values = [scope.resolve(name) for _, name in pairs]
    scope.flags.append((apart(grouped, *[F.col(k) for k in names]), names, outer_values))
    of_none = rows.where(F.lit(False)).agg(value.alias("value")).scalar()
    return F.when(F.col(f"_flag{n}"), F.col(f"_value{n}")).otherwise(of_none)


def _links(query) -> tuple[list[tuple[str, str]], list[Condition]]:
    """The equalities of the query's filters that tie an own property to one of the enclosing
    query, and the other conditions."""
    pairs, rest = [], []
    for condition in [part for c in query.conditions for part in c.parts]:
        sides = sorted(condition.pair or (), key=query.scope.is_outer)
        if [query.scope.is_outer(name) for name in sides] == [False, True]:
            pairs.append(tuple(sides))
        else:
            rest.append(condition)
    return pairs, rest


def in_query(prop, query) -> Condition:
    """The value is among those of the subquery's only column."""
    on = [(prop, query.only_label())]

    def holds(scope: Scope) -> Column:
        one = _one_value(query, scope)
        if one is not None:
            return F.coalesce(as_field(prop).build(scope) == one, F.lit(False))
        pairs, frame = _values_by_key(query)
        if frame is None:
            return _key_match(query, on, scope)
        outer_values = [as_field(prop).build(scope), *[scope.resolve(name) for _, name in pairs]]
        source = Source(tuple(frame.columns))
        if scope.flags is not None:
            return _flag(frame, source, frame.columns, outer_values, scope)
        return _matching(lookup(frame, source, *frame.columns), outer_values)

    def fails(scope: Scope) -> Column:
        s, x = _summary(query, scope), as_field(prop).build(scope)
        decided = (s["n"] == 0) | (x.isNotNull() & (s["n"] == s["present"]))
        return ~holds(scope) & decided

    return Condition(holds, fails, is_subquery=not _links(query)[0])


def not_in_query(prop, query) -> Condition:
    return ~in_query(prop, query)


def ne_all(prop, query) -> Condition:
    return not_in_query(prop, query)


def _summary(query, scope: Scope) -> Column:
    """Size, number of non-NULL values, smallest and largest value of the subquery's column; of a
    subquery that names the enclosing row, those of the row's keys."""

    def packed(value: Column) -> Column:
        return F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count(value).alias("present"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )

    one = _one_value(query, scope)
    if one is not None:
        present = F.when(one.isNull(), 0).otherwise(1).cast("long").alias("present")
        return F.struct(F.lit(1).cast("long").alias("n"), present, one.alias("low"), one.alias("high"))
    pairs, frame = _values_by_key(query)
    if frame is None:
        value = F.col(f"`{query.only_label()}`")
        return query.frame().agg(packed(value).alias("summary")).scalar()
    if scope.flags is None:
        raise ValueError("a subquery that names the enclosing row cannot stand here")
    n = next(_flag_numbers)
    names = [f"_key{n}_{i}" for i in range(len(pairs))]
    keys = [F.col(f"_k{i}").alias(name) for i, name in enumerate(names)]
    grouped = frame.groupBy(*keys).agg(packed(F.col("_value")).alias(f"_value{n}"))
    outer_values = [scope.resolve(name) for _, name in pairs]
    scope.flags.append((apart(grouped, *[F.col(k) for k in names]), names, outer_values))
    none, nothing = F.lit(0).cast("long"), F.lit(None).cast(frame.schema["_value"].dataType)
    empty = F.struct(
        none.alias("n"), none.alias("present"), nothing.alias("low"), nothing.alias("high")
    )
    return F.coalesce(F.col(f"_value{n}"), empty)


# For each comparison: the end of the set that decides ANY, the end that decides ALL, the test,
# and the comparison that is its negation.
_TESTS = {
    "<": ("high", "low", lambda a, b: a < b, ">="),
    "<=": ("high", "low", lambda a, b: a <= b, ">"),
    ">": ("low", "high", lambda a, b: a > b, "<="),
    ">=": ("low", "high", lambda a, b: a >= b, "<"),
}


def _any_holds(prop, symbol, query, scope) -> Column:
    end, _, test, _ = _TESTS[symbol]
    return test(as_field(prop).build(scope), _summary(query, scope)[end])


def _all_holds(prop, symbol, query, scope) -> Column:
    _, end, test, _ = _TESTS[symbol]
    s = _summary(query, scope)
    whole = (s["n"] == s["present"]) & test(as_field(prop).build(scope), s[end])
    return (s["n"] == 0) | whole


def _any(prop, symbol, query) -> Condition:
    return Condition(
        lambda scope: _any_holds(prop, symbol, query, scope),
        lambda scope: _all_holds(prop, _TESTS[symbol][3], query, scope),
    )


def _all(prop, symbol, query) -> Condition:
    return Condition(
        lambda scope: _all_holds(prop, symbol, query, scope),
        lambda scope: _any_holds(prop, _TESTS[symbol][3], query, scope),
    )


def lt_any(prop, query) -> Condition:
    return _any(prop, "<", query)


def lte_any(prop, query) -> Condition:
    return _any(prop, "<=", query)


def gt_any(prop, query) -> Condition:
    return _any(prop, ">", query)


def gte_any(prop, query) -> Condition:
    return _any(prop, ">=", query)


def lt_all(prop, query) -> Condition:
    return _all(prop, "<", query)


def lte_all(prop, query) -> Condition:
    return _all(prop, "<=", query)


def gt_all(prop, query) -> Condition:
    return _all(prop, ">", query)


def gte_all(prop, query) -> Condition:
    return _all(prop, ">=", query)


def ne_any(prop, query) -> Condition:
    """Some value of the set differs: false only if the set holds no value but this one."""

    def holds(scope: Scope) -> Column:
        x, s = as_field(prop).build(scope), _summary(query, scope)
        return (x != s["low"]) | (x != s["high"])

    def fails(scope: Scope) -> Column:
        x, s = as_field(prop).build(scope), _summary(query, scope)
        same = (x == s["low"]) & (x == s["high"]) & (s["n"] == s["present"])
        return (s["n"] == 0) | same

    return Condition(holds, fails)
