"""Joins that keep working when one key holds a large share of the rows.

Spark's adaptive plans split an oversized key on the row-keeping side of a join: either side of an
inner join, the left side of left outer, semi and anti joins. Three cases stay on one task, and
are rewritten here with results unchanged:

* the looked-up side of a semi or anti join: only its distinct keys matter, so they are thinned
  out before the shuffle;
* an outer join whose null-extended side can repeat a key. A left join by keys becomes an inner join
  to the right side completed by a row of NULLs for every key it lacks, so a chain reads each table
  a constant number of times more; other outer joins become the inner join plus the rows without
  a partner. A declared key on that side proves that no key repeats, and then the plain outer
  join is used;
* a join to a table grouped by the join key: the grouped side is partitioned by the key already
  and joins without a shuffle of its own, and then the other side's hot key is not split either.
  The grouped side is set apart by one more shuffle, of groups and not of rows.

No side is broadcast by hint here. Spark does so where it has measured the side to be small.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scope import Source
from tablewright.session import settle

SPREAD = 16

_numbers = itertools.count()


def thin(df: DataFrame, *keys: Column) -> DataFrame:
    """The distinct keys, each at most `SPREAD` times.

    Duplicates go before the shuffle, within each task. The spread keeps a hot key from meeting
    in one task, and leaves the shuffle by key to the join, where adaptive plans can still split
    the other side.
    """
    spread = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("_spread")
    return df.select(*keys, spread).distinct().drop("_spread")


def apart(df: DataFrame, *keys: Column) -> DataFrame:
    """The same rows in a partitioning that no join by the keys can reuse."""
    return df.repartition(F.xxhash64(*keys))


def lookup(df: DataFrame, source: Source, *keys: str) -> DataFrame:
    """The side of a semi or anti join that is looked up: its keys, as few as are needed."""
    columns = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    if not source.covers_key(keys):
        return thin(df, *columns)
    single = df.select(*columns)
    return apart(single, *[F.col(f"_k{i}") for i in range(len(keys))]) if source.grouped else single


def completed(
    left: DataFrame,
    right: DataFrame,
    alias: str,
    left_keys: Sequence[Column],
    possible: DataFrame,
    right_keys: Sequence[str],
) -> DataFrame:
    """`left` left joined to `right` (to be known as `alias`) by keys, as an inner join.

    `possible` holds at least every key of `left` that is not all NULL. The right side gets a row of
    NULLs for each of these that it lacks, and one for NULL keys, which earlier outer joins may have
    left; its own rows with a NULL key can match nothing and go. Then every row of `left` has a
    partner, NULLs being equal.
    """
    names = [f"_join{next(_numbers)}_{i}" for i in range(len(right_keys))]
    possible = possible.toDF(*names)
    nothing = possible.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in possible.schema]
    )
    there = [F.col(f"`{k}`") for k in right_keys]
    own = right.where(functools.reduce(Column.__and__, [k.isNotNull() for k in there]))
    looked_up = thin(own, *[k.alias(f"{n}r") for k, n in zip(there, names, strict=True)])
    same = functools.reduce(Column.__and__, [F.col(n) == F.col(f"{n}r") for n in names])
    lacking = possible.union(nothing).distinct().join(looked_up, same, "left_anti")
    padding = lacking.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema], *names
    )
    keyed = own.select("*", *[k.alias(n) for k, n in zip(there, names, strict=True)])
    whole = keyed.union(padding).alias(alias)
    on = [v.eqNullSafe(F.col(f"{alias}.{n}")) for v, n in zip(left_keys, names, strict=True)]
    return left.join(whole, functools.reduce(Column.__and__, on))


def written(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], number: str | None = None
) -> DataFrame:
    """Joined rows, written once and read back. Each alias becomes a struct of its properties, under
    which `alias.property` still names the same; only the fields in use are read. `number` names a column
    that tells all rows apart."""
    parts = [
        F.struct(*[F.col(f"{a}.`{p}`").alias(p) for p in props]).alias(a)
        for a, props in aliases.items()
    ]
    if number:
        parts.append(F.monotonically_increasing_id().alias(number))
    return settle(df.select(*parts), "joined")


def without_partner(
    df: DataFrame, other: DataFrame, on: Column, pad: DataFrame, front: bool
) -> DataFrame:
    """Rows of `df` that `on` matches with no row of `other`, null-extended by the columns of
    `pad`, which go in front for the right side of a join."""
    alone = df.join(other, on, "left_anti")
    own = list(alone.columns)
    nulls = [F.lit(None).cast(f.dataType).alias(f"_n{i}") for i, f in enumerate(pad.schema)]
    names = [f"_c{i}" for i in range(len(own))]
    alone = alone.toDF(*names)
    kept = [F.col(n) for n in names]
    return alone.select(*nulls, *kept) if front else alone.select(*kept, *nulls)


def split_outer_join(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    how: str,
    left_lookup: DataFrame,
    right_lookup: DataFrame,
    left_once: bool = False,
    right_once: bool = False,
) -> DataFrame:
    """An outer join as a join that can be split, plus the rows without a partner.

    The lookups are what a row is checked against: thinned keys if `on` is made of key
    equalities only, else the whole side. In a full join, a side that holds each key once lets
    the join itself keep the other side's rows.
    """
    alone = {"left", "right"} if how == "full" else {how}
    kept = "inner"
    if how == "full" and (left_once or right_once):
        kept = "left" if right_once else "right"
    result = left.join(right, on, kept)
    if "left" in alone - {kept}:
        result = result.union(without_partner(left, right_lookup, on, right, front=False))
    if "right" in alone - {kept}:
        result = result.union(without_partner(right, left_lookup, on, left, front=True))
    return result
