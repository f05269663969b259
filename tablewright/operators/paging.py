"""Pages of ordered rows.

A page is always in order. If it ends within the first `ONE_TASK` rows, each task keeps its best rows and
one task merges them. A later page is found by one range shuffle of the sort keys alone: the sorted keys
are written with their partition and position, the partitions' sizes tell where the page's first and last row
lie, and the keys found there bound the page. The rows between the two bounds are then selected by
comparing the real keys and sorted in parallel. Rows that tie with a bound and belong to the page in part
are chosen among their equals, in one task, never more of them than the page holds.

Keys that many rows share are spread over partitions by a random last key. To the driver come one size per
partition, and the two bounds.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.ids import POSITION_MASK
from tablewright.operators.values import literal, sent
from tablewright.session import settle

ONE_TASK = 10_000


@dataclass(frozen=True)
class Sort:
    """A sort key that is a column of the frame."""

    column: str
    descending: bool = False
    nulls_first: bool = True
    floating: bool = False  # the key may be NaN

    def apply(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def same(self, value: Column) -> Column:
        c = F.col(f"`{self.column}`")
        if self.floating:  # statistics leave NaN out, and a plain comparison would be decided by them
            return F.coalesce(F.isnan(c) & F.isnan(value), F.lit(False)) | c.eqNullSafe(value)
        return c.eqNullSafe(value)

    def before(self, value: Column) -> Column:
        """Whether the key comes strictly before a value."""
        c = F.col(f"`{self.column}`")
        smaller = F.coalesce(c > value if self.descending else c < value, F.lit(False))
        if self.nulls_first:
            return value.isNotNull() & (c.isNull() | smaller)
        return c.isNotNull() & (value.isNull() | smaller)

    def after(self, value: Column) -> Column:
        return ~self.before(value) & ~self.same(value)


def page(df: DataFrame, sorts: list[Sort], offset: int, count: int) -> DataFrame:
    """`count` rows from `offset` on, in order; without sort keys any such rows, as they come."""
    order = [s.apply() for s in sorts]
    if not sorts or offset + count <= ONE_TASK or not count or not _comparable(df, sorts):
        ordered = df.orderBy(*order) if order else df
        return (ordered.offset(offset) if offset else ordered).limit(count)
    kinds = {f.name: f.dataType for f in df.schema}
    sorts = [replace(s, floating=isinstance(kinds[s.column], T.FloatType | T.DoubleType)) for s in sorts]
    ranks = _ranked(df, sorts)
    sizes = sorted(ranks.groupBy("_part").count().collect())
    total = sum(n for _, n in sizes)
    last = min(offset + count, total) - 1
    if offset > last:
        return df.limit(0)
    first_at, last_at = _place(sizes, offset), _place(sizes, last)
    (low, high), plain = _keys_at(ranks, sorts, df.schema, first_at, last_at)
    at = F.struct("_part", "_pos")
    ties = [(_same(sorts, low), at >= _pair(first_at)), (_same(sorts, high), at <= _pair(last_at))]
    found = [F.count_if(c) for same, inside in ties for c in (same, same & inside)]
    all_low, own_low, all_high, own_high, both = ranks.agg(*found, F.count_if(ties[0][0] & ties[1][0])).first()
    ends = []
    if all_low > own_low or all_high > own_high:  # a tie reaches over an end of the page
        if both:
            return df.where(_same(sorts, low)).limit(last - offset + 1)
        ends = [df.where(_same(sorts, low)).limit(own_low), df.where(_same(sorts, high)).limit(own_high)]
    beyond = [_before(sorts, low), _after(sorts, high)]
    if ends:
        beyond += [_same(sorts, low), _same(sorts, high)]
    inside = df.where(_range(sorts[0], low[0], high[0])) if plain else df
    inside = inside.where(~functools.reduce(Column.__or__, beyond))
    return functools.reduce(DataFrame.union, [inside, *ends]).orderBy(*order)


def _comparable(df: DataFrame, sorts: list[Sort]) -> bool:
    """Whether all keys have values that a condition can name."""
    nested = T.ArrayType | T.StructType | T.MapType | T.VariantType
    return not any(isinstance(df.schema[s.column].dataType, nested) for s in sorts)


def _ranked(df: DataFrame, sorts: list[Sort]) -> DataFrame:
    """The keys of all rows, sorted, with their partition and their position in it, written."""
    order = [*[s.apply() for s in sorts], F.col("_spread")]
    keys = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(s.column for s in sorts)])
    return settle(
        keys.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *keys.columns,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)).alias("_pos"),
        ),
        "ranks",
    )


def _place(sizes: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """Partition and position of the row with this rank."""
    for part, n in sizes:
        if rank < n:
            break
        rank -= n
    return part, rank


def _pair(place: tuple[int, int]) -> Column:
    return F.struct(F.lit(place[0]).alias("_part"), F.lit(place[1]).cast("long").alias("_pos"))


def _keys_at(ranks, sorts, schema, *places: tuple[int, int]) -> tuple[list[list[Column]], bool]:
    """The keys at some places, as literals, and whether all their first keys are neither NULL nor NaN, which
    the statistics that scans go by leave out."""
    kinds = [schema[s.column].dataType for s in sorts]
    keys = [sent(F.col(f"`{s.column}`"), kind) for s, kind in zip(sorts, kinds, strict=True)]
    there = [(F.col("_part") == part) & (F.col("_pos") == pos) for part, pos in places]
    rows = ranks.where(functools.reduce(Column.__or__, there)).select("_part", "_pos", *keys).collect()
    found = {(r[0], r[1]): r[2:] for r in rows}
    literals = [[literal(v, k) for v, k in zip(found[p], kinds, strict=True)] for p in places]
    return literals, not {None, "NaN"} & {found[p][0] for p in places}


def _same(sorts: list[Sort], bound: list[Column]) -> Column:
    return functools.reduce(Column.__and__, [s.same(v) for s, v in zip(sorts, bound, strict=True)])


def _ordered(sorts: list[Sort], bound: list[Column], test) -> Column:
    """The first key that differs decides."""
    decided, equal = F.lit(False), F.lit(True)
    for s, v in zip(sorts, bound, strict=True):
        decided, equal = decided | (equal & test(s, v)), equal & s.same(v)
    return decided


def _before(sorts: list[Sort], bound: list[Column]) -> Column:
    return _ordered(sorts, bound, Sort.before)


def _after(sorts: list[Sort], bound: list[Column]) -> Column:
    return _ordered(sorts, bound, Sort.after)


def _range(sort: Sort, low: Column, high: Column) -> Column:
    """What the bounds say of the first key alone, in a form that scans can take."""
    c = F.col(f"`{sort.column}`")
    return c.between(high, low) if sort.descending else c.between(low, high)
