"""Counts of joined rows without the joined rows.

A grouped query that only counts needs to know of a joined side how many rows each key has, and how
many of them hold a value. So the joins are followed from their far ends: a side, with what was counted
of the sides that hang on it, becomes one row per join key, and is joined to the side that names it. No
join multiplies rows, whatever the keys' numbers are, and every table is read once.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import apart

ROWS = "_rows"


@dataclass(frozen=True)
class Link:
    """A join by equal keys alone: `alias` is joined to `owner`, `pairs` being keys of owner and alias."""

    alias: str
    owner: str
    pairs: tuple[tuple[Column, Column], ...]
    how: str
    once: bool  # whether a key is known to occur once at most on the side of `alias`


def counted(
    frames: Mapping[str, DataFrame],
    links: Sequence[Link],
    root: str,
    values: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """The rows of `root` that the joins keep, with `ROWS`, the number of joined rows that each has, and for
    each of `values` (an alias and a value of it) the number of those that hold the value."""
    df, n = frames[root], F.lit(1).cast("long")
    counts = {c: F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long") for c, (a, v) in values.items() if a == root}
    for link in [x for x in links if x.owner == root]:
        side = counted(frames, links, link.alias, values)
        theirs = [c for c in values if c in side.columns]
        keys = [b.alias(f"_k{j}") for j, (_, b) in enumerate(link.pairs)]
        there = functools.reduce(Column.__and__, [b.isNotNull() for _, b in link.pairs])
        sums = [F.sum(F.col(c)).alias(c) for c in (ROWS, *theirs)]
        side = side.where(there).groupBy(*keys).agg(*sums)
        side = apart(side, *[F.col(f"_k{j}") for j in range(len(keys))]).alias(f"_side_{link.alias}")
        own = {c: F.col(f"_side_{link.alias}.`{c}`") for c in (ROWS, *theirs)}
        on = [a == F.col(f"_side_{link.alias}._k{j}") for j, (a, _) in enumerate(link.pairs)]
        df = df.join(side, functools.reduce(Column.__and__, on), link.how)
        times = F.coalesce(own[ROWS], F.lit(1).cast("long"))
        counts = {c: v * times for c, v in counts.items()} | {c: n * F.coalesce(own[c], F.lit(0).cast("long")) for c in theirs}
        n = n * times
    return df.select(f"{root}.*", n.alias(ROWS), *[v.alias(c) for c, v in counts.items()]).alias(root)
