"""Joins by ranges alone: `x BETWEEN low AND high`, `x < y`, intervals that overlap.

No pair of rows is compared without need. The values are cut at quantiles of a sample of both sides;
a row with a value goes to the bin that holds it, a row with an interval to every bin that it reaches, and
the two meet by an equality of bins, with the range itself as a further condition. Bins in the middle of
an interval hold its partners only, so what is compared in vain lies in the bins at its ends. A bin with
many rows on a side is cut again into parts of that side, each of which meets all of the other side. There
are as many tasks as the pairs to compare call for, since the rows' bytes, by which Spark sizes tasks, say
nothing of them.

Two intervals overlap if one starts within the other: that is two such joins, and no pair is in both.

Whether a value has a partner at all takes no pairs: intervals that run into each other are first made one,
and then a value lies in two of them at most.

The driver gets `CUTS` values of the sample at most, and the bins' sizes are a table of as many rows.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.values import literal, sent

CUTS = 1 << 12
WIDTH = 64  # cuts that are looked at in one step; CUTS = WIDTH * WIDTH
SAMPLE = 1 << 15
FINE = 256  # values that a bin should hold
BIN = 2_000  # rows of a side that a part of a crowded bin holds
PAIRS = 1 << 22  # pairs that a task should compare
ROWS = 1 << 16  # rows that a task should place in bins
TASKS = 1 << 14

_numbers = itertools.count()


@dataclass(frozen=True)
class Reach:
    """`point` of one side lies between `low` and `high` of the other, either of which may be open."""

    point: Column
    low: Column | None
    high: Column | None
    point_on_left: bool


def range_join(left: DataFrame, right: DataFrame, reach: Reach, condition: Column) -> DataFrame:
    """The inner join of two frames by `condition`, which holds only where `reach` does."""
    n = next(_numbers)
    bin_, own, other, b, p, s = (f"_{k}{n}" for k in ("bin", "own", "other", "b", "p", "s"))
    points, spans = (left, right) if reach.point_on_left else (right, left)
    cuts, kind, rows = _cuts(points, spans, reach)
    last, tasks = len(cuts), _tasks(rows, ROWS)
    if tasks > 1:  # a file of few row groups is read by few tasks
        points, spans = points.repartition(tasks), spans.repartition(tasks)
    placed = points.where(reach.point.isNotNull()).withColumn(bin_, _bin_of(reach.point, cuts, kind))
    bounds = [b for b in (reach.low, reach.high) if b is not None]
    spans = spans.where(functools.reduce(Column.__and__, [b.isNotNull() for b in bounds]))
    first = F.lit(0) if reach.low is None else _bin_of(reach.low, cuts, kind)
    end = F.lit(last) if reach.high is None else _bin_of(reach.high, cuts, kind)
    reached = F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))
    spread = spans.withColumn(bin_, F.explode(reached))
    found = (
        placed.groupBy(F.col(bin_).alias(b)).agg(F.count(F.lit(1)).alias(p))
        .join(spread.groupBy(F.col(bin_).alias(b)).agg(F.count(F.lit(1)).alias(s)), b)
        .collect()
    )
    pairs = _tasks(sum(r[p] * r[s] for r in found), PAIRS)
    sized = [(r[b], -(-r[p] // BIN), -(-r[s] // BIN)) for r in found]
    sizes = F.broadcast(left.sparkSession.createDataFrame(sized, f"{b} int, {p} int, {s} int"))  # a row per bin

    def parts(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        """Each row in one part of its side, for every part of the other."""
        sized = df.join(sizes, F.col(bin_) == F.col(b))
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(mine)).cast("int")
        return (
            sized.withColumn(own, salt)
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
            .drop(b, p, s)
        )

    dealt = parts(placed, p, s).withColumnsRenamed({k: f"{k}a" for k in (bin_, own, other)})
    copied = parts(spread, s, p).withColumnsRenamed({k: f"{k}b" for k in (bin_, own, other)})
    meet = [(f"{bin_}a", f"{bin_}b"), (f"{own}a", f"{other}b"), (f"{other}a", f"{own}b")]
    on = functools.reduce(Column.__and__, [F.col(x) == F.col(y) for x, y in meet]) & condition
    dealt = dealt.repartition(pairs, *[x for x, _ in meet])
    copied = copied.repartition(pairs, *[y for _, y in meet])
    one, two = (dealt, copied) if reach.point_on_left else (copied, dealt)
    return one.join(two, on).drop(*[c for pair in meet for c in pair])


def met_rows(points: DataFrame, spans: DataFrame, ties: list[tuple[Column, str, Column, str]]) -> DataFrame | None:
    """The rows of `points` with a partner among `spans`, each once or twice, where the ties put one value of
    theirs between bounds of the other side; None for ties of another kind."""
    lows = [(x, op, y) for x, op, y, _ in ties if op in (">", ">=")]
    highs = [(x, op, y) for x, op, y, _ in ties if op in ("<", "<=")]
    if max(len(lows), len(highs)) > 1 or len({str(x) for x, *_ in ties}) > 1:
        return None
    n = next(_numbers)
    lo, hi, shut = (f"_{k}{n}" for k in ("lo", "hi", "shut"))
    point = ties[0][0]
    if lows and highs:
        islands = _islands(spans.select(lows[0][2].alias(lo), highs[0][2].alias(hi)), lo, hi, shut)
    else:  # the bound that reaches furthest stands for all
        islands = spans.agg(F.min(lows[0][2]).alias(lo) if lows else F.max(highs[0][2]).alias(hi)).withColumn(shut, F.lit(False))
    low, high, tests = F.col(lo) if lows else None, F.col(hi) if highs else None, []
    if lows:
        tests.append(point >= low if lows[0][1] == ">=" else (point > low) | (F.col(shut) & (point == low)))
    if highs:
        tests.append(point <= high if highs[0][1] == "<=" else point < high)
    met = range_join(points, islands, Reach(point, low, high, True), functools.reduce(Column.__and__, tests))
    return met.drop(*islands.columns)


def _islands(spans: DataFrame, lo: str, hi: str, shut: str) -> DataFrame:
    """Intervals that hold what `spans` hold, in pieces that share no more than a border. Only `shut` ones are
    known to hold their lower border: they were cut off what an earlier piece holds."""
    spans = spans.where(F.col(lo) <= F.col(hi)).groupBy(lo).agg(F.max(hi).alias(hi))
    bound = F.col(lo)
    cuts, kind, _ = _cuts(spans, spans.limit(0), Reach(bound, None, None, True))
    placed = spans.withColumn("_bin", _bin_of(bound, cuts, kind))
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
    before = placed.groupBy("_bin").agg(F.max(hi).alias("_most")).select("_bin", F.max("_most").over(earlier).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(lo)
    reached = F.greatest("_before", F.max(hi).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = (
        placed.join(F.broadcast(before), "_bin")
        .withColumn("_fresh", F.coalesce(F.col(lo) >= reached, F.lit(True)).cast("int"))
        .withColumn("_piece", F.sum("_fresh").over(inside))
        .groupBy("_bin", "_piece", "_before")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.max("_fresh").alias("_fresh"))
    )
    cut = F.col("_fresh") == 0
    return pieces.where(~cut | (F.col(hi) > F.col("_before"))).select(
        F.when(cut, F.col("_before")).otherwise(F.col(lo)).alias(lo), hi, cut.alias(shut)
    )


def _tasks(n: int, each: int) -> int:
    return max(1, min(TASKS, -(-n // each)))


def _cuts(points: DataFrame, spans: DataFrame, reach: Reach) -> tuple[list, T.DataType, int]:
    """Values that cut both sides' values into parts of equal size, as many as their rows call for, and the
    number of values. There are no more parts than points, so that intervals are not copied to bins without any."""
    sides = [points.select(reach.point.alias("v"), F.lit(1).alias("p"))]
    sides += [spans.select(b.alias("v"), F.lit(0).alias("p")) for b in (reach.low, reach.high) if b is not None]
    values = functools.reduce(DataFrame.union, sides).where(F.col("v").isNotNull())
    kind = values.schema["v"].dataType
    n, single = values.agg(F.count(F.lit(1)), F.coalesce(F.sum("p"), F.lit(0))).first()
    wanted = min(CUTS, -(-n // min(FINE, BIN)), single)
    if wanted < 2:
        return [], kind, n
    share = min(1.0, SAMPLE / n)
    # What the sample has beyond its expected size is left out by the quantiles.
    rows = values.where(F.rand(17) < share).orderBy("v").select(sent(F.col("v"), kind)).collect()
    found = [r[0] for r in rows]
    return list(dict.fromkeys(found[len(found) * i // wanted] for i in range(1, wanted))) if found else [], kind, n


def _bin_of(value: Column, cuts: list, kind: T.DataType) -> Column:
    """How many cuts lie at or below a value, found in two steps."""
    if not cuts:
        return F.lit(0)
    value = value.cast(kind)

    def below(listed: Column) -> Column:
        return F.size(F.filter(listed, lambda c: c <= value))

    groups = [cuts[at : at + WIDTH] for at in range(0, len(cuts), WIDTH)]
    lists = [_listed(g, kind) for g in groups]
    if len(groups) == 1:
        return below(lists[0])
    group = below(_listed([g[0] for g in groups], kind))
    return F.when(group == 0, 0).otherwise(
        (group - 1) * WIDTH + below(F.element_at(F.array(*lists), F.greatest(group, F.lit(1))))
    )


def _listed(cuts: list, kind: T.DataType) -> Column:
    """The cuts as one constant; as literals, thousands of them take longer to plan than to look up."""
    if isinstance(kind, T.NumericType | T.DateType):
        return F.split(F.lit("|".join(cuts)), "[|]").cast(T.ArrayType(kind))
    return F.array(*[literal(c, kind) for c in cuts])


def reaches(ties: list[tuple[Column, str, Column, str]]) -> list[tuple[Reach, Column | None]]:
    """The joins that `left op right` comparisons of values of some kind come down to, each with a condition of its own that
    keeps its pairs apart from the others'.

    A value between two bounds, or two bounds around a value, is one join; intervals that overlap are
    two; a lone comparison is one with an open end.
    """
    lows = [(a, b, kind) for a, op, b, kind in ties if op in (">", ">=")]  # right <= left
    highs = [(a, b, kind) for a, op, b, kind in ties if op in ("<", "<=")]  # left <= right
    both = [(x, y) for x in lows for y in highs if x[2] == y[2]]
    for (a, low, _), (other, high, _) in both:
        if str(a) == str(other):
            return [(Reach(a, low, high, True), None)]
        if str(low) == str(high):
            return [(Reach(low, other, a, False), None)]
    if both:  # left starts at or before right's end, and right at or before left's
        (end, start_right, _), (start, end_right, _) = both[0]
        return [
            (Reach(start, start_right, end_right, True), start >= start_right),
            (Reach(start_right, start, end, False), start < start_right),
        ]
    a, op, b, _ = ties[0]
    return [(Reach(a, b, None, True) if op in (">", ">=") else Reach(a, None, b, True), None)]
