"""Applying a condition to a frame.

EXISTS and IN standing alone are semi and anti joins. Within OR, under a negation of something
larger, or as a flag of an update, Spark would turn them into a join kind whose hot keys stay on
one task; and so it would do with an aggregate that depends on the row. There the distinct keys
are joined as a flag, or the aggregate by its keys, with a left join that can be split.
"""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.predicates import Condition
from tablewright.functions.scope import Scope


def where(df: DataFrame, condition: Condition, scope: Scope) -> DataFrame:
    """The rows for which the condition is true. Columns named `_flag...`, `_key...` and
    `_value...` may come in addition."""
    for part in condition.parts:
        if part.is_subquery:
            df = df.where(part.holds(scope))
        else:
            df, hit = flagged(df, part, scope)
            df = df.where(hit)
    return df


def flagged(df: DataFrame, condition: Condition, scope: Scope) -> tuple[DataFrame, Column]:
    """The frame and a column that is true where the condition is true."""
    collecting = replace(scope, flags=[])
    hit = condition.holds(collecting)
    return join_flags(df, collecting), hit


def join_flags(df: DataFrame, scope: Scope) -> DataFrame:
    """Add what the columns built in this scope count on. Each flag has a key once at most."""
    for keys, names, values in scope.flags:
        same = [F.col(n) == v for n, v in zip(names, values, strict=True)]
        df = df.join(keys, functools.reduce(Column.__and__, same), "left")
    return df


def has_subquery(condition: Condition, scope: Scope) -> bool:
    """Whether rows of another query decide the condition."""
    collecting = replace(scope, flags=[])
    built = condition.holds(collecting)
    text = built._jc.toString()
    return bool(collecting.flags) or any(p.is_subquery for p in condition.parts) or "subquery" in text.lower()
