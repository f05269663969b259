"""Values of a column that travel through the driver and come back as literals, unchanged."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sent(c: Column, kind: T.DataType) -> Column:
    """The form in which a value travels. Times go as numbers or text, free of time zones."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return c if isinstance(kind, T.StringType | T.BinaryType) else c.cast("string")


def literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)
