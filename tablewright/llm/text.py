"""Words and white space as all operators of this package see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, and what is left between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def one_space(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its `n`-th word, white space in front of words unchanged."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.concat_ws("", F.slice(pieces, F.lit(1), n.cast("int")))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`, so that no name of theirs can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
