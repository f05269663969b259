"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted within their source. A prefix sum of sizes says
where each one lies in the source's word stream, and the stream is cut at the source's exact
budget: whole epochs first, then the head of one more.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, after all others; rows that agree in id, key and size are interchangeable; an empty table gives
an empty mix. The sums over sources run on one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.spread import cell_sums, random_key, sum_before
from tablewright.llm.stages import settle
from tablewright.llm.text import first_words, whole_row, word_count


def _group(source: Column) -> Column:
    """The source as a key that is never null: a null one differs from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """One row per source: its target, never above `epochs` times its size.

    `sizes` has (source, source_size). Weights repeat along the sources by code point, null last.
    What a full source cannot take is shared again by weight, which ends at one level: the target is
    the smaller of the limit and level * weight. In the order of limit / weight, what remains for a
    source and all after it rises up to the first source that is not full and falls from there, so
    its highest value is the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nothing = F.lit(0).cast("double")
    everyone = Window.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(table, F.col("place") % len(weights)))
        .withColumn("limit", (F.col("source_size") * epochs).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("limit").over(earlier), nothing))
        .withColumn("own_level", (F.col("budget") - F.col("full")) / F.sum("weight").over(rest))
        .withColumn("level", F.max("own_level").over(everyone))
        .withColumn(
            "target",
            F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))),
        )
        .select("source", "weight", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and all its columns as `row`.

    `taken` counts the words that the mix takes from the document, repeats included.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        _group(F.col(source)).alias("source_key"),
        word_count(F.col(text)).alias("size"),
        random_key(seed, F.col(doc_id)).alias("key"),
        whole_row(docs),
    )
    sums = cell_sums(base, "source_key", "key", "size")
    per_source = sums.groupBy("source_key").agg(F.sum("value").alias("source_size"))
    per_source = per_source.withColumn(
        "source",
        F.when(F.col("source_key") != "n", F.expr("substring(source_key, 2)")),
    )
    targets = settle(
        source_targets(per_source, weights, share, epochs).select(
            _group(F.col("source")).alias("source_key"), "source_size", "target"
        ),
        "targets",
    )
    placed = sum_before(
        base, sums, "source_key", "key", "size", [F.col("doc_id"), F.col("size")], "before"
    ).join(targets, "source_key")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - whole * F.col("source_size") - F.col("before")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
        .cast("long")
        .alias("taken"),
        "row",
    )


def mixed_documents(mixed: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """The documents of a mix, one row for each epoch that takes from them.

    Only the document at the cut of its source is taken in part: up to the end of its last word.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copy = mixed.where(F.col("taken") > 0).withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), times))
    )
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    body = F.col(f"row.`{text}`")
    cut = F.when(words < F.col("size"), first_words(body, words)).otherwise(body)
    return copy.select(
        *[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns]
    )
