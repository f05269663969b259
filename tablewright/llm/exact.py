"""Exact dedup by content sort, with DataFrame functions alone.

Normalised texts are range-partitioned by sampled splitters and sorted, which puts equal ones side
by side; a window over the whole text then compares neighbours in full, and the smallest id stays.
Splitters are sampled from a short head of the bytes and the digest, so they stay small however
long texts are. A text with more than `hot` copies is dealt out by id over several ranges,
and the few results per text are merged.

Defined results: null counts as empty; of rows with equal text and equal or null id one stays (null
ids come last); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import settle
from tablewright.llm.text import one_space, whole_row

HEAD = 48  # characters of the text that splitters hold


def _sorted_runs(docs: DataFrame, doc_id: str, text: str, hot: int) -> tuple[DataFrame, bool]:
    """Rows with their place in the run of equal texts, and whether any text had to be dealt out."""
    norm = one_space(F.col("body"))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), whole_row(docs)
    ).withColumn("text_sha256", F.sha2(norm.cast("binary"), 256))
    copies = settle(
        base.groupBy("text_sha256")
        .agg(F.ceil(F.count(F.lit(1)) / hot).alias("salts"))
        .where("salts > 1"),
        "copies",
    )
    dealt = not copies.isEmpty()
    key = ["head", "text_sha256", *["salt"] * dealt]
    if dealt:
        base = base.join(copies, "text_sha256", "left").withColumn(
            "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id"), "salts")).otherwise(0)
        )
    else:
        base = base.withColumn("salts", F.lit(None).cast("long")).withColumn("salt", F.lit(0))
    ranged = base.withColumn("head", F.substring(norm, 1, HEAD)).repartitionByRange(*key)
    by_id = F.col("doc_id").asc_nulls_last()
    equal = Window.partitionBy(*key, "norm")  # met by the ranges as they are
    return (
        ranged.withColumn("norm", norm)
        .withColumn("place", F.row_number().over(equal.orderBy(by_id)))
        .withColumn("keep_id", F.min("doc_id").over(equal))
        .withColumn("group_size", F.count(F.lit(1)).over(equal))
    ), dealt


def _merged(heads: DataFrame) -> DataFrame:
    """Of the runs of a text that was dealt out: the whole group's id and size, per run."""
    whole = Window.partitionBy("text_sha256", "norm")
    first = F.row_number().over(whole.orderBy(F.col("keep_id").asc_nulls_last(), "salt"))
    return heads.select(
        "*",
        F.min("keep_id").over(whole).alias("all_keep_id"),
        F.sum("group_size").over(whole).alias("all_size"),
        (first == 1).alias("leads"),
    )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = 1_000
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    runs, dealt = _sorted_runs(docs, doc_id, text, hot)
    columns = ["doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256"]
    if not dealt:
        return runs.select(*columns)
    # Two texts with one digest are told apart by their place among the digest's texts.
    among = Window.partitionBy("head", "text_sha256", "salt").orderBy("norm")
    runs = settle(
        runs.select(
            *columns,
            "salt",
            F.dense_rank().over(among).alias("nth"),
            F.when((F.col("salts") > 1) & (F.col("place") == 1), F.col("norm")).alias("norm"),
        ),
        "runs",
    )
    merged = _merged(runs.where(F.col("norm").isNotNull())).select(
        "text_sha256", "salt", "nth", "all_keep_id", "all_size", "leads"
    )
    dealt_out = F.col("all_size").isNotNull()
    return runs.join(merged, ["text_sha256", "salt", "nth"], "left").select(
        "doc_id",
        F.when(dealt_out, F.col("all_keep_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("leads", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = 1_000
) -> DataFrame:
    """The documents without copies, all their columns unchanged."""
    runs, dealt = _sorted_runs(docs, doc_id, text, hot)
    heads = runs.where("place = 1").select(
        "text_sha256", "norm", "salt", "salts", "keep_id", "group_size", "row"
    )
    if dealt:
        heads = settle(
            heads.withColumn("norm", F.when(F.col("salts") > 1, F.col("norm"))), "heads"
        )
        led = _merged(heads.where("salts > 1")).where("leads").select("row")
        heads = heads.where("salts IS NULL").select("row").unionByName(led)
    return heads.select("row.*")
