"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.exact import drop_copies
from tablewright.llm.language import UNKNOWN, identify
from tablewright.llm.minhash import drop_near_duplicates
from tablewright.llm.mixing import mix, mixed_documents
from tablewright.llm.packing import pack_documents
from tablewright.llm.stages import settle, ship
from tablewright.llm.text import whole_row

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LEAST_SCORE = 0.2  # of a text's language; text in one scores 0.4 and more, signs in a row near 0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that occur: those without a letter go, and those whose letters
    are unlike any language's profile, with a score below `LEAST_SCORE`. Null ids and repeated rows are
    judged by their text like any other."""
    ship(spark)
    _, found = identify(docs)
    rows = docs.select(whole_row(docs), found.alias("found"))
    spoken = (rows["found.lang_pred"] != UNKNOWN) & (rows["found.score"] >= LEAST_SCORE)
    return rows.where(spoken).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 or more of their five-word shingles, the one with the
    smallest doc_id stays. SimHash fingerprints within three bits propose links first, MinHash finds those that
    are further apart, and every link is verified on the full sets."""
    ship(spark)
    return drop_near_duplicates(docs, width=5, least=0.8, radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row per epoch. Repeated rows and null ids are documents of
    their own."""
    return mixed_documents(mix(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences. A row of an earlier epoch is a document of
    its own, so doc_id and piece can repeat."""
    ship(spark)
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", packing),
]

# Language ID and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
