"""The registered queries of the operators, each over its whole table, with SQL where it can say so."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.codes import top_k
from tablewright.llm.exact import exact_groups
from tablewright.llm.grammar import token_files, token_index
from tablewright.llm.language import identify
from tablewright.llm.minhash import near_duplicates
from tablewright.llm.mixing import mix
from tablewright.llm.packing import pack_documents
from tablewright.llm.periods import periodic_runs
from tablewright.llm.quality import quality_scores
from tablewright.llm.repeats import remove_repeats
from tablewright.llm.scoring import backoff_scores
from tablewright.llm.simhash import near_groups
from tablewright.llm.stages import settle, ship
from tablewright.llm.whitening import whiten

#: The tokenizer file of the queries; every executor has it at this place.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w),
t AS (
  SELECT source, source_size,
         least(cap, max((budget - used) / open_weight) OVER () * weight) AS target
  FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, words - whole * source_size - before)) AS BIGINT) AS taken
FROM e
"""


@_query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 100 bytes that occur earlier."""
    return remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


@_query
def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents by the counts of all documents."""
    return backoff_scores(_table(spark, sf_dir, "documents"))


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of each document."""
    return pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


@_query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    rows, _ = identify(_table(spark, sf_dir, "documents"))
    return rows


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document, learned from the labels that are not held out."""
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_scores(docs, labels)


@_query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows by code of every embedding whose id is divisible by 20."""
    return top_k(_table(spark, sf_dir, "embeddings"))


@_query
def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the token files, read back from them."""
    return token_index(settle(token_files(_table(spark, sf_dir, "documents"), TOKENIZER), "files"))


@_query
def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that each document's equal texts keep."""
    return exact_groups(_table(spark, sf_dir, "documents"))


SQL["op9_exact"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the least id of its component."""
    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id that each document reaches by links of 0.8 or more of their four-word shingles."""
    groups = near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def _with_period(key: str | None, words: list[bytes]) -> list[bytes]:
    """The words of op12: every tenth document repeats a stretch of its own to its end."""
    h, n = zlib.crc32((key or "").encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@_query
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document's words, and a digest of what is left without the repeats."""
    found = periodic_runs(_table(spark, sf_dir, "documents"), rewrite=_with_period)
    best = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
        .when(a["start"] != b["start"], a["start"] - b["start"])
        .otherwise(a["period"] - b["period"])
        .cast("int"),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.get(best, F.lit(0))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        longest["length"].alias("length"),
        longest["period"].alias("period"),
        F.floor(longest["length"] * 1000 / longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the sixteen main directions of their distinct vectors, each with variance one."""
    return whiten(_table(spark, sf_dir, "embeddings"))
