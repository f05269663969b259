"""Connected components of a graph given by its links, by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, below its least neighbour.
What is left at the end are stars around each component's least node. Rounds grow with the
logarithm of the longest chain. Each round is written, so a lost executor costs no earlier round;
a node with many links is only ever on the side of a join that adaptive plans can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.stages import settle


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link: root is the component's least node.

    Links to itself and repeated links count for nothing; a node without any other link is left out.
    """
    links = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(least.select("u", F.col("m").alias("v")))
        links = settle(small.distinct(), "links")
        mark, last = _mark(links), mark
        if mark == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
