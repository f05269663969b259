"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into segments, and an index table holds the codes by each segment's value. A query
looks up the values at distance 0 from its own segments, then 1, and so on, one segment after another.
Once segments 0 to j have been searched to radius s and the others to s - 1, every code within
`segments * s + j` has been met, so a query ends as soon as its k nearest lie within that.
Lookups and codes meet by hash of segment and value; distances are verified there, and only what beats a
query's k-th best so far goes on. A value that many codes share is dealt into cells, each of which meets
all of its lookups. A step that would make more lookups for a query than there are codes is not taken:
the queries still open are then compared with all codes, a block of each at a time.

Codes that many rows share are searched once, with their first ids. Defined results: rows without an
embedding have no code and are neither found nor asked for; nulls and NaN within one count as not
positive; a query is not among its own results, but rows with the same embedding are, at distance 0;
ties go by id, null last; with fewer than k other rows all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import settle

BITS = 64
JOB = 2500  # lookups per query that one job makes at most, but for a single larger step
PAIRS = 1 << 18  # distances that the kernel holds at once
SAMPLE = 4096  # codes that give every query a first bound on its k-th distance
CROWD = 1 << 16  # codes of a slot that one task compares with its queries
BLOCK = 1 << 12  # queries that one task compares with `CROWD` codes when no lookups are left to save


def code_of(embedding: Column, seed: int = 11) -> Column:
    """The signs of an embedding's numbers as a long; of more than 64 numbers, the signs of 64 random
    projections."""

    @F.arrow_udf("long")
    def of(rows: pa.Array) -> pa.Array:
        planes: dict[int, np.ndarray] = {}
        out = []
        for row in rows:
            if not row.is_valid:
                out.append(None)
                continue
            x = np.nan_to_num(row.values.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
            if len(x) > BITS:
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(seed).normal(size=(BITS, len(x)))
                x = planes[len(x)] @ x
            signs = np.zeros(BITS, bool)
            signs[: len(x)] = x > 0
            out.append(int(np.packbits(signs, bitorder="little").view("<i8")[0]))
        return pa.array(out, pa.int64())

    return of(embedding)


def _widths(segments: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _jobs(segments: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Steps (segment, radius) that are made together, and the distance covered after them."""
    widths = _widths(segments)
    job, size = [], 0
    for radius in range(max(n for _, n in widths) + 1):
        for j, (_, n) in enumerate(widths):
            if job and size + comb(n, radius) > JOB:
                yield job, segments * job[-1][1] + job[-1][0]
                job, size = [], 0
            job.append((j, radius))
            size += comb(n, radius)
    yield job, BITS


def _slot(code: Column, segment: int, widths: list[tuple[int, int]], mask: Column | None = None):
    at, n = widths[segment]
    value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << n) - 1))
    value = value if mask is None else value.bitwiseXOR(mask)
    return value * len(widths) + segment


def _masks(width: int, radius: int) -> Column:
    """All numbers of `width` bits of which `radius` are set."""
    masks = [str(sum(1 << b for b in bits)) for bits in combinations(range(width), radius)]
    listed = F.split(F.lit(" ".join(masks)), " ") if masks else F.array()
    return listed.cast("array<bigint>")


def _meet(k: int, segments: int):
    """Verifies queries (side 1) against the codes (side 0) of their slot, over a sorted partition."""

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        slot, side, code, extra, n = rows
        new = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        run = np.cumsum(np.concatenate(([0], slot[1:] != slot[:-1])))
        first = new[run]  # codes come first in a run
        codes = np.bincount(run, side == 0, len(new)).astype(np.int64)[run]
        query = np.flatnonzero((side == 1) & (codes > 0))
        found = []
        ends = np.cumsum(codes[query])
        at = 0
        while at < len(query):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            q, size = query[at:to], codes[query[at:to]]
            own = np.repeat(q, size)
            other = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]
            d = np.bitwise_count((code[own] ^ code[other]).view(np.uint64))
            near = d <= extra[own]
            found.append((own[near], other[near], d[near].astype(np.int32)))
            at = to
        own, other, d = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)
        )
        # More than k codes of a query need not go on.
        order = np.lexsort((extra[other], d, code[own]))
        own, other, d = own[order], other[order], d[order]
        start = np.flatnonzero(np.concatenate(([True], code[own][1:] != code[own][:-1])))
        size = np.diff(start, append=len(own)) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(start, size) if len(own) else np.zeros(0, np.int64)
        top = rank < k * segments  # a code can stand here once for each segment
        own, other, d = own[top], other[top], d[top]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(code[own]),
                pa.array(code[other]),
                pa.array(d.astype(np.int32)),
                pa.array(extra[other]),
                pa.array(n[other]),
            ],
            names=["query", "code", "d", "first_id", "n"],
        )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= PAIRS:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # whole slots only
                if cut:
                    yield compare(rows[:, :cut])
                held, size = [rows[:, cut:]], size - cut
        if size:
            yield compare(np.concatenate(held, axis=1))

    return met


def _first_bound(sample: list, k: int) -> Column:
    """The distance within which a sample of (code, n) holds `k` rows, as far as it does."""
    codes = np.array([r["code"] for r in sample], np.int64)
    n = np.array([r["n"] for r in sample], np.int64)

    @F.arrow_udf("int")
    def of(queries: pa.Array) -> pa.Array:
        asked = queries.to_numpy(zero_copy_only=False)
        out = np.full(len(asked), BITS, np.int32)
        for at in range(0, len(asked), 64):
            d = np.bitwise_count((asked[at : at + 64, None] ^ codes).view(np.uint64))
            for i, row in enumerate(d):
                held = np.cumsum(np.bincount(row, n, BITS + 1))
                if held[-1] >= k:
                    out[at + i] = np.searchsorted(held, k)
        return pa.array(out)

    return of(F.col("query"))


def _all_pairs_in_blocks(codes: DataFrame, queries: DataFrame, n_codes: int, n_queries: int) -> DataFrame:
    """Rows as `_meet` takes them, a slot for each block of queries and each of codes."""
    parts, cells = (max(1, -(-n // size)) for n, size in ((n_queries, BLOCK), (n_codes, CROWD)))

    def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n)))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    asked = dealt(queries, "query", parts).select("*", every(cells))
    held = dealt(codes, "code", cells).select("*", every(parts))
    return held.select(
        (F.col("other") * cells + F.col("own")).alias("slot"), zero.alias("side"), "code",
        F.col("first_id").alias("extra"), "n",
    ).unionByName(asked.select(
        (F.col("own") * cells + F.col("other")).alias("slot"), one.alias("side"), F.col("query").alias("code"),
        F.col("bound").cast("long").alias("extra"), zero.alias("n"),
    ))


def _in_cells(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows with those of crowded slots dealt out: a code to one cell, a lookup to all of them."""
    sized = rows.join(crowded, "slot", "left").withColumn("cells", F.coalesce("cells", F.lit(1)).cast("long"))
    zero = F.lit(0).cast("long")
    own = F.array(F.pmod(F.xxhash64(F.lit("cell"), "code"), F.col("cells")))
    cells = F.when(F.col("side") == 0, own).otherwise(F.sequence(zero, F.col("cells") - 1))
    slot = F.when(F.col("cell") == 0, F.col("slot")).otherwise(F.xxhash64("slot", "cell"))
    return sized.withColumn("cell", F.explode(cells)).select(slot.alias("slot"), "side", "code", "extra", "n")


def nearest_codes(
    codes: DataFrame, queries: DataFrame, k: int, segments: int | None = None
) -> DataFrame:
    """(query, code, d, first_id, n): for each distinct `query`, its nearest codes that hold the `k`
    nearest ids, from distinct (code, first_id, n), n the number of rows with the code.

    Unless given, there are as many segments as leave a slot one code or less on average.
    """
    size, total = codes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if segments is None:
        segments = max(2, BITS // max(4, size.bit_length()))
    widths = _widths(segments)
    wanted = min(k, total or 0)
    # The k-th distance within a fixed number of codes is one that the k-th of all cannot exceed.
    sample = codes.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).select("code", "n").collect()
    open_ = settle(
        queries.select("query").distinct().select("query", _first_bound(sample, wanted).alias("bound")),
        "open",
    )
    crowded = settle(
        codes.select(F.explode(F.array(*[_slot(F.col("code"), j, widths) for j in range(segments)])).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > CROWD)
        .select("slot", F.ceil(F.col("held") / CROWD).alias("cells")),
        "crowded",
    )
    dealt = not crowded.isEmpty()
    best, made = None, 0
    for job, covered in _jobs(segments):
        made += sum(comb(widths[j][1], radius) for j, radius in job)
        last = made > max(size, JOB)
        lookups = [] if last else [
            open_.select(
                "query", "bound", F.explode(_masks(widths[j][1], radius)).alias("mask")
            ).select(
                _slot(F.col("query"), j, widths, F.col("mask")).alias("slot"),
                F.lit(1).cast("long").alias("side"),
                F.col("query").alias("code"),
                F.col("bound").cast("long").alias("extra"),
                F.lit(0).cast("long").alias("n"),
            )
            for j, radius in job
        ]
        rows = codes.select(
            F.explode(
                F.array(*[_slot(F.col("code"), j, widths) for j in sorted({j for j, _ in job})])
            ).alias("slot"),
            F.lit(0).cast("long").alias("side"),
            "code",
            F.col("first_id").alias("extra"),
            "n",
        )
        for part in lookups:
            rows = rows.unionByName(part)
        if last:
            rows = _all_pairs_in_blocks(codes, open_, size, open_.count())
        elif dealt:
            rows = _in_cells(rows, crowded)
        met = (
            rows.repartition("slot")
            .sortWithinPartitions("slot", "side")
            .mapInArrow(_meet(k, segments), "query long, code long, d int, first_id long, n long")
        )
        if best is not None:
            met = met.unionByName(best)
        met = met.distinct()
        near = Window.partitionBy("query").orderBy("d", "first_id", "code")
        # Ties go by id across codes, so a code goes only once strictly nearer ones hold k rows.
        by_distance = Window.partitionBy("query").orderBy("d")
        nearer = F.sum("n").over(by_distance.rangeBetween(Window.unboundedPreceding, -1))
        best = settle(
            met.withColumn("nth", F.row_number().over(near))
            .where(F.col("nth") <= k)
            .withColumn("nearer", F.coalesce(nearer, F.lit(0)))
            .where(F.col("nearer") < k)
            .drop("nth", "nearer"),
            "best",
        )
        if last or covered >= BITS:
            break
        reached = best.groupBy("query").agg(
            F.sum(F.when(F.col("d") <= covered, F.col("n"))).alias("sure"),
            F.sum("n").alias("held"),
            F.max("d").alias("worst"),
        )
        open_ = settle(
            open_.select("query")
            .join(reached, "query", "left")
            .where(F.coalesce("sure", F.lit(0)) < wanted)
            .select(
                "query",
                F.when(F.col("held") >= wanted, F.col("worst")).otherwise(BITS).alias("bound"),
            ),
            "open",
        )
        if open_.isEmpty():
            break
    return best


def top_k(
    rows: DataFrame,
    k: int = 10,
    every: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    segments: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, distance): the `k` nearest rows by code of each row whose id is
    divisible by `every`."""
    coded = settle(
        rows.select(F.col(vec_id).cast("long").alias("id"), code_of(F.col(embedding)).alias("code"))
        .where("code IS NOT NULL")
        .select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("order_id"), "id", "code"),
        "codes",
    )
    # Of the rows with one code no more than k + 1 can be among the nearest: the first by id.
    by_id = Window.partitionBy("code").orderBy("order_id")
    firsts = settle(
        coded.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1), "firsts"
    )
    codes = firsts.groupBy("code").agg(
        F.min("order_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    asked = coded.where(F.col("id") % every == 0).select(F.col("code").alias("query"), "id")
    best = nearest_codes(codes, asked, k + 1, segments)
    nearest = Window.partitionBy("query").orderBy("d", "order_id")
    ids = (
        best.select("query", "code", "d")
        .join(firsts.select("code", "order_id", F.col("id").alias("vec_id")), "code")
        .withColumn("nth", F.row_number().over(nearest))
        .where(F.col("nth") <= k + 1)
        .select("query", "nth", "vec_id", "d")
    )
    # k + 1 rows at most per query code; a query then passes over itself.
    found = ids.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "d"))).alias("found")
    )
    others = F.filter("found", lambda f: ~f["vec_id"].eqNullSafe(F.col("id")))
    return (
        asked.join(found, "query")
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)))
        .select(
            "query_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("col.vec_id").alias("vec_id"),
            F.col("col.d").alias("distance"),
        )
    )
