"""Best-fit packing: patterns of a few lengths, fitted to the length histogram.

Documents are cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths, as
many numbers as `capacity`, reaches the driver. There, repeat counts of patterns (one to three lengths
that fill a sequence) are fitted to it by non-negative least squares and rounded down to whole
numbers; what remains is packed best-fit, longest first, still as counts per length. The plan is a
table of patterns, whose size depends on `capacity` alone. Every piece is numbered among those of its
length, and its number gives its sequence and place.

Defined results: a null text counts as empty and is one piece that holds only the end token; repeated
rows are pieces of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.spread import cell_sums, random_key, sum_before
from tablewright.llm.stages import releasing, settle
from tablewright.llm.tokens import encode

ROUNDS = 400  # of the least-squares fit
CELLS = 1024  # ranges in which the pieces of a length are numbered


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and, if wanted, `ids` as little-endian bytes.

    A document longer than `capacity` is cut from its end on, so its first piece may be shorter.
    """
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1), tokenizer)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                to = len(ids) % capacity or capacity
                at = nth = 0
                while at < len(ids):
                    body = ids[at:to].tobytes()
                    row.append(i)
                    piece.append(nth)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(body))
                    data.append(body if with_ids else None)
                    at, to, nth = to, to + capacity, nth + 1
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(data, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary")).mapInArrow(
        releasing(cut),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        + (", ids binary" if with_ids else ""),
    )


def _patterns(present: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence but for `slack` at most: one, two or three
    pieces, of lengths that occur."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    there[0] = True
    rows = []
    for free in range(slack + 1):
        full = capacity - free
        a, b = np.meshgrid(np.arange(full + 1), np.arange(full + 1), indexing="ij")
        a, b = a.ravel(), b.ravel()
        c = full - a - b
        fits = (a >= b) & (b >= c) & (c >= 0)
        a, b, c = a[fits], b[fits], c[fits]
        if free:  # looser triples add little
            two = c == 0
            a, b, c = a[two], b[two], c[two]
        rows.append(np.stack((a, b, c), axis=1)[there[a] & there[b] & there[c]])
    return np.concatenate(rows)


def _fit(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come nearest to the histogram, by
    accelerated projected gradient steps."""
    scale = 1.0 / np.sqrt(np.maximum(histogram, 1.0))
    goal, weight = histogram * scale, scale[patterns] * (patterns > 0)

    def lengths(x):
        return np.bincount(patterns.ravel(), (weight * x[:, None]).ravel(), len(histogram))

    def back(r):
        return (r[patterns] * weight).sum(axis=1)

    probe = np.ones(len(patterns))
    for _ in range(30):  # the largest curvature, by power steps
        probe = back(lengths(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(y - back(lengths(y) - goal) / (norm * 1.05), 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def plan_sequences(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: Counter = Counter()
    if left[capacity]:
        plan[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    present = np.flatnonzero(left)
    patterns = _patterns(present, capacity, 8) if len(present) else np.zeros((0, 3), np.int64)
    if len(patterns):
        times = _fit(patterns, left.astype(float))
        for i in np.argsort(-times):
            n = int(times[i])
            if not n:
                break
            lengths = [int(v) for v in patterns[i] if v]
            need = Counter(lengths)
            n = min(n, *(int(left[v]) // k for v, k in need.items()))
            if n:
                plan[tuple(lengths)] += n
                for v, k in need.items():
                    left[v] -= n * k
    # Sequences by what is free in them; sequences alike are handled together.
    free: dict[int, Counter] = {}
    for lengths, n in plan.items():
        if (gap := capacity - sum(lengths)) > 0:
            free.setdefault(gap, Counter())[lengths] += n
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            gap = min((g for g, held in free.items() if g >= v and held), default=None)
            if gap is None:  # new sequences, as full of this length as they get
                fit = min(capacity // v, n)
                lengths, times = (v,) * fit, n // fit
                n -= fit * times
                plan[lengths] += times
                if capacity - v * fit:
                    free.setdefault(capacity - v * fit, Counter())[lengths] += times
                continue
            lengths, times = next(iter(free[gap].items()))
            fit = min(gap // v, n)
            times = min(times, n // fit)
            n -= fit * times
            longer = (*lengths, *(v,) * fit)
            for counts in (free[gap], plan):
                counts[lengths] -= times
                if not counts[lengths]:
                    del counts[lengths]
            plan[longer] += times
            if gap - v * fit:
                free.setdefault(gap - v * fit, Counter())[longer] += times
    return sorted(plan.items())


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Which numbers of a length go to a pattern: [first, last), `each` to a sequence, one after
    another from `offset` in sequences from `sequence` on."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in plan:
        at = 0
        for v, each in sorted(Counter(lengths).items(), reverse=True):
            rows.append((v, used[v], used[v] + each * times, each, at, sequence))
            used[v] += each * times
            at += v * each
        sequence += times
    return pd.DataFrame(
        rows, columns=["length", "first", "last", "each", "at", "sequence"], dtype="int64"
    )


def pack(cut: DataFrame, capacity: int = 1024, seed: str = "pack") -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    The pieces are read twice: give them written.
    """
    spark = cut.sparkSession
    numbered = cut.withColumn(
        "__key", random_key(seed, F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))
    ).withColumn("__one", F.lit(1).cast("long"))
    sums = cell_sums(numbered, "length", "__key", "__one", CELLS)
    # One row per length, of which there are at most `capacity`.
    histogram = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("value")).collect()}
    slots = _slots(plan_sequences(histogram, capacity))
    if slots.empty:
        slots = pd.DataFrame([(0, 0, 0, 1, 0, 0)], columns=slots.columns)
    # A row looks up its slot among those of its length; the table is bounded by the capacity.
    table = spark.createDataFrame(
        [
            (int(v), part[["first", "last", "each", "at", "sequence"]].values.tolist())
            for v, part in slots.sort_values(["length", "first"]).groupby("length")
        ],
        "length long, slots array<array<long>>",
    )
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    placed = sum_before(
        numbered, sums, "length", "__key", "__one", order, "__nth", CELLS
    ).join(F.broadcast(table), "length")
    return (
        placed.withColumn("__slot", _slot_of(F.col("slots"), F.col("__nth")))
        .withColumn("__turn", F.col("__nth") - F.col("__slot")[0])
        .select(
            *[F.col(f"`{c}`") for c in cut.columns],
            (F.col("__slot")[4] + F.floor(F.col("__turn") / F.col("__slot")[2])).alias("sequence_id"),
            (F.col("__slot")[3] + F.col("__turn") % F.col("__slot")[2] * F.col("length")).alias(
                "offset"
            ),
        )
    )


def _slot_of(slots, nth):
    """The slot whose numbers hold `nth`."""
    return F.get(F.filter(slots, lambda s: (s[0] <= nth) & (nth < s[1])), F.lit(0))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(settle(pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)
