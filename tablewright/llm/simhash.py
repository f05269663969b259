"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius.

Distinct fingerprints meet in slots: the 64 bits are cut into `radius + 2` blocks, of which any two
fingerprints within the radius share at least two, so each pair of blocks makes a table of slots. A slot
is compared bit-sliced: bit planes are stored vertically, 64 fingerprints to a word, and carry-save
counters add up the differing planes for 64 distances at once; words of which all lanes are past the
radius are abandoned. A crowded slot is cut into tiles that any task can take, and each tile
returns the links that hold its groups together rather than all of their pairs.

A text is read whole; its task holds some 100 bytes for each of its words.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and are linked
like any other; a null id is never a component's id unless all ids are null; repeated rows share a
fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected
from tablewright.llm.stages import settle

BITS = 64
SEED = 42
TILE = 2048  # members of a slot that meet in one tile
BATCH = 1 << 16  # rows or words that the kernel holds at once


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of all `width`-word shingles; a shorter text is one shingle."""
    words = text.lower().split()  # on bytes both are ASCII only
    if not words:
        return np.zeros(0, "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def fingerprint(text: bytes, width: int) -> int:
    """The majority of each bit over the hashes of all `width`-word shingles."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """The fingerprint of each text as a (signed) long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or b"", width) for t in texts], pa.int64())

    return of(text.cast("binary"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of `radius + 2` blocks of nearly equal size."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _slots(fp: Column, radius: int) -> Column:
    """One number per pair of blocks: the pair and the bits that the two blocks hold."""
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in _blocks(radius)]
    slots = []
    for table, ((i, a), (j, b)) in enumerate(combinations(enumerate(part), 2)):
        wide = _blocks(radius)[i][1] + _blocks(radius)[j][1]
        high = F.shiftleft(a, _blocks(radius)[j][1]).bitwiseOR(b)
        slots.append(F.lit(table << wide if wide < 57 else table << 57).bitwiseOR(high))
    return F.array(*slots)


def _transposed(lanes: np.ndarray) -> np.ndarray:
    """Bit matrices [n, 64] turned over: word b of a block holds bit b of its 64 rows."""
    x = np.ascontiguousarray(lanes.T)  # row r of all blocks side by side
    step, mask = 32, np.uint64(0x00000000FFFFFFFF)
    while step:
        low = np.array([i for i in range(64) if not i & step])
        shift = np.uint64(step)
        swap = ((x[low] >> shift) ^ x[low + step]) & mask
        x[low + step] ^= swap
        x[low] ^= swap << shift
        step //= 2
        mask ^= mask << np.uint64(step) if step else np.uint64(0)
    return x


class _Groups:
    """Groups of rows that grow by links; each is known by its least row."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


def _within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int):
    """Index of each word with a hit, and its lanes within the radius.

    The counters start so that they overflow exactly when a distance passes the radius.
    """
    at = np.arange(len(word))
    size = radius.bit_length()
    first = (1 << size) - 1 - radius
    full = ~np.uint64(0)
    count = [np.full(len(word), full if first >> i & 1 else 0, np.uint64) for i in range(size)]
    past = ~lanes

    def differs(bit):
        return planes[bit][word] ^ (np.uint64(0) - (query >> np.uint64(bit) & np.uint64(1)))

    def add(carry, level):
        nonlocal past
        for i in range(level, size):
            count[i], carry = count[i] ^ carry, count[i] & carry
        past = past | carry

    for bit in range(0, BITS, 2):
        x, y = differs(bit), differs(bit + 1)
        if size:  # three planes of weight one become one of weight one and one of weight two
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            add(carry, 1)
        else:
            past = past | x | y
        if bit % 8 == 6:
            open_ = past != full
            if open_.sum() * 2 < len(open_):
                at, word, query, past = at[open_], word[open_], query[open_], past[open_]
                count = [c[open_] for c in count]
                if not len(at):
                    break
    hit = past != full
    return at[hit], ~past[hit]


def tile_links(tile: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int):
    """Links (a, b) that connect whatever lies within the radius in each tile.

    Rows come sorted by tile and side. Side 0 stands against itself; where a tile has sides 1 and 2,
    they stand against each other.
    """
    n = len(fp)
    fp = fp.astype(np.uint64)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fp
    planes = _transposed(padded.reshape(words, 64))
    key = np.stack((tile, side))
    new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
    run = np.cumsum(np.isin(np.arange(n), new)) - 1
    run_end = np.concatenate((new[1:], [n]))
    # A row meets the later rows of its run, or, from side 1, all rows of the run of side 2 behind it.
    row = np.arange(n)
    begin, end = row + 1, run_end[run]
    crossing = side == 1
    if crossing.any():
        behind = np.minimum(run + 1, len(new) - 1)
        fits = crossing & (tile[new[behind]] == tile) & (side[new[behind]] == 2)
        begin = np.where(crossing, new[behind], begin)
        end = np.where(crossing, np.where(fits, run_end[behind], begin), end)
    end = np.where(side == 2, begin, end)
    query = row[end > begin]
    begin, end = begin[query], end[query]
    first, last = begin // 64, (end - 1) // 64
    total = np.cumsum(last - first + 1)
    groups = _Groups(n)
    at = 0
    while at < len(query):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BATCH, side="right")))
        spans = (last - first + 1)[at:to]
        q = np.repeat(np.arange(at, to), spans)
        word = np.arange(len(q)) - np.repeat(np.cumsum(spans) - spans, spans) + first[q]
        low = np.clip(begin[q] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(word * 64 + 64 - end[q], 0, 63).astype(np.uint64)
        full = ~np.uint64(0)
        lanes = (full << low) & (full >> high)
        cell, hits = _within(planes, word, fp[query[q]], lanes, radius)
        if len(cell):
            bits = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(bits)
            groups.link(query[q[cell[which]]], word[cell[which]] * 64 + lane)
        at = to
    below = np.flatnonzero(groups.of != row)
    return fp[groups.of[below]].astype(np.int64), fp[below].astype(np.int64)


def _tiles(radius: int):
    """Runs the kernel over a partition that is sorted by tile, whole tiles at a time."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            slot, lo, hi, side, fp = rows
            change = (slot[1:] != slot[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            tile = np.concatenate(([0], np.cumsum(change)))
            a, b = tile_links(tile, side, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= BATCH:
                rows = np.concatenate(held, axis=1)
                same = (rows[:3] == rows[:3, -1:]).all(axis=0)
                cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield compared(rows[:, :cut])
                held, size = [rows[:, cut:]], size - cut
        if size:
            yield compared(np.concatenate(held, axis=1))

    return links


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints `fp` within `radius` of each other."""
    members = fps.select("fp", F.explode(_slots(F.col("fp"), radius)).alias("slot"))
    crowds = members.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    tiles = (
        members.join(crowds, "slot")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select(
            "slot",
            "fp",
            "own",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"),
        )
        .select(
            "slot",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2)
            .cast("long")
            .alias("side"),
            "fp",
        )
    )
    return (
        tiles.repartition("slot", "lo", "hi")
        .sortWithinPartitions("slot", "lo", "hi", "side")
        .mapInArrow(_tiles(radius), "a long, b long")
    )


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, its component's least fingerprint `root`, and
    component_id, the least doc_id reachable."""
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(F.col(text)).alias("text_hash"),
            fingerprints(F.col(text), width).alias("fp"),
        ),
        "fingerprints",
    )
    return grouped(rows, fingerprint_links(rows.select("fp").distinct(), radius))


def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, fp) with the components that links (a, b) between fps make."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected(links)
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = settle(placed.join(ids, "root").select("fp", "root", "component_id"), "components")
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """One document of each group, the one with the least doc_id, all its columns unchanged.

    Of rows with one id the one with the least text hash stays; rows that agree in both stay together.
    """
    return first_of_groups(docs, near_groups(docs, doc_id, text, width, radius), doc_id, text)


def first_of_groups(docs: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents that `drop_near_copies` keeps of such groups."""
    keep = (
        groups.where("doc_id <=> component_id")
        .groupBy("root")
        .agg(F.min("text_hash").alias("__keep_hash"), F.first("component_id").alias("__keep_id"))
    )
    same = F.col(doc_id).eqNullSafe(F.col("__keep_id")) & (
        F.xxhash64(F.col(text)) == F.col("__keep_hash")
    )
    return docs.join(keep, same, "left_semi")
