"""Token ids as files of Re-Pair grammars.

Documents are range-sorted by id and cut into blocks. Within a block frequent pairs of neighbouring ids
are replaced by nonterminals, in rounds: a round counts all pairs exactly and replaces each frequent one
wherever no more frequent pair overlaps it, and the next one works on what came of it, until no pair
occurs often enough to pay for its rule. No pair reaches over the end of a
document. A block's file holds the rules, each symbol's expansion length, and per document its number
of symbols, so one document, or a span of it, is decoded without the rest.

A file has a header of little-endian 32-bit numbers (mark, version, documents, rules, symbols, first
nonterminal, bytes per symbol), then as arrays: symbols per document, the ids that the terminals stand
for, the rules' pairs, expansion lengths of nonterminals (all 32-bit), and the symbols, byte by byte from
the lowest on: first all lowest bytes, then all second ones, and so on. Files are values of a binary column, which
Spark writes to and reads from any store.

Defined results: a null text counts as empty and is a document with the end id alone; null ids come
last, rows with one id are in the order of their text's hash; an empty table gives no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import releasing, settle
from tablewright.llm.tokens import encode

MARK, VERSION = 0x52504731, 2
BLOCK = 1 << 20  # ids of a block, but for one longer document
SHORT = 32  # ids of the rules that a whole block's reading expands once for all their places
LEAST = 7  # occurrences in a block that make a pair frequent: a rule takes 12 bytes, a place saves 2 or more


def _frequent(seq: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the positions whose pair occurs `LEAST` times, which pair each has, and the pairs, as
    numbers with `bits` for the second symbol."""
    pair = seq[at].astype(np.int64) << bits | seq[at + 1]
    places = max(1, len(at).bit_length())
    if 2 * bits + places < 64:  # numbers sort faster than an order is found
        pair <<= places
        pair |= np.arange(len(at))
        pair.sort()
        order, pair = pair & (1 << places) - 1, pair >> places
    else:
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
    count = np.diff(start, append=len(pair))
    stays = count >= LEAST
    number = np.where(stays, np.cumsum(stays) - 1, -1).astype(np.int32)
    kind = np.empty(len(at), np.int32)
    kind[order] = np.repeat(number, count)
    frequent = np.flatnonzero(kind >= 0)
    return at[frequent], kind[frequent], pair[start[stays]]


def _again(beside: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which positions go when, in a run of one pair (a a a), each one that stays excludes the next, from
    the left on."""
    same = np.flatnonzero(beside & (kind[1:] == kind[:-1])) + 1  # the pair of the position before, and overlaps it
    begun = np.flatnonzero(np.diff(same, prepend=-1) > 1)
    run = np.repeat(same[begun], np.diff(begun, append=len(same)))
    return same[(same - run) % 2 == 0]


def _winners(beside: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each position's pair ranks above the pairs that it overlaps."""
    wins, above = np.ones(len(rank), bool), rank[1:] > rank[:-1]
    wins[1:] &= ~beside | above
    wins[:-1] &= ~(beside & above)  # neighbours have different pairs, so one of two ranks above the other
    return wins


def compress(ids: list[np.ndarray]) -> bytes:
    """The file of some documents' ids, none of them empty."""
    sizes = np.array([len(i) for i in ids], np.int64)
    seq = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes) - 1] = True
    present = np.zeros(int(seq.max()) + 1 if len(seq) else 0, bool)
    present[seq] = True
    alphabet = np.flatnonzero(present)
    seq = (np.cumsum(present) - 1).astype(np.int32)[seq]  # terminals are places in the alphabet, so symbols stay short
    first = len(alphabet)
    rules, lengths, count = [], [], first
    weight = np.ones(first, np.int64)  # expansion lengths by symbol
    fresh = ~last  # positions whose pair may be frequent; one that has been rare stays rare
    while True:
        begun = np.flatnonzero(fresh)
        if len(begun) < LEAST:
            break
        bits = max(1, int(seq.max()).bit_length())
        at, kind, pairs = _frequent(seq, begun, bits)
        fresh[begun] = False
        fresh[at] = True
        if not len(at):
            break
        # A pair's own overlaps go first, and count for nothing; then frequent pairs go before rare ones.
        again = _again(np.diff(at) == 1, kind)
        often = np.bincount(kind, minlength=len(pairs)) - np.bincount(kind[again], minlength=len(pairs))
        few = often < LEAST
        stays = ~few[kind]
        if few.any():
            fresh[at[~stays]] = False
        stays[again] = False
        if not stays.all():
            at, kind = at[stays], kind[stays]
        if not len(at):
            continue
        rank = np.empty(len(pairs), np.int32)
        mixed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank[np.lexsort((mixed, often))] = np.arange(len(pairs))
        take = np.flatnonzero(_winners(np.diff(at) == 1, rank[kind]))
        at, kind = at[take], kind[take]
        # The first of all pairs wins at all its places, so every round makes a rule.
        worth = np.bincount(kind, minlength=len(pairs)) >= LEAST
        take = worth[kind]
        at, kind = at[take], (np.cumsum(worth) - 1)[kind[take]]
        two = np.stack((pairs[worth] >> bits, pairs[worth] & (1 << bits) - 1), axis=1)
        rules.append(two)
        lengths.append(weight[two].sum(axis=1))
        weight = np.concatenate((weight, lengths[-1]))
        seq[at] = count + kind
        last[at] |= last[at + 1]
        count += len(two)
        # New pairs stand at the new symbols and right before them.
        fresh[at] = True
        fresh[at[at > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last, fresh = seq[keep], last[keep], fresh[keep]
        fresh &= ~last
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    symbols = np.diff(np.flatnonzero(last), prepend=-1)
    wide = max(1, (max(count - 1, 0).bit_length() + 7) // 8)
    planes = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T
    header = np.array([MARK, VERSION, len(ids), len(rule), len(seq), first, wide], "<u4")
    parts = (header, symbols.astype("<u4"), alphabet.astype("<u4"), rule.astype("<u4"), length.astype("<u4"), planes)
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Block:
    """A file opened for reading."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<u4", 7)
        mark, version, docs, rules, symbols, self.first, wide = head.tolist()
        if (mark, version) != (MARK, VERSION):
            raise ValueError("not a block of token ids")
        at = head.nbytes

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.symbols = np.concatenate(([0], np.cumsum(array("<u4", docs), dtype=np.int64)))
        self.alphabet = array("<u4", self.first)
        self.rules = array("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = array("<u4", rules)
        planes = np.zeros((symbols, 4), np.uint8)
        planes[:, :wide] = array("u1", symbols * wide).reshape(wide, symbols).T
        self.seq = planes.view("<u4").ravel()

    def __len__(self) -> int:
        return len(self.symbols) - 1

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(seq), np.int64)
        rule = seq >= self.first
        out[rule] = self.lengths[seq[rule] - self.first]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """All ids of some symbols; a level of rules at a time, each only where it is not yet done."""
        sizes = self.sizes(seq)
        place = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), "<u4")
        while len(seq):
            rule = seq >= self.first
            out[place[~rule]] = self.alphabet[seq[~rule]]
            two, at = self.rules[seq[rule] - self.first], place[rule]
            seq = np.concatenate((two[:, 0], two[:, 1]))
            place = np.concatenate((at, at + self.sizes(two[:, 0])))
        return out

    def document(self, nth: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a document, or of a span of it: only the symbols that reach into it are
        expanded."""
        seq = self.seq[self.symbols[nth] : self.symbols[nth + 1]]
        ends = np.cumsum(self.sizes(seq))
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(seq[a : b + 1])[start - skipped : stop - skipped]

    def whole(self) -> np.ndarray:
        """The ids of all documents. Each short rule is expanded once, and copied to its places; there are
        fewer than a seventh as many rules as ids, so what is held of them is some five times the ids at most."""
        seq, sizes, found = self.seq.astype(np.int64), self.sizes(self.seq), []
        place = np.cumsum(sizes) - sizes
        while len(seq):
            longer = np.flatnonzero(sizes > SHORT)
            two, at = self.rules[seq[longer] - self.first].astype(np.int64), place[longer]
            place <<= 32
            place |= seq
            found.append(np.delete(place, longer))
            left = self.sizes(two[:, 0])
            seq, place = np.concatenate((two[:, 0], two[:, 1])), np.concatenate((at, at + left))
            sizes = np.concatenate((left, sizes[longer] - left))
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        found.sort()
        seq = found & (1 << 32) - 1
        short = np.flatnonzero(self.lengths <= SHORT)
        begun = np.arange(self.first + len(self.rules))
        begun[self.first + short] = self.first + np.cumsum(self.lengths[short], dtype=np.int64) - self.lengths[short]
        known = np.concatenate((self.alphabet, self.expand(self.first + short)))
        sizes = self.sizes(seq)
        ends = np.cumsum(sizes)
        return known[np.arange(sizes.sum()) + np.repeat(begun[seq] - (ends - sizes), sizes)]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of every document, all expanded at once."""
        sizes = np.concatenate(([0], np.cumsum(self.sizes(self.seq))))
        ids, cuts = self.whole(), sizes[self.symbols]
        return (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (part, nth, doc_ids, data): a file per block, in the order of (part, nth), and the ids of
    its documents. Write it before reading it twice."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            owners = pa.concat_arrays(names)
            owners = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), owners,
                 pa.array([compress(held)], pa.binary())],
                names=["part", "nth", "doc_ids", "data"],
            )

        for batch in batches:
            begun = 0
            for i, ids in enumerate(encode(batch.column(1), tokenizer)):
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(held[-1])
                if size >= BLOCK:
                    names.append(batch.column(0).slice(begun, i + 1 - begun))
                    yield file()
                    nth, held, names, size, begun = nth + 1, [], [], 0, i + 1
            names.append(batch.column(0).slice(begun))
        if held:
            yield file()

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    return (
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(text).cast("binary").alias("body"),
            F.xxhash64(F.col(text)).alias("tie"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "body")
        .mapInArrow(releasing(files), f"part int, nth int, doc_ids array<{kind}>, data binary")
    )


def token_index(files: DataFrame) -> DataFrame:
    """Read back from the files: (doc_id, start, n_tokens, ids_crc32) of every document; `start`
    counts the ids of all documents before it."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, owners, data in zip(*batch.columns, strict=True):
                ids = [i.astype("<u4") for i in Block(data.as_py()).documents()]
                sizes = np.array([len(i) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part.as_py()), pa.int32()),
                        pa.array(np.full(len(ids), nth.as_py()), pa.int32()),
                        owners.values,
                        pa.array(np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    ],
                    names=["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = settle(
        files.select("part", "nth", "doc_ids", "data").mapInArrow(
            read,
            f"part int, nth int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long",
        ),
        "index",
    )
    blocks = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("n"))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row per task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = (
        blocks.withColumn("n", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "nth", (F.col("n") + F.col("before")).alias("offset"))
    )
    return rows.join(offsets, ["part", "nth"]).select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
