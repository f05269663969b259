"""Suffix-array dedup: removing every byte that an earlier equal string covers.

A window is a string of `length` bytes. Its anchor is the place of the least hash among its `GRAM`-byte
strings, so equal windows have their anchors at equal places, and neighbouring windows mostly share
one: a run of windows is one row (key of the anchor's bytes, document, place). Rows whose key
occurs once are done. The suffixes that begin at the anchors of all others, and the reversed texts that
end there, are sorted per key by deep-shallow sorting: multikey quicksort, eight bytes at a time,
to a shallow depth, then blind tries order the groups that still agree. Two windows of a key at one
distance from their anchors are equal if their suffixes and their reversed texts agree far enough,
which the neighbours' common prefixes tell for all windows at once; the first keeps its bytes.

Each buffer of texts is resolved on its own first, so copies in it leave one row. A key with more than
`HOT` rows is resolved in parts, and what stays first in its part meets the others by a 128-bit
digest of the window, which spreads evenly.

Defined results: null counts as the empty text; null ids come after all others; rows with one id are in
the order of their text's hash; rows equal in both count as one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import settle

GRAM = 32  # bytes whose hash makes an anchor
SHALLOW = 5  # steps of eight bytes that multikey quicksort makes
BUFFER = 2 << 20  # bytes of text resolved together
PIECE = 2 << 20  # windows of a longer text are taken in pieces; with BUFFER below 2**24
PAD = 176  # bytes around a buffer, so that words can be read past its ends
HOT = 50_000  # rows of a key that one task takes
ROWS = 200_000  # rows sorted together, whole keys at a time


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([bytes(PAD), *parts, bytes(PAD)]), np.uint8)


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes at every place as one number."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of padded `data` the anchor of the window that begins there, and each place's
    hash. The leftmost of equal hashes is the anchor."""
    word = _mixed(_words(data, "<u8").copy())
    n = len(word) - 24
    hashes = word[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    for at in (8, 16, 24):
        hashes += word[at : at + n]
        hashes *= np.uint64(0xC2B2AE3D27D4EB4F)
    hashes = _mixed(hashes)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    grams, step = window - GRAM + 1, 1
    while step * 2 <= grams:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    if grams > step:
        at = grams - step
        least[:-at] = np.minimum(least[:-at], least[at:])
    return (least & low).astype(np.int64), hashes


class _Strings:
    """Strings in a padded buffer, read forwards from a place or backwards from it."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, forwards: bool):
        self.at, self.size, self.forwards = at, size, forwards
        self.data = data
        self.words = _words(data, ">u8" if forwards else "<u8")
        self.keep = np.array([((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(9)], np.uint64)

    def word(self, rows: np.ndarray, nth: int) -> np.ndarray:
        """The `nth` eight bytes as numbers in the order of the strings, zero behind their ends."""
        at = self.at[rows] + 8 * nth if self.forwards else self.at[rows] - 8 * (nth + 1)
        left = np.clip(self.size[rows] - 8 * nth, 0, 8)
        some = left > 0
        return np.where(some, self.words[np.where(some, at, 0)].astype(np.uint64), 0) & self.keep[left]

    def bytes(self, row: int) -> bytes:
        at, size = int(self.at[row]), int(self.size[row])
        if self.forwards:
            return self.data[at : at + size].tobytes()
        return self.data[at - size : at][::-1].tobytes()


def _blind_trie(strings: list[bytes]) -> list[int]:
    """The order of distinct strings by a blind trie.

    An inner node is [depth, children by byte, some leaf below]. A string goes down by the bytes at the
    nodes' depths alone, meets one leaf, and is compared with that leaf only; the first difference says
    where it branches off. A string that ends at a depth goes below -1.
    """

    def byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: int | list = 0
    for new in range(1, len(strings)):
        s, node = strings[new], root
        while not isinstance(node, int):
            node = node[1].get(byte(s, node[0]), node[2])
        other = strings[node]
        size = min(len(s), len(other))
        x = int.from_bytes(s[:size], "big") ^ int.from_bytes(other[:size], "big")
        depth = size - (x.bit_length() + 7) // 8
        above, node = None, root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][byte(s, node[0])]
        if not isinstance(node, int) and node[0] == depth:
            node[1][byte(s, depth)] = new
            continue
        leaf = node if isinstance(node, int) else node[2]
        branch = [depth, {byte(strings[leaf], depth): node, byte(s, depth): new}, leaf]
        if above is None:
            root = branch
        else:
            above[1][byte(s, above[0])] = branch
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            order.append(node)
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return order


def deep_shallow(strings: _Strings, group: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings within their groups (numbers in ascending order), and how many bytes
    each shares with the one before it, -1 at the first of a group."""
    rows = np.arange(len(group))
    part = group.copy()  # rows that agree so far
    open_ = np.arange(len(group))
    steps = -(-longest // 8)
    for nth in range(min(SHALLOW, steps)):  # multikey quicksort: split each part by its next word
        word = strings.word(rows[open_], nth)
        split = np.lexsort((word, part[open_]))
        rows[open_] = rows[open_][split]
        word, own = word[split], part[open_]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (word[1:] != word[:-1])))
        begin = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        part[open_] = begin - len(part)  # a part is named by its first place
        size = np.diff(np.flatnonzero(new), append=len(new))
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            break
    if len(open_):  # deep: what still agrees, without strings that are equal to the end
        same = np.concatenate(([False], part[open_][1:] == part[open_][:-1]))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(open_))))
        first = rows[open_[head]]
        differs = strings.size[rows[open_]] != strings.size[first]
        for nth in range(SHALLOW, steps):
            differs |= strings.word(rows[open_], nth) != strings.word(first, nth)
        start = np.flatnonzero(~same)
        mixed = np.add.reduceat(differs, start) > 0
        ends = np.append(start[1:], len(open_))
        for a, b in zip(start[mixed].tolist(), ends[mixed].tolist(), strict=True):
            places = open_[a:b]
            held: dict[bytes, list[int]] = {}
            for row in rows[places].tolist():
                held.setdefault(strings.bytes(row), []).append(row)
            distinct = list(held)
            order = _blind_trie(distinct) if len(distinct) > 1 else [0]
            rows[places] = [row for i in order for row in held[distinct[i]]]
    common = np.full(len(rows), -1)
    again = np.flatnonzero(np.concatenate(([False], group[1:] == group[:-1])))
    common[again] = np.minimum(strings.size[rows[again]], strings.size[rows[again - 1]])
    for nth in range(steps):
        if not len(again):
            break
        x = strings.word(rows[again], nth) ^ strings.word(rows[again - 1], nth)
        apart = np.flatnonzero(x)
        first = (x[apart].astype(">u8").view(np.uint8).reshape(-1, 8) > 0).argmax(axis=1)
        common[again[apart]] = np.minimum(common[again[apart]], 8 * nth + first)
        again = again[x == 0]
    return rows, common


def repeated(data, anchor, reach, count, key, rank, window):
    """Pairs (row, o) of windows that an earlier one equals.

    Row i stands for the windows that begin o bytes before anchor[i], for `count` values of o up to
    `reach`. Rows are in the order of `key`; a smaller `rank` is earlier.
    """
    if not len(key):
        return np.zeros((2, 0), np.int64)
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    right = _Strings(data, anchor, window - reach + count - 1, True)
    left = _Strings(data, anchor, reach, False)
    by_right, common_right = deep_shallow(right, group, window)
    by_left, common_left = deep_shallow(left, group, window - GRAM)
    order = np.argsort(rank, kind="stable")
    found = []
    alike_right, alike_left = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for o in range(int(reach.max(initial=-1)) + 1):
        rows = order[((reach >= o) & (reach - count < o))[order]]
        if len(rows) < 2:
            continue
        alike_right[by_right] = np.cumsum(common_right < window - o)
        alike_left[by_left] = np.cumsum(common_left < o)
        both = alike_right[rows] * (len(key) + 1) + alike_left[rows]
        _, first = np.unique(both, return_index=True)
        later = np.ones(len(rows), bool)
        later[first] = False
        found.append(np.stack((rows[later], np.full(int(later.sum()), o))))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of one owner that touch or overlap, as one each."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * wide) - owner * wide
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return owner[first], start[first], reach[np.append(first[1:], len(new)) - 1]


#: What the tasks send on: `at` packs place, windows and reach of a run, or is a span's start.
_ROW = "key long, id long, twin long, at long, stop long"


def _batch(key, id_, twin, at, stop) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (key, id_, twin, at, stop)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "twin", "at", "stop"])


def _pack(place, count, reach):
    """A run in one number: its first window's place in the text, its windows, and its reach."""
    return place << 16 | count << 8 | reach


def _runs(window: int):
    """Of texts: their runs of windows (stop -1), and spans that repeat something in their buffer."""

    def resolved(ids, twins, owner, base, parts) -> Iterator[pa.RecordBatch]:
        ids, twins = np.array(ids, np.int64), np.array(twins, np.int64)
        owner, base = np.array(owner), np.array(base)
        data = _padded(parts)
        sizes = np.array([len(p) for p in parts])
        begin = PAD + np.cumsum(sizes) - sizes
        anchor, hashes = anchors(data, window)
        windows = np.maximum(sizes - window + 1, 0)
        total = np.cumsum(windows)
        part = np.repeat(np.arange(len(parts)), windows)
        place = np.arange(total[-1]) - np.repeat(total - windows, windows) + begin[part]
        own = anchor[place]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])))[: len(own)]
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(own))
        part, place, own = part[first], place[first], own[first]
        reach = own - place
        key = hashes[own].view(np.int64)
        inside = place - begin[part] + base[part]
        document = owner[part]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        several = np.zeros(len(key), bool)
        several[:-1] |= same
        several[1:] |= same
        rows = order[several]
        rank = np.empty(len(rows), np.int64)
        in_order = np.lexsort(
            (inside[rows] + reach[rows], twins[document[rows]], ids[document[rows]])
        )
        rank[in_order] = np.arange(len(rows))
        row, o = repeated(data, own[rows], reach[rows], count[rows], key[rows], rank, window)
        row = rows[row]
        begins = inside[row] + reach[row] - o
        who, start, end = _spans(document[row], begins, begins + window)
        yield _batch(np.zeros(len(who)), ids[who], twins[who], start, end)
        left = count - np.bincount(row, minlength=len(count))
        send = np.flatnonzero(left > 0)
        yield _batch(
            key[send],
            ids[document[send]],
            twins[document[send]],
            _pack(inside[send], count[send], reach[send]),
            np.full(len(send), -1),
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for id_, twin, text in zip(*batch.columns, strict=True):
                text = text.as_py() or b""
                if len(text) < window:
                    continue
                held[0].append(id_.as_py())
                held[1].append(twin.as_py())
                for at in range(0, len(text) - window + 1, PIECE):
                    held[2].append(len(held[0]) - 1)
                    held[3].append(at)
                    held[4].append(text[at : at + PIECE + window - 1])
                    size += len(held[4][-1])
                    if size >= BUFFER:
                        yield from resolved(*held)
                        last = ([held[0][-1]], [held[1][-1]])
                        held, size = (*last, [], [], []), 0
            if size:
                yield from resolved(*held)

    return of


def _context(window: int):
    """For documents with their runs: a row per run with the bytes of its windows."""

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
            names=["key", "salt", "id", "twin", "at", "body"],
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for id_, twin, text, runs in zip(*batch.columns, strict=True):
                id_, twin, body = id_.as_py(), twin.as_py(), text.as_py()
                for run in runs.as_py():
                    at = run["at"]
                    place = at >> 16
                    context = body[place : place + (at >> 8 & 255) + window - 1]
                    rows.append((run["key"], run["salt"], id_, twin, at, context))
                if len(rows) >= ROWS // 8:
                    yield listed(rows)
                    rows = []
        if rows:
            yield listed(rows)

    return of


def _resolve(window: int):
    """Over a partition sorted by key and salt: spans that repeat something, and of the keys dealt out
    (salt >= 0) what is first in its part, with the window's digest (stop -1)."""

    def resolved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, salt, ids, twins, at = (table[c].to_numpy() for c in ("key", "salt", "id", "twin", "at"))
        bodies = table["body"].to_pylist()
        data = _padded(bodies)
        sizes = np.array([len(b) for b in bodies])
        place, count, reach = at >> 16, at >> 8 & 255, at & 255
        anchor = PAD + np.cumsum(sizes) - sizes + reach
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((place + reach, twins, ids))] = np.arange(len(key))
        new = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        group = np.cumsum(np.concatenate(([0], new)))
        row, o = repeated(data, anchor, reach, count, group, rank, window)
        begins = place[row] + reach[row] - o
        order = np.lexsort((twins, ids))
        new = (ids[order][1:] != ids[order][:-1]) | (twins[order][1:] != twins[order][:-1])
        document = np.empty(len(key), np.int64)
        document[order] = np.cumsum(np.concatenate(([0], new)))
        one = np.empty(len(key), np.int64)
        one[document] = np.arange(len(key))  # some row of each document
        owner, start, end = _spans(document[row], begins, begins + window)
        yield _out(ids[one[owner]], twins[one[owner]], start, end, [None] * len(start))
        hot = np.flatnonzero(salt >= 0)
        if len(hot):
            seen = set(zip(row.tolist(), o.tolist(), strict=True))
            raw = data.tobytes()
            rows, at_, digests = [], [], []
            for i in hot.tolist():
                for back in range(int(reach[i] - count[i] + 1), int(reach[i]) + 1):
                    if (i, back) not in seen:
                        begin = int(anchor[i]) - back
                        rows.append(i)
                        at_.append(int(place[i] + reach[i]) - back)
                        digests.append(xxhash.xxh3_128_digest(raw[begin : begin + window]))
            rows = np.array(rows, np.int64)
            yield _out(ids[rows], twins[rows], np.array(at_), np.full(len(rows), -1), digests)

    def _out(ids, twins, start, end, digest) -> pa.RecordBatch:
        columns = [pa.array(np.asarray(c, np.int64)) for c in (ids, twins, start, end)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(digest, pa.binary())], names=["id", "twin", "at", "stop", "digest"]
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held)
                key, salt = table["key"].to_numpy(), table["salt"].to_numpy()
                same = (key == key[-1]) & (salt == salt[-1])
                cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield from resolved(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield from resolved(pa.Table.from_batches(held))

    return of


def _apply(with_kept: bool):
    """Documents without their spans."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = text.as_py() or b""
                listed = spans.as_py() or []
                start = np.array([s["at"] for s in listed], np.int64)
                stop = np.array([s["stop"] for s in listed], np.int64)
                _, start, stop = _spans(np.zeros(len(start), np.int64), start, stop)
                kept, last = [], 0
                for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                    kept.append(body[last:a])
                    last = b
                kept = b"".join([*kept, body[last:]])
                digest = hashlib.sha256(kept).hexdigest()
                lost = len(body) - len(kept)
                out.append((len(body), lost, len(start), digest, kept if with_kept else None))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            size = 6 if with_kept else 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays][:size], names=names[:size])

    return of


def _told_apart(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The texts with a number `twin` that tells rows of one id apart and follows a hash of their texts.
    Rows whose id occurs once have 0; the others are numbered in sorted ranges, so neither an id nor a
    text that many rows share meets in one task, and written, so that the numbers stay."""
    once = texts.join(repeated, "id", "left_anti").withColumn("twin", F.lit(0).cast("long"))
    order = ["_hash", "_spread"]
    several = (
        texts.join(repeated, "id", "left_semi")
        .withColumns({"_hash": F.xxhash64("body"), "_spread": F.xxhash64(F.monotonically_increasing_id())})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("twin", F.monotonically_increasing_id())
    )
    return once.unionByName(settle(several.drop(*order), "twins").select(*once.columns))


def remove_repeats(
    docs: DataFrame,
    length: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
    with_kept: bool = True,
    hot: int = HOT,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, `kept`:
    the bytes that no earlier string of `length` bytes covers."""
    if not GRAM <= length <= GRAM + 127:
        raise ValueError(f"length from {GRAM} to {GRAM + 127}")
    texts = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.col(text).cast("binary").alias("body"),
    )
    several = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if several.isEmpty():
        texts = texts.withColumn("twin", F.lit(0).cast("long"))
    else:
        texts = _told_apart(texts, several.select("id"))
    first = settle(texts.select("id", "twin", "body").mapInArrow(_runs(length), _ROW), "runs")
    spans = first.where("stop >= 0").select("id", "twin", "at", "stop")
    of_key = F.count(F.lit(1)).over(Window.partitionBy("key"))
    open_ = settle(
        first.where("stop < 0")
        .withColumn("n", of_key)
        .where("n > 1")
        .withColumn(
            "salt",
            F.when(F.col("n") > hot, F.pmod(F.xxhash64("id", "at"), F.ceil(F.col("n") / hot)))
            .otherwise(-1)
            .cast("long"),
        )
        .select("key", "salt", "id", "twin", "at"),
        "open",
    )
    wanted = open_.groupBy("id", "twin").agg(F.collect_list(F.struct("key", "salt", "at")).alias("runs"))
    met = settle(
        texts.join(wanted, ["id", "twin"])
        .select("id", "twin", "body", "runs")
        .mapInArrow(
            _context(length), "key long, salt long, id long, twin long, at long, body binary"
        )
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt")
        .mapInArrow(_resolve(length), "id long, twin long, at long, stop long, digest binary"),
        "met",
    )
    spans = spans.unionByName(met.where("stop >= 0").select("id", "twin", "at", "stop"))
    parts = Window.partitionBy("digest").orderBy("id", "twin", "at")
    late = (
        met.where("stop < 0")
        .withColumn("nth", F.row_number().over(parts))
        .where("nth > 1")
        .select("id", "twin", "at", (F.col("at") + length).alias("stop"))
    )
    removed = (
        spans.unionByName(late)
        .groupBy("id", "twin")
        .agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
    )
    return (
        texts.join(removed, ["id", "twin"], "left")
        .select("doc_id", "body", "spans")
        .mapInArrow(
            _apply(with_kept),
            f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, "
            "n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept,
        )
    )
