"""Language-model scores: stupid backoff over the corpus's own word pairs.

A word after another scores count(pair) / count(other) if the pair occurs at least `least` times,
else `alpha` * count(word) / words; a document's first word scores count(word) / words. The score of a
document is the mean logarithm. All counts are over all documents.

Count tables are partitioned by hash: the documents' pairs are exploded, pairs meet their like in a
part by hash of both words, are counted there, and what each document gains is summed per part and then
over the parts. To keep the exploded rows small, a buffer's pairs travel as arrays, one row per buffer
and part, with numbers for words. Counts that every task may need are known beforehand: of words that
make up at least 2**-20 of the corpus there are 2**20 at most, and of pairs that make up 2**-14 there are
2**14 at most, whatever the corpus, so both are sent to all tasks, and no part gets a hot pair. The
counts of rarer words are joined to the documents that ask for them.

Words are runs of anything but ASCII white space, A-Z in lower case, known by a 64-bit hash. Defined
results: null counts as empty; a document without words has score null and log_score 0; repeated rows
are scored, and counted, each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.stages import settle

BUFFER = 8 << 20  # bytes of text handled together
DOCS = 60_000  # documents of a buffer, so that 16 bits number them
COMMON_WORD = 20  # words of at least 2**-20 of all are known to every task
COMMON_PAIR = 14
PART = 2_000_000  # pairs of a part, about

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) + b)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of each word."""
    body = np.frombuffer(data.lower() + bytes(8), np.uint8)
    white = _WHITE[body]
    white[len(data) :] = True
    start = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    length = np.flatnonzero(white & np.concatenate(([False], ~white[:-1]))) - start
    words = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    value, at, active = length.astype(np.uint64), 0, np.arange(len(start))
    while len(active):
        word = words[start[active] + at] & keep[np.minimum(length[active] - at, 8)]
        value[active] = _mixed(value[active] ^ word)
        at += 8
        active = active[length[active] > at]
    return value, start


@dataclass
class _Buffer:
    """Texts or pieces of texts: each one's row, id and the hash of the word before it (0: none)."""

    rows: list
    ids: list
    before: list
    parts: list
    size: int = 0

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word and the number of its piece."""
        value, start = word_hashes(b"\n".join(self.parts))
        ends = np.cumsum([len(p) + 1 for p in self.parts])
        return value, np.searchsorted(ends, start, "right")

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Each pair's words and piece, the first words of documents with their pieces, and the number
        of words of each piece."""
        value, piece = self.words()
        first = np.concatenate(([True], piece[1:] != piece[:-1]))[: len(value)]
        left = np.concatenate((np.zeros(1, np.uint64), value[:-1]))[: len(value)]
        left[first] = np.array(self.before, np.uint64)[piece[first]]
        alone = first & (left == 0)
        counts = np.bincount(piece, minlength=len(self.parts))
        return left[~alone], value[~alone], piece[~alone], value[alone], piece[alone], counts


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about `BUFFER` bytes that end between words."""
    at = 0
    while len(text) - at > BUFFER:
        to = at + BUFFER
        while to < len(text) and not _WHITE[text[to]]:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[_Buffer]:
    """The texts of (doc_id, body) in buffers. A row's number is unique among all rows."""
    row = TaskContext.get().partitionId() << 40
    held = _Buffer([], [], [], [])
    for batch in batches:
        for id_, text in zip(*batch.columns, strict=True):
            before = 0
            for piece in _cuts(text.as_py() or b""):
                held.rows.append(row)
                held.ids.append(id_.as_py())
                held.before.append(before)
                held.parts.append(piece)
                held.size += len(piece)
                if len(piece) >= BUFFER:
                    last = piece.rsplit(None, 1)
                    before = int(word_hashes(last[-1])[0][0]) if last else before
                if held.size >= BUFFER or len(held.rows) >= DOCS:
                    yield held
                    held = _Buffer([], [], [], [])
            row += 1
    if held.rows:
        yield held


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, index = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(index, np.concatenate(counts), len(key)).astype(np.int64)


_COUNTS = "kind int, a long, b long, n long"
WORD, PAIR, TOTAL = 0, 1, 2  # kinds of counts


def _counts(kind: int, a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(a), kind), pa.int32()),
            pa.array(np.asarray(a, np.uint64).view(np.int64)),
            pa.array(np.asarray(b, np.uint64).view(np.int64)),
            pa.array(np.asarray(n, np.int64)),
        ],
        names=["kind", "a", "b", "n"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, the numbers of words and pairs, and counts of the pairs that make up half of a
    common pair's share of their buffer: a common pair has at least half of its count in such
    buffers."""
    keys, counts, size = [], [], 0
    for buffer in _buffers(batches):
        a, b, _, alone, *_ = buffer.pairs()
        words = np.concatenate((b, alone))
        key, n = np.unique(words, return_counts=True)
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size > 1_500_000:
            keys, counts = ([x] for x in _summed(keys, counts))
            size = len(keys[0])
            if size > 750_000:
                yield _counts(WORD, keys[0], np.zeros(size), counts[0])
                keys, counts, size = [], [], 0
        yield _counts(TOTAL, [0, 1], [0, 0], [len(words), len(a)])
        pair, first, n = np.unique(_pair(a, b), return_index=True, return_counts=True)
        often = n >= max(2, len(a) >> COMMON_PAIR + 1)
        yield _counts(PAIR, a[first[often]], b[first[often]], n[often])
    if keys:
        key, n = _summed(keys, counts)
        yield _counts(WORD, key, np.zeros(len(key)), n)


class _Common:
    """Counts that every task knows, of words or of pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, n: np.ndarray):
        key = a if b is None else _pair(a, b)
        order = np.argsort(key)
        self.key, self.n, self.a = key[order], n[order], a[order]
        self.b = None if b is None else b[order]

    def find(self, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        """Each one's number here, or -1."""
        if not len(self.key) or not len(a):
            return np.full(len(a), -1)
        at = np.searchsorted(self.key, a if b is None else _pair(a, b))
        at = np.minimum(at, len(self.key) - 1)
        same = self.a[at] == a
        if b is not None:
            same &= self.b[at] == b
        return np.where(same, at, -1)


def _count_of(common):
    """Exact counts of the given pairs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = common.value
        total = np.zeros(len(pairs.key), np.int64)
        for buffer in _buffers(batches):
            a, b, *_ = buffer.pairs()
            at = pairs.find(a, b)
            total += np.bincount(at[at >= 0], minlength=len(total))
        yield _counts(PAIR, pairs.a, pairs.b, total)

    return of


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first: equal bytes stand together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_SENT = (
    "part int, uid long, left binary, right binary, piece binary, rare binary, "
    "rows binary, words binary, base binary, "
)


def _send(common, parts: int, total: int, alpha: float):
    """Of each buffer, a row per part with its pairs, and a row with its pieces and what is known of
    their scores already."""

    schema = pa.schema(
        [pa.field("part", pa.int32()), pa.field("uid", pa.int64())]
        + [pa.field(c, pa.binary()) for c in
           ("left", "right", "piece", "rare", "rows", "words", "base")]
    )

    def batch(ids: list, id_type: pa.DataType, **values) -> pa.RecordBatch:
        arrays = [pa.array([values.get(f.name)], f.type) for f in schema]
        arrays.append(pa.array([ids], pa.list_(id_type)))
        return pa.RecordBatch.from_arrays(arrays, names=[*schema.names, "ids"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = common.value
        log_n, types = np.log(total), []
        uid = TaskContext.get().partitionId() << 32

        def seen():
            for b in batches:
                types.append(b.schema.field(0).type)
                yield b

        for buffer in _buffers(seen()):
            a, b, piece, alone, alone_piece, counts = buffer.pairs()
            n = len(buffer.rows)
            base = np.bincount(alone_piece, minlength=n) * -log_n
            hot = pairs.find(a, b)
            known = hot >= 0
            left = words.find(a[known])  # a common pair's words are common
            gain = np.log(pairs.n[hot[known]]) - np.log(words.n[left])
            base += np.bincount(piece[known], gain, n)
            found = np.bincount(piece[known], minlength=n)
            a, b, piece = a[~known], b[~known], piece[~known]
            # First words are asked for as pairs of nothing (0) and the word, in their part.
            a = np.concatenate((a, np.zeros(len(alone), np.uint64)))
            b, piece = np.concatenate((b, alone)), np.concatenate((piece, alone_piece))
            part = (_pair(a, b) % np.uint64(parts)).astype(np.int64)
            number_a, number_b = words.find(a), words.find(b)
            # As if no pair were found; the parts send what the found ones change.
            gain = np.where(number_b >= 0, np.log(words.n[number_b]), 0.0) if len(words.n) else np.zeros(len(b))
            gain[: len(b) - len(alone)] += np.log(alpha) - log_n
            base += np.bincount(piece, gain, n)
            order = np.lexsort((number_b, number_a, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                rows = order[cuts[p] : cuts[p + 1]]
                refs = np.concatenate((number_a[rows], number_b[rows]))
                value = np.concatenate((a[rows], b[rows]))
                rare = refs < 0
                held, index = np.unique(value[rare], return_inverse=True)
                refs[rare] = (1 << COMMON_WORD) + index
                yield batch(
                    None,
                    types[0],
                    part=p,
                    uid=uid,
                    left=_planes(refs[: len(rows)]),
                    right=_planes(refs[len(rows) :]),
                    piece=piece[rows].astype("<u2").tobytes(),
                    rare=held.astype("<u8").tobytes(),
                )
            yield batch(
                buffer.ids,
                types[0],
                part=uid % parts,
                uid=uid,
                rows=np.array(buffer.rows, "<i8").tobytes(),
                words=np.stack((counts, found)).astype("<i8").tobytes(),
                base=base.astype("<f8").tobytes(),
            )
            uid += 1

    return of


_GAINS = "uid long, piece int, word long, times int, rows binary, words binary, base binary, "


def _meet(common, total: int, least: int, alpha: float):
    """Over a partition sorted by part: pairs are counted, and per buffer the gains of those of its
    pieces that have pairs found there go on; the rarer words whose counts a piece still needs go on as rows
    of their own. So there are no more gains than pairs found, however many buffers and parts meet."""

    names = ["uid", "piece", "word", "times", "rows", "words", "base", "ids"]

    def sparse(uid: int, piece: np.ndarray, found: np.ndarray, gain: np.ndarray, id_type) -> pa.RecordBatch:
        words = piece.astype("<u2").tobytes() + found.astype("<u4").tobytes()
        values = [uid, None, None, None, None, words, gain.astype("<f8").tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(1, id_type)], names=names)

    def asked(uid, piece, word, times, id_type) -> pa.RecordBatch:
        n = len(uid)
        arrays = [
            pa.array(uid),
            pa.array(piece, pa.int32()),
            pa.array(word.view(np.int64)),
            pa.array(times, pa.int32()),
            *[pa.nulls(n, pa.binary())] * 3,
        ]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, id_type)], names=names)

    def compared(rows: list[dict], id_type) -> Iterator[pa.RecordBatch]:
        words, _ = common.value
        log_n, edge = np.log(total), 1 << COMMON_WORD
        log_word = np.log(words.n)
        held = [np.frombuffer(r["rare"], "<u8") for r in rows]
        rare, index = np.unique(np.concatenate(held), return_inverse=True)
        ends = np.cumsum([len(h) for h in held])
        left, right = [], []
        for r, h, end in zip(rows, held, ends, strict=True):
            own = index[end - len(h) : end]
            for name, into in (("left", left), ("right", right)):
                refs = _from_planes(r[name]).astype(np.int64)
                some = refs >= edge
                refs[some] = edge + own[refs[some] - edge]
                into.append(refs)
        sizes = [len(x) for x in left]
        left, right = np.concatenate(left), np.concatenate(right)
        buffer = np.repeat(np.arange(len(rows)), sizes)
        piece = np.concatenate([np.frombuffer(r["piece"], "<u2") for r in rows]).astype(np.int64)
        kinds, index, n = np.unique(left << 32 | right, return_inverse=True, return_counts=True)
        count = n[index]
        # The word 0 stands for nothing before a first word.
        nothing = edge + np.searchsorted(rare, 0) if len(rare) and rare[0] == 0 else -1
        first = left == nothing
        found = (count >= least) & ~first
        word = np.where(found, left, right)
        times = np.where(found, -1, 1)
        plain = word < edge
        width = int(piece.max()) + 1
        place = buffer * width + piece
        # The buffer's base has the gain of a pair that is not found.
        gain = np.log(count[found]) - (np.log(alpha) - log_n)
        for side in (left[found], right[found]):
            gain[side < edge] -= log_word[side[side < edge]]
        met, at = np.unique(place[found], return_inverse=True)
        sums = np.bincount(at, gain, len(met))
        pairs = np.bincount(at, minlength=len(met))
        cuts = np.searchsorted(met, np.arange(len(rows) + 1) * width)
        for r, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield sparse(r["uid"], met[a:b] % width, pairs[a:b], sums[a:b], id_type)
        ask = np.flatnonzero(~plain)
        key = (word[ask] - edge) * (len(rows) * width) + place[ask]
        key, index = np.unique(key, return_inverse=True)
        total_times = np.bincount(index, times[ask], len(key)).astype(np.int64)
        some = total_times != 0
        key, total_times = key[some], total_times[some]
        at = key % (len(rows) * width)
        uids = np.array([r["uid"] for r in rows], np.int64)
        yield asked(uids[at // width], at % width, rare[key // (len(rows) * width)], total_times, id_type)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part, id_type = [], None, None
        for batch in batches:
            id_type = batch.schema.field("ids").type
            for r in batch.select(list(range(9))).to_pylist():
                if r["rows"] is not None:
                    continue
                if rows and r["part"] != part:
                    yield from compared(rows, id_type)
                    rows = []
                part = r["part"]
                rows.append(r)
            whole = batch.filter(pc.is_valid(batch["rows"]))
            if whole.num_rows:
                n = whole.num_rows
                columns = [whole["uid"], pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                           pa.nulls(n, pa.int32()), whole["rows"], whole["words"], whole["base"],
                           whole["ids"]]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if rows:
            yield from compared(rows, id_type)

    return of


def _gather():
    """Over a partition sorted by buffer: its pieces with their sums over all parts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def pieces() -> pa.RecordBatch:
            n = len(held["base"])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, held["uid"])),
                    pa.array(np.arange(n), pa.int32()),
                    pa.array(held["rows"]),
                    held["ids"],
                    pa.array(held["words"][0]),
                    pa.array(held["words"][1]),
                    pa.array(held["base"]),
                ],
                names=["uid", "piece", "row", "doc_id", "words", "pairs_found", "gain"],
            )

        for batch in batches:
            for uid, rows, words, base, ids in zip(*batch.columns, strict=True):
                uid = uid.as_py()
                if held and held["uid"] != uid:
                    yield pieces()
                    held = {}
                words, base = words.as_py(), np.frombuffer(base.as_py(), "<f8")
                if not held:  # the buffer's own row comes first
                    own = np.frombuffer(words, "<i8").reshape(2, -1)
                    held = {"uid": uid, "ids": ids.values, "words": own.copy(), "base": base.copy()}
                    held["rows"] = np.frombuffer(rows.as_py(), "<i8")
                else:  # a part's pieces, each once, with their pairs found and gains
                    piece = np.frombuffer(words, "<u2", len(base))
                    held["words"][1, piece] += np.frombuffer(words, "<u4", len(base), 2 * len(base))
                    held["base"][piece] += base
        if held:
            yield pieces()

    return of


def backoff_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 2,
    alpha: float = 0.4,
) -> DataFrame:
    """One row per document: doc_id, words, pairs_found, log_score (their sum) and score (their mean)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = settle(
        texts.mapInArrow(_count, _COUNTS).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")),
        "counts",
    )
    totals = dict(counts.where(F.col("kind") == TOTAL).select("a", "n").collect())  # two rows
    total, pairs = totals.get(0, 0), totals.get(1, 0)

    def known(kind_: int, least_: float):
        rows = counts.where((F.col("kind") == kind_) & (F.col("n") >= least_)).toPandas()
        return (rows[c].to_numpy(np.int64) for c in ("a", "b", "n"))

    a, _, n = known(WORD, total / (1 << COMMON_WORD))  # 2**20 rows at most
    words = _Common(a.view(np.uint64), None, n)
    a, b, n = known(PAIR, max(2, pairs / (1 << COMMON_PAIR + 1)))  # 2**15 rows at most
    common = _Common(a.view(np.uint64), b.view(np.uint64), n)
    if len(common.key):
        shared = spark.sparkContext.broadcast(common)
        exact = (
            texts.mapInArrow(_count_of(shared), _COUNTS)
            .groupBy("a", "b")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least)
            .toPandas()
        )
        a, b, n = (exact[c].to_numpy(np.int64) for c in ("a", "b", "n"))
        common = _Common(a.view(np.uint64), b.view(np.uint64), n)
    shared = spark.sparkContext.broadcast((words, common))
    parts = max(1, -(-pairs // PART))
    gains = settle(
        texts.mapInArrow(
            _send(shared, parts, max(total, 1), alpha), _SENT + f"ids array<{kind}>"
        )
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_meet(shared, max(total, 1), least, alpha), _GAINS + f"ids array<{kind}>"),
        "gains",
    )
    rest = (
        gains.where("word IS NOT NULL")
        .select("uid", "piece", "times", F.col("word").alias("a"))
        .join(counts.where(F.col("kind") == WORD).select("a", "n"), "a")
        .groupBy("uid", "piece")
        .agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    )
    pieces = (
        gains.where("word IS NULL")
        .select("uid", "rows", "words", "base", "ids")
        .repartition("uid")
        .sortWithinPartitions("uid", F.col("rows").isNull())
        .mapInArrow(
            _gather(),
            f"uid long, piece int, row long, doc_id {kind}, words long, pairs_found long, gain double",
        )
    )
    return (
        pieces.join(rest, ["uid", "piece"], "left")
        .groupBy("row", "doc_id")
        .agg(
            F.sum("words").alias("words"),
            F.sum("pairs_found").alias("pairs_found"),
            F.sum(F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("log_score"),
        )
        .select(
            "doc_id",
            "words",
            "pairs_found",
            "log_score",
            F.when(F.col("words") > 0, F.col("log_score") / F.col("words")).alias("score"),
        )
    )
