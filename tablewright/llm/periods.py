"""Periodic runs in word sequences, found by string synchronising sets.

A run is a stretch of words with smallest period q that is at least 2 * q long and that no neighbouring
word extends. Periods of one and two words are read off directly. For the others a scale `t` doubles
from 1 on and finds the periods in [3t, 6t):

* A position is in the synchronising set of its scale if, of the hashes of the t-word fragments that
  start at it and up to t words on, the least is at one of the two ends. That depends on 2t words only, so
  a run that repeats these words repeats the position. Fragments with a period of t / 3 or less take no
  part, which keeps the set thin: two members with one context are more than t / 3 apart.
* Two members with equal contexts at a distance in [3t, 6t) propose that distance as a period.
* A run without any member in its first period is highly periodic there: two maximal runs of one small
  period p meet in it, out of phase. Runs of small periods are known from lower scales, and each such
  pair proposes the distances that bring its phases together.

Each proposal is extended to both sides as far as the words repeat, by comparing fragments of 2^k words, and
is dropped if that gives less than two periods. Hashes only propose: every run is compared word by word
before it counts, and a run whose smallest period is smaller is known from a lower scale by its ends.

Texts go through in buffers of many documents, which unique words keep apart. A text is never cut; a
task holds some 300 bytes for each word of a buffer or of one longer text.

Defined results: a null or empty text has no words and no runs; a null id counts as empty text where a
rewriting asks for it; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.stages import releasing

BUFFER = 1 << 17  # words resolved at once, but for one longer text
LEVELS = 12  # fragments of up to 2^12 words are kept for the extension of proposals
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the fragments of 2 * width words from those of width words."""
    if len(names) <= width:
        return names[:0]
    return _mixed(names[:-width] * _ODD + (names[width:] ^ (names[width:] >> np.uint64(32))))


class _Fragments:
    """Hashes of all fragments of 1, 2, 4, .. words, and how far two places agree."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.levels = [_mixed(words.astype(np.uint64) + _ODD)]
        for k in range(LEVELS):
            if len(words) < 2 << k:
                break
            self.levels.append(_doubled(self.levels[-1], 1 << k))

    def _equal(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        inside = (i >= 0) & (j < len(level))
        return inside & (level[np.where(inside, i, 0)] == level[np.where(inside, j, 0)])

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from i and j on (i < j), or in front of them."""
        length = np.zeros(len(i), np.int64)
        top = len(self.levels) - 1
        open_ = np.arange(len(i))
        while len(open_):  # whole fragments of the longest kind, then each shorter kind once
            step = length[open_] + (1 << top) if back else -length[open_]
            open_ = open_[self._equal(top, i[open_] - step, j[open_] - step)]
            length[open_] += 1 << top
        for k in range(top - 1, -1, -1):
            step = length + (1 << k) if back else -length
            length[self._equal(k, i - step, j - step)] += 1 << k
        return length


def _stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all maximal stretches with period q that are 2 * q words long or more."""
    if len(words) < 2 * q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.concatenate(([False], words[:-q] == words[q:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edges[::2], edges[1::2]
    long = stop - start >= q
    return start[long], stop[long] + q


def _synchronising(names: np.ndarray, t: int, periodic: np.ndarray, n: int) -> np.ndarray:
    """The members of the synchronising set; `names` are of t words, `periodic` their highly periodic ones."""
    names = np.where(periodic, _END, names)
    size = n - 2 * t + 1
    least, width = names, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:size], names[t : t + size])
    return np.flatnonzero((least != _END) & ((least == names[:size]) | (least == names[t : t + size])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of members with one context and a distance in [3t, 6t)."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    places, distances = [at[:0]], [at[:0]]
    first = np.arange(len(at))
    step = 1
    while True:
        first = first[first + step < len(at)]
        apart = at[first + step] - at[first]
        near = (context[first] == context[first + step]) & (apart < 6 * t)
        first, apart = first[near], apart[near]
        if not len(first):
            return np.concatenate(places), np.concatenate(distances)
        far = apart >= 3 * t
        places.append(at[first[far]])
        distances.append(apart[far])
        step += 1


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For count[0], count[1], ..: the index of the owner and 0, 1, .. within it."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _out_of_phase(runs: np.ndarray, fragments: _Fragments, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) that two meeting runs of one period of t / 3 or less propose."""
    empty = np.zeros(0, np.int64)
    small = runs[:, (3 * runs[2] <= t) & (runs[1] - runs[0] + runs[2] >= 3 * t)]
    small = small[:, np.lexsort((small[0], small[2]))]
    a, b = small[:, :-1], small[:, 1:]
    meet = (a[2] == b[2]) & (b[0] <= a[1])
    a, b = a[:, meet], b[:, meet]
    if not a.size:
        return empty, empty
    # The phase: where the last periods of the first run hold the first period of the second.
    pair, turn = _ranges(a[2])
    p = a[2][pair]
    x, y = a[1][pair] - p - turn, b[0][pair]
    k = np.minimum(np.frexp(p)[1] - 1, len(fragments.levels) - 1)
    same = np.ones(len(pair), bool)
    for level in np.unique(k):
        chosen = k == level
        i, j, rest = x[chosen], y[chosen], p[chosen] - (1 << level)
        same[chosen] = fragments._equal(level, i, j) & fragments._equal(level, i + rest, j + rest)
    pair, shift = pair[same], (y - x)[same] % p[same]
    p = a[2][pair]
    first = 3 * t + (shift - 3 * t) % p
    count = np.maximum(0, -(-(6 * t - first) // p))
    owner, k = _ranges(count)
    distance = first[owner] + k * p[owner]
    pair = pair[owner]
    fits = np.minimum(a[1] - a[0], b[1] - b[0])[pair] + a[2][pair] >= distance
    pair, distance = pair[fits], distance[fits]
    return np.maximum(a[0][pair], b[0][pair] - distance), distance


def _extended(fragments: _Fragments, place: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows start, end, period of the proposals that reach over two periods, each once."""
    start = place - fragments.agree(place, place + q, back=True)
    end = place + q + fragments.agree(place, place + q)
    found = np.stack((start, end, q))[:, end - start >= 2 * q]
    found = found[:, np.lexsort(found)]
    found = found[:, np.concatenate(([True], (found[:, 1:] != found[:, :-1]).any(axis=0)))[: found.shape[1]]]
    words, real = fragments.words, np.ones(found.shape[1], bool)
    for i, (a, b, p) in enumerate(found.T.tolist()):
        real[i] = np.array_equal(words[a : b - p], words[a + p : b])
    return found[:, real]


def find_runs(words: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers, as rows start, end, period, ordered by start, then period."""
    n = len(words)
    runs = np.zeros((3, 0), np.int64)

    def add(start, end, q):
        nonlocal runs
        runs = np.concatenate((runs, np.stack((start, end, q)).astype(np.int64)), axis=1)
        runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
        same = (runs[0, 1:] == runs[0, :-1]) & (runs[1, 1:] == runs[1, :-1])
        runs = runs[:, np.concatenate(([True], ~same))[: runs.shape[1]]]  # the smallest period

    for q in (1, 2):
        start, end = _stretches(words, q)
        add(start, end, np.full(len(start), q))
    fragments = _Fragments(words)
    t, k, names = 1, 0, fragments.levels[0]
    while 6 * t <= n:
        wider = fragments.levels[k + 1] if k + 1 < len(fragments.levels) else _doubled(names, t)
        edges = np.zeros(n + 1, np.int64)
        small = runs[:, (3 * runs[2] <= t) & (runs[1] - runs[0] >= t)]
        np.add.at(edges, small[0], 1)
        np.add.at(edges, small[1] - t + 1, -1)
        periodic = np.cumsum(edges)[: len(names)] > 0
        at = _synchronising(names, t, periodic, n)
        place, q = _equal_contexts(at, wider[at], t)
        more, distance = _out_of_phase(runs, fragments, t)
        place, q = np.concatenate((place, more)), np.concatenate((q, distance))
        if len(place):
            add(*_extended(fragments, place, q))
        t, k, names = 2 * t, k + 1, wider
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _resolved(texts: list[list[bytes]], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Per text its runs of at least `least` words, and what is left of it."""
    known: dict[bytes, int] = {}
    parts = []
    for i, words in enumerate(texts):
        parts.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        parts.append(np.array([-1 - i]))  # a word that occurs nowhere else
    flat = np.concatenate(parts)
    ends = np.cumsum([len(w) + 1 for w in texts])
    start, end, q = find_runs(flat)
    long = end - start >= least
    start, end, q = start[long], end[long], q[long]
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone) > 0
    cuts = np.searchsorted(start, np.concatenate(([0], ends)))
    runs, left = [], []
    for i, words in enumerate(texts):
        base, here = int(ends[i]) - len(words) - 1, slice(cuts[i], cuts[i + 1])
        rows = zip((start[here] - base).tolist(), (end[here] - start[here]).tolist(), q[here].tolist(), strict=True)
        runs.append([{"start": a, "length": n, "period": p} for a, n, p in rows])
        if runs[-1]:
            drop = gone[base : base + len(words)].tolist()
            words = [w for w, d in zip(words, drop, strict=True) if not d]
        left.append(b" ".join(words))
    return runs, left


Rewriting = Callable[[str | None, list[bytes]], list[bytes]]


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 12,
    rewrite: Rewriting | None = None,
) -> DataFrame:
    """Per document: doc_id, runs (start, length, period of each run of `least` words or more, by start,
    then period) and collapsed, the words that no run holds after its first period, joined by one space.

    `rewrite` changes the words of a document before; it gets the id as decimal text.
    """
    fields = "array<struct<start:long,length:long,period:long>>"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            held, size, first = [], 0, 0
            for i, (key, body) in enumerate(zip(batch.column(2), bodies, strict=True)):
                words = (body.as_py() or b"").split()  # on bytes: ASCII white space only
                held.append(rewrite(key.as_py(), words) if rewrite else words)
                size += len(words)
                if size >= BUFFER or i + 1 == batch.num_rows:
                    runs, left = _resolved(held, least)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(held)), pa.array(runs, kind), pa.array(left, pa.binary())],
                        names=["doc_id", "runs", "collapsed"],
                    )
                    held, size, first = [], 0, i + 1

    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("binary").alias("body"),
        F.col(doc_id).cast("string").alias("key"),
    )
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {fields}, collapsed binary"
    return rows.mapInArrow(releasing(resolved), kinds)
