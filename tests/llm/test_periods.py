import hashlib
import random
import zlib

import numpy as np
import pytest
from data import documents, frame

from tablewright.llm import periods, queries
from tablewright.llm.periods import find_runs, periodic_runs


def plain_runs(words):
    """All runs by comparing the words with themselves, shifted by every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start >= q:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((a, b, q) for (a, b), q in found.items())


def sequences(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 120))]
    if kind == 1:
        a, b = [0], [0, 1]
        for _ in range(rng.randint(3, 9)):
            a, b = b, b + a
        return b[:200]
    words = []
    if kind == 2:  # highly periodic stretches that break off
        while len(words) < rng.randint(50, 400):
            u = [rng.randrange(2) for _ in range(rng.randint(1, 6))]
            v = u * rng.randint(1, 40)
            words += v[: len(v) - rng.randrange(len(u))] * rng.randint(1, 3)
    elif kind == 3:
        u = [0] * rng.randint(1, 30) + [1] + [0] * rng.randint(0, 30)
        for _ in range(rng.randint(1, 4)):
            words += u * rng.randint(1, 4)
            words = words[: len(words) - rng.randint(0, 3)]
            if rng.random() < 0.5:
                words += words
    else:  # long periods within prose
        words = [rng.randrange(500) for _ in range(300)]
        at, p = rng.randrange(200), rng.randint(1, 90)
        words = [w if i < at else words[at + (i - at) % p] for i, w in enumerate(words)]
    return words[:500]


@pytest.mark.parametrize("seed", range(6))
def test_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(120):
        words = sequences(rng)
        got = [tuple(r) for r in find_runs(np.array(words, np.int64)).T.tolist()]
        assert sorted(got) == plain_runs(words)


def test_long_extension(monkeypatch):
    monkeypatch.setattr(periods, "LEVELS", 3)  # proposals are extended in many steps
    words = list(range(150)) * 5 + [7] * 100 + list(range(60)) * 9
    got = [tuple(r) for r in find_runs(np.array(words, np.int64)).T.tolist()]
    assert sorted(got) == plain_runs(words)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [(a, b - a, q) for a, b, q in plain_runs(words) if b - a >= 12]
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periods, "BUFFER", 200)
    rows = [r for r in documents() if len(r[1] or "") < 6000]
    rows += [(1000 + i, "la li lu " * i, None, None, 0) for i in range(12)]
    rows += [(None, "x y " * 9, None, None, 0), (None, None, None, None, 0), (1000, "x", None, None, 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["op12_periods"](spark, str(tmp_path)).collect()]
    want = [(r[0], *expected(r[0], r[1])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 10


def test_general_form(spark):
    rows = [(1, "a " + "b c " * 6 + "d", None, None, 0), (2, "b  b\tb", None, None, 0)]
    got = {r.doc_id: r for r in periodic_runs(frame(spark, rows), least=3).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 12, 2)] and bytes(got[1].collapsed) == b"a b c d"
    assert [tuple(r) for r in got[2].runs] == [(0, 3, 1)] and bytes(got[2].collapsed) == b"b"
    assert periodic_runs(frame(spark, [])).count() == 0
